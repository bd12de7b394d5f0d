"""Chat formatting with linked tool calls, in DataFrame functions alone.

An assistant message whose text is a JSON object with ``tool_calls`` makes calls; a tool message
whose text is a JSON object with ``tool_call_id`` is a result. Results are hash-joined to calls by
conversation and identifier. Calls may name other calls in ``depends_on``: the messages are ordered
topologically, and so are the calls within a message. Arguments are validated against the schemas of
the tools. Every message becomes canonical JSON: keys in order, no spaces. A plain assistant message
is linked to the message of the turn before in the same way, the turn being its identifier.

Each message gets a ``position``; by it, then by turn, a conversation is in order: a result comes
after its call, a message that makes a call after the results that the call depends on (after the
call itself where it has no result), and of two calls in one message the results in the order of
their dependence. A message that is in order already keeps its turn (shifted by ``STEP_BITS``); one
that would come too early moves behind what it waits for. Conversations are never gathered into one
row or task, so any length will do.

Defined cases: null text is JSON null; text that is no such JSON object is plain content; of calls
with one identifier the first counts; a result without its call is unlinked; what depends on a
missing call doesn't wait for it; messages on a circle of dependence, or behind one, stay at their
turn and are not ``ordered``; repeated rows stay; null ids link to nothing, and a null turn has a null
position; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: (tool, argument, JSON type, required) of the tools that are known by default.
SCHEMAS = (("search", "query", "string", True), ("search", "limit", "number", False), ("weather", "city", "string", True), ("calendar", "range", "object", False), ("send_mail", "to", "string", True), ("send_mail", "body", "string", True))

#: Low bits of a position that order messages which have moved to one turn.
STEP_BITS = 20


def schema_table(spark, schemas=SCHEMAS) -> DataFrame:
    """(tool, argument, type, required) as literals, so that no Python worker makes them."""
    names = ("tool", "argument", "type", "required")
    rows = [F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row, strict=True)]) for row in schemas]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*") if rows else spark.sql("SELECT '' tool, '' argument, '' type, true required").where("false")


def _json_type(raw: Column) -> Column:
    """JSON type of a value as it stands in the text."""
    kind = F.schema_of_variant(raw)
    return F.when(kind == "STRING", "string").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "number").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").otherwise("object")


def _canonical(raw: Column) -> Column:
    """A JSON text with its keys in order; text that isn't JSON becomes a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), _quoted(raw))


def _quoted(text: Column) -> Column:
    inner = F.to_json(F.struct(text.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(inner, 6, 1 << 30).substr(F.lit(1), F.length(inner) - 6)


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the calls that a message makes and the call that it answers."""
    looks = F.col("text").startswith("{")
    calls = F.when((F.col("role") == "assistant") & looks, F.from_json("text", _CALLS)["tool_calls"])
    result = F.when((F.col("role") == "tool") & looks, F.from_json("text", _RESULT))
    return messages.select("conv_id", "turn", "role", "text", F.when(F.size(calls) > 0, calls).alias("calls"), result["tool_call_id"].alias("answers"), result["content"].alias("content"))


def call_rows(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per (conv_id, id): turn of the first such call, valid arguments, what it depends on."""
    each = messages.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("at", "call")).where("call.id is not null")
    first = each.groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("turn", "at", "call")).alias("x")).select("conv_id", "id", "x.turn", F.col("x.call.name").alias("tool"), F.col("x.call.arguments").alias("raw"), F.coalesce("x.call.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    fields = F.from_json("raw", "map<string,string>")
    names = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
    typed = first.withColumn("parsed", F.try_parse_json("raw")).withColumn("names", names)
    rules = schemas.groupBy("tool").agg(F.collect_list(F.struct("argument", "type", "required")).alias("rules"))
    joined = typed.join(rules, "tool", "left")

    def value_type(name: Column) -> Column:
        return F.get(F.transform(F.filter(F.col("kinds"), lambda k: k["key"] == name), lambda k: k["kind"]), F.lit(0))

    kinds = F.transform(F.map_entries(F.from_json("raw", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), _json_type(e["value"]).alias("kind")))
    joined = joined.withColumn("kinds", kinds)
    known = F.transform(F.col("rules"), lambda r: r["argument"])
    right = F.forall(F.col("rules"), lambda r: F.when(F.array_contains(F.col("names"), r["argument"]), value_type(r["argument"]) == r["type"]).otherwise(~r["required"]))
    valid = F.col("parsed").isNotNull() & F.col("rules").isNotNull() & right & (F.size(F.array_except("names", known)) == 0)
    return joined.select("conv_id", "id", "turn", F.coalesce(valid, F.lit(False)).alias("valid"), F.array_distinct("depends_on").alias("depends_on"))


def _slot(turn: Column) -> Column:
    """The position of a message that stays at its turn."""
    return F.shiftleft(turn.cast("long"), STEP_BITS)


def _node(kind: str, name: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(name).cast("string"))


def call_places(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, id, base), (conv_id, turn, place)): the position after which a call's results come, and that of each calling message.

    Both hold only what can be ordered. ``calls``: (conv_id, id, turn, depends_on); ``results``: (conv_id, id, turn).
    Nodes are messages and calls; a round settles all whose predecessors are settled, so there are
    as many rounds as the longest chain of dependent calls, and none without dependences.
    """
    calls = calls.where("turn is not null")
    of = calls.select("conv_id", F.col("id").alias("needs"), F.col("turn").alias("needs_turn"))
    needs = stored(calls.select("conv_id", "id", "turn", F.explode("depends_on").alias("needs")).join(of, ["conv_id", "needs"]), "chat-needs")
    if needs.isEmpty():
        return calls.select("conv_id", "id", _slot(F.col("turn")).alias("base")), calls.select("conv_id", "turn", _slot(F.col("turn")).alias("place")).distinct()
    last = results.groupBy("conv_id", "id").agg(F.max("turn").alias("last"))
    known = stored(calls.drop("depends_on").join(last, ["conv_id", "id"], "left").withColumn("plus", F.col("last").isNotNull().cast("int")), "chat-known")
    nodes = known.select("conv_id", _node("m", "turn").alias("node"), _slot(F.col("turn")).alias("own")).distinct()
    nodes = nodes.unionByName(known.select("conv_id", _node("c", "id").alias("node"), F.coalesce(_slot(F.col("last")), F.lit(-(1 << 63))).alias("own")))
    within = needs.where("turn = needs_turn").join(known.select("conv_id", "id", "plus"), ["conv_id", "id"])
    edges = needs.where("turn <> needs_turn").select("conv_id", _node("c", "needs").alias("src"), _node("m", "turn").alias("node"), F.lit(1).alias("plus"))
    edges = edges.unionByName(known.select("conv_id", _node("m", "turn").alias("src"), _node("c", "id").alias("node"), "plus"))
    edges = stored(edges.unionByName(within.select("conv_id", _node("c", "needs").alias("src"), _node("c", "id").alias("node"), "plus")).distinct(), "chat-edges")
    done = stored(nodes.join(edges, ["conv_id", "node"], "left_anti").select("conv_id", "node", F.col("own").alias("place"), F.col("own").alias("base")), "chat-places")
    while True:
        came = edges.join(done.select("conv_id", F.col("node").alias("src"), "place"), ["conv_id", "src"], "left").join(done.select("conv_id", "node"), ["conv_id", "node"], "left_anti")
        ready = came.groupBy("conv_id", "node").agg(F.max(F.col("place") + F.col("plus")).alias("came"), F.max("place").alias("base"), F.count_if(F.col("place").isNull()).alias("open")).where("open = 0")
        new = stored(ready.join(nodes, ["conv_id", "node"]).select("conv_id", "node", F.greatest("own", "came").alias("place"), "base"), "chat-places")
        if new.isEmpty():
            break
        done = done.unionByName(new)
    bases = known.select("conv_id", "id", _node("c", "id").alias("node")).join(done, ["conv_id", "node"]).select("conv_id", "id", "base")
    return bases, known.select("conv_id", "turn", _node("m", "turn").alias("node")).distinct().join(done, ["conv_id", "node"]).select("conv_id", "turn", "place")


def in_order(calls: Column) -> Column:
    """The calls of one message, each after those of the same message that it depends on; circles come last."""
    ids = F.transform(calls, lambda c: c["id"])
    inner = F.transform(calls, lambda c: F.array_intersect(F.coalesce(c["depends_on"], F.array().cast("array<string>")), ids))
    deep = F.exists(inner, lambda own: F.size(own) > 0)

    def deeper(level: Column, _: Column) -> Column:
        return F.transform(inner, lambda own: F.coalesce(F.array_max(F.transform(own, lambda d: F.get(level, (F.array_position(ids, d) - 1).cast("int")) + 1)), F.lit(0)))

    level = F.aggregate(F.sequence(F.lit(1), F.size(calls)), F.transform(calls, lambda c: F.lit(0)), deeper)
    sorted_ = F.transform(F.array_sort(F.zip_with(F.transform(level, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), calls, lambda at, c: F.struct(at.alias("at"), c.alias("c")))), lambda x: x["c"])
    return F.when(deep, sorted_).otherwise(calls)


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, message (canonical JSON), n_calls, n_valid, links_to (turn), position, ordered."""
    rows = parsed(messages)
    calls = stored(call_rows(rows, schemas), "chat-calls")
    bases, places = call_places(calls, rows.where("answers is not null").select("conv_id", F.col("answers").alias("id"), "turn"))
    of_message = calls.groupBy("conv_id", "turn").agg(F.count_if("valid").alias("n_valid")).join(places, ["conv_id", "turn"], "left")
    # A key per message that can be linked to: a call's identifier, or the turn of a plain message.
    turns = rows.where("calls is null and answers is null and turn is not null").groupBy("conv_id", _node("turn", "turn").alias("id")).agg(F.min("turn").alias("linked_turn")).withColumn("base", F.lit(None).cast("long"))
    targets = calls.join(bases, ["conv_id", "id"], "left").select("conv_id", _node("call", "id").alias("id"), F.col("turn").alias("linked_turn"), "base").unionByName(turns.select("conv_id", "id", "linked_turn", "base"))
    reply = F.when((F.col("role") == "assistant") & F.col("calls").isNull(), F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")))
    linked = rows.withColumn("id", F.when(F.col("answers").isNotNull(), _node("call", "answers")).otherwise(reply))
    linked = linked.join(targets.hint("shuffle_hash"), ["conv_id", "id"], "left").join(of_message.hint("shuffle_hash"), ["conv_id", "turn"], "left")
    call_json = F.transform(in_order(F.col("calls")), lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(_canonical(c["arguments"]), F.lit("null")), F.lit(',"id":'), _quoted(c["id"]), F.lit(',"name":'), _quoted(c["name"]), F.lit("}")))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    message = (
        F.when(F.col("calls").isNotNull(), F.concat(F.lit('{"role":"assistant","tool_calls":['), F.array_join(call_json, ","), F.lit("]}")))
        .when(F.col("answers").isNotNull(), F.concat(F.lit('{"content":'), F.coalesce(_canonical(F.col("content")), F.lit("null")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("answers")), F.lit("}")))
        .otherwise(plain)
    )
    is_result, own = F.col("answers").isNotNull() & F.col("linked_turn").isNotNull(), _slot(F.col("turn"))
    position = F.when(is_result & own.isNotNull(), F.greatest(own, F.coalesce("base", _slot(F.col("linked_turn"))) + 1)).when(F.col("calls").isNotNull(), F.coalesce("place", own)).otherwise(own)
    settled = F.when(is_result, F.col("base").isNotNull()).when(F.col("n_valid").isNotNull() & F.col("calls").isNotNull(), F.col("place").isNotNull()).otherwise(F.lit(True))
    return linked.select(
        "conv_id", "turn", "role", message.alias("message"), F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid"),
        F.col("linked_turn").alias("links_to"), position.alias("position"), settled.alias("ordered"),
    )
