"""Corpus health: findings over page facts and files on disk, all set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical, strip

# The names of the checks, in order, and of severities.
CHECKS = ("not-indexed", "unfindable", "duplicate-body", "duplicate-title", "wall-of-prose", "no-structure", "thin-page", "no-frontmatter", "no-h1", "title-mismatch")
SEVERITIES = ("error", "warn", "info")
THIN = 200
HINTS = {
    "not-indexed": "index the folder, or look at its ignore rules and file extensions", "unfindable": "add text below the frontmatter", "duplicate-body": "delete or change the copies", "duplicate-title": "give each page a title of its own",
    "wall-of-prose": "part the page by headings", "no-structure": "add a heading", "thin-page": "say more, or merge it into another page", "no-frontmatter": "add a title, a type or tags to filter by",
    "no-h1": "open the page with a level-one heading", "title-mismatch": "let title and heading say the same",
}


def page_facts(manifest: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, title, frontmatter_empty, chunk_count, sha256, heading_chunks, total_chunks, first_chunk_text)."""
    counted = chunks.groupBy("path").agg(F.count("*").alias("total_chunks"), F.count_if(F.size("heading_path") > 0).alias("heading_chunks"))
    first = chunks.where("chunk_idx = 0").select("path", F.col("text").alias("first_chunk_text"))
    info = pages.select("path", "title", F.coalesce(F.col("frontmatter").isin("", "{}"), F.lit(True)).alias("frontmatter_empty"))
    joined = manifest.select("path", "sha256", "chunk_count").join(info, "path", "left").join(counted, "path", "left").join(first, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("path", "title", F.coalesce("frontmatter_empty", F.lit(True)).alias("frontmatter_empty"), "chunk_count", "sha256", zero("heading_chunks"), zero("total_chunks"), F.coalesce("first_chunk_text", F.lit("")).alias("first_chunk_text"))


def _found(rows: DataFrame, check: Column | str, severity: str, detail: Column | None = None) -> DataFrame:
    check = F.lit(check) if isinstance(check, str) else check
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[check]
    return rows.select(check.alias("check"), F.lit(severity).alias("severity"), "path", (F.lit(None).cast("string") if detail is None else detail).alias("detail"), hint.alias("hint"))


def not_indexed(disk: DataFrame, facts: DataFrame) -> DataFrame:
    return _found(disk.join(facts, "path", "left_anti"), "not-indexed", "error")


def unfindable(facts: DataFrame) -> DataFrame:
    return _found(facts.where("chunk_count = 0"), "unfindable", "error", F.lit("0 chunks"))


def _shared(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key others share, with the size of the group and one other path of it.

    Any number of pages may share a key, so a finding names one other page and counts the rest;
    ``members`` lists them all, a row each.
    """
    keyed = rows.select("path", key.alias("key")).where("key is not null")
    size = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("n > 1")
    return keyed.join(size, "key").select("path", "n", F.when(F.col("path") == F.col("first_path"), F.col("last_path")).otherwise(F.col("first_path")).alias("other"))


def members(rows: DataFrame, key: Column) -> DataFrame:
    """(key, path) of all rows of (path, …) whose key others share."""
    keyed = rows.select("path", key.alias("key")).where("key is not null")
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")


def duplicate_members(facts: DataFrame) -> DataFrame:
    """(check, key, path): the full groups behind the findings of duplicate bodies and titles."""
    bodies = members(facts.where("chunk_count > 0"), F.col("sha256")).select(F.lit("duplicate-body").alias("check"), "key", "path")
    titles = members(facts.where(F.coalesce(F.col("title"), F.lit("")) != ""), canonical(F.col("title")))
    return bodies.unionByName(titles.select(F.lit("duplicate-title").alias("check"), "key", "path"))


def duplicate_bodies(facts: DataFrame) -> DataFrame:
    rows = _shared(facts.where("chunk_count > 0"), F.col("sha256"))
    return _found(rows, "duplicate-body", "error", _others("identical to ", rows))


def duplicate_titles(facts: DataFrame) -> DataFrame:
    rows = _shared(facts.where(F.coalesce(F.col("title"), F.lit("")) != ""), canonical(F.col("title")))
    return _found(rows, "duplicate-title", "warn", _others("title shared with ", rows))


def _others(words: str, rows: DataFrame) -> Column:
    more = F.when(F.col("n") > 2, F.concat(F.lit(" and "), (F.col("n") - 2).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.lit(words), F.col("other"), more)


def unstructured(facts: DataFrame) -> DataFrame:
    rows = facts.where("total_chunks > 0 and heading_chunks = 0")
    wall = F.col("chunk_count") >= 3
    return _found(rows, F.when(wall, "wall-of-prose").otherwise("no-structure"), "warn", F.when(wall, F.concat(F.col("chunk_count").cast("string"), F.lit(" chunks, no headings"))))


def thin(facts: DataFrame) -> DataFrame:
    size = F.length(strip(F.col("first_chunk_text")))
    return _found(facts.where((F.col("chunk_count") == 1) & (size < THIN)), "thin-page", "info", F.concat(size.cast("string"), F.lit(" chars of body")))


def no_frontmatter(facts: DataFrame) -> DataFrame:
    return _found(facts.where("frontmatter_empty and chunk_count > 0"), "no-frontmatter", "info")


def h1_checks(disk: DataFrame, facts: DataFrame) -> DataFrame:
    rows = disk.select("path", "h1").join(facts.select("path", "title"), "path")
    none = F.coalesce(F.col("h1"), F.lit("")) == ""
    differs = (F.col("title") != "") & (canonical(F.col("title")) != canonical(F.col("h1")))
    rows = rows.where(none | F.coalesce(differs, F.lit(False)))
    detail = F.when(~none, F.concat(F.lit('frontmatter "'), "title", F.lit('" != H1 "'), "h1", F.lit('"')))
    return _found(rows, F.when(none, "no-h1").otherwise("title-mismatch"), "info", detail)


def findings(facts: DataFrame, disk: DataFrame) -> DataFrame:
    """All checks, with the place of each in ``check_order``."""
    parts = [not_indexed(disk, facts), unfindable(facts), duplicate_bodies(facts), duplicate_titles(facts), unstructured(facts), thin(facts), no_frontmatter(facts), h1_checks(disk, facts)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("check_order", F.array_position(F.array(*map(F.lit, CHECKS)), F.col("check")).cast("int"))


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity, n) for every severity, zero included."""
    all_ = found.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return all_.join(found.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def failed(found: DataFrame, strict: bool = True) -> DataFrame:
    """(failed,): in strict mode whether any finding is an error, else false."""
    return found.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed")) if strict else found.agg(F.lit(False).alias("failed"))


def report(found: DataFrame, each: int = 20) -> DataFrame:
    """At most ``each`` findings of a check, worst first."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    n = F.row_number().over(Window.partitionBy("check").orderBy("path"))
    return found.withColumn("n", n).where(F.col("n") <= each).orderBy(place, "check_order", "n").select("severity", "check", "path", "detail", "hint")
