"""SimHash near-duplicates by a binary trie self-join.

A fingerprint is the bitwise majority of the XXH64 values of a text's 3-word shingles. Two
fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit blocks, so the trie is
built in four rotations and each descent starts at the pairs (node, node) of depth 16, its budget
unspent. From there node pairs are walked together, a level a step, whole levels at a time in
numpy: the bits in which the two prefixes differ accumulate and a pair beyond the budget is pruned.
Owners of very full depth-16 nodes share them: such a node is opened further and its child pairs
are dealt out. The number of tasks follows the number of rows, and a task walks its node pairs one
after another, so it holds ``WALK_ROWS`` fingerprints or the two nodes of one pair.

A pair of nodes whose leaves are all known to be connected is pruned too, so thousands of near
copies don't make all their pairs. Tasks hand on at most one link a fingerprint; components are then
closed in Spark by hooking and pointer jumping.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and links
like any other; one or two words make one shingle; null ids are never the smallest of a component
(all null: null); repeated rows and equal texts share a fingerprint; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, join_classes, set_aside, slices, stored, text_or_empty, whole_groups

BITS, BUDGET, BLOCK = 64, 3, 16
WIDTH = 3
SEED = 42
#: Fingerprints of one depth-16 node beyond which it is opened further and dealt out.
NODE_ROWS = 50_000
#: Rows that are walked at once, and those that a task gets.
WALK_ROWS, TASK_ROWS = 200_000, 400_000
_PART = 1 << 16


def fingerprint(text: str) -> int:
    """Whole text, repeats of shingles included. Words are runs of anything but space and U+0009..U+000D."""
    words = text.encode().lower().split()  # bytes: A-Z only, and just these white-space characters
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= WIDTH:
        return xxhash.xxh64_intdigest(line, SEED)  # one value: its own majority
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - WIDTH + 1].tolist()
    stops = (ends[WIDTH - 1 :] - 1).tolist()
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _PART):  # the counts add up over parts, so memory stays bounded for any length
        h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[at : at + _PART], stops[at : at + _PART], strict=True)), dtype=">u8", count=min(_PART, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(x.as_py()) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp); ``fp`` holds the 64 bits as a signed long."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class _Forest:
    """Which leaves of one task are known to be connected; ``label`` is the smallest index of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            lo, hi = np.minimum(x[open_], y[open_]), np.maximum(x[open_], y[open_])
            np.minimum.at(self.label, hi, lo)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _leaf_pairs(lo1, hi1, lo2, hi2):
    """All (i, j) of the given interval pairs."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    size = n1 * n2
    pair = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo1[pair] + at // n2[pair], lo2[pair] + at % n2[pair]


def trie_links(values: np.ndarray, unit: np.ndarray, depth: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Labels that connect the rows of each unit within the budget.

    ``values``: rotated fingerprints, ascending within each unit; a unit is one pair of trie nodes to
    walk. ``second`` is 1 for rows below the unit's second node, which then differs from its first.
    ``depth``: how many leading bits the unit's nodes fix.
    """
    forest, n = _Forest(len(values)), len(values)
    if not n:
        return forest.label
    side = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (second[1:] != second[:-1])]))
    stop = np.append(side[1:], n)
    two = second[side] == 1
    first_of = np.where(two, np.arange(len(side)) - 1, np.arange(len(side)))
    opens = two | np.append(~two[1:], True)  # the second node, or a node alone; a first node waits for its second
    b = np.flatnonzero(opens)
    a = first_of[b]
    whole = unit[side[a]] == unit[side[b]]  # a second node without a first has no partner
    a, b = a[whole], b[whole]
    lo1, hi1, lo2, hi2 = side[a], stop[a], side[b], stop[b]
    level = depth[side[b]]
    used = _popcount((values[lo1] ^ values[lo2]) & _mask(level))
    # Neighbours one bit apart connect most of a dense cluster at once, and the walk then skips it.
    same = a == b
    if same.any():
        _unite_flips(values, lo1[same], hi1[same], level[same], forest)
    stack = [(lo1, hi1, lo2, hi2, level, used)]
    while stack:
        lo1, hi1, lo2, hi2, level, used = stack.pop()
        if len(lo1) > _PART:  # a bounded share of the pairs at a time, depth first
            half = len(lo1) // 2
            stack += [tuple(x[half:] for x in (lo1, hi1, lo2, hi2, level, used)), tuple(x[:half] for x in (lo1, hi1, lo2, hi2, level, used))]
            continue
        keep = used <= BUDGET
        run = _runs(forest.label)
        keep &= ~((run[lo1] >= hi1) & (run[lo2] >= hi2) & (forest.label[lo1] == forest.label[lo2]))
        lo1, hi1, lo2, hi2, level, used = (x[keep] for x in (lo1, hi1, lo2, hi2, level, used))
        small = ((hi1 - lo1) * (hi2 - lo2) <= 16) | (level >= BITS)
        if small.any():
            i, j = _leaf_pairs(lo1[small], hi1[small], lo2[small], hi2[small])
            close = (i < j) & (_popcount(values[i] ^ values[j]) <= BUDGET)
            forest.unite(i[close], j[close])
        lo1, hi1, lo2, hi2, level, used = (x[~small] for x in (lo1, hi1, lo2, hi2, level, used))
        if not len(lo1):
            continue
        m1, m2 = _middle(values, lo1, hi1, level), _middle(values, lo2, hi2, level)
        same, level = (lo1 == lo2) & (hi1 == hi2), level + 1
        parts = [(lo1, m1, lo2, m2, used, None), (m1, hi1, m2, hi2, used, None), (lo1, m1, m2, hi2, used + 1, None), (m1, hi1, lo2, m2, used + 1, ~same)]
        out = []
        for p1, q1, p2, q2, u, also in parts:
            ok = (q1 > p1) & (q2 > p2) & (u <= BUDGET)
            ok = ok if also is None else ok & also  # a node's children meet once
            out.append(tuple(x[ok] for x in (p1, q1, p2, q2, level, u)))
        stack.append(tuple(np.concatenate(x) for x in zip(*out, strict=True)))
    return forest.label


def _mask(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, ~np.uint64(0) << (np.uint64(64) - np.maximum(level, 1).astype(np.uint64)), np.uint64(0))


def _runs(label: np.ndarray) -> np.ndarray:
    """For each index the end of the run of equal labels that it is in."""
    edge = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, len(label))
    return edge[np.searchsorted(edge, np.arange(len(label)), side="right")]


def _middle(values, lo, hi, level):
    """Where bit ``level`` turns to one in each interval of ascending values: bisection, all intervals at once."""
    bit, lo, hi = np.uint64(63) - level.astype(np.uint64), lo.copy(), hi.copy()
    while True:
        wide = lo < hi
        if not wide.any():
            return lo
        mid = (lo + hi) // 2
        one = (values[np.minimum(mid, len(values) - 1)] >> bit & np.uint64(1)).astype(bool)
        hi = np.where(wide & one, mid, hi)
        lo = np.where(wide & ~one, mid + 1, lo)


def _unite_flips(values, lo, hi, level, forest) -> None:
    for p, q, d in zip(lo[hi - lo >= 64].tolist(), hi[hi - lo >= 64].tolist(), level[hi - lo >= 64].tolist(), strict=True):
        own = values[p:q]
        for bit in range(64 - d):
            flipped = own ^ (np.uint64(1) << np.uint64(bit))
            at = np.minimum(np.searchsorted(own, flipped), len(own) - 1)
            hit = own[at] == flipped
            forest.unite(np.flatnonzero(hit) + p, at[hit] + p)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks the units of one partition, which come in order, whole units at a time."""
    for table in whole_groups(batches, "unit", WALK_ROWS):
        yield _walked(table)


def _walked(table: pa.Table) -> pa.RecordBatch:
    """A link from each fingerprint to the first of its set."""
    unit, second, depth = (table.column(c).to_numpy().astype(np.int64) for c in ("unit", "second", "depth"))
    turn, value = table.column("turn").to_numpy().astype(np.uint64), table.column("value").to_numpy().view(np.uint64)
    order = np.lexsort((value, second, unit))
    unit, second, depth, turn, value = unit[order], second[order], depth[order], turn[order], value[order]
    root = trie_links(value, unit, depth, second)
    linked = root != np.arange(len(root))
    back = _rotate(value, (np.uint64(BITS) - turn) % np.uint64(BITS))
    return pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[root[linked]].view(np.int64))], names=["a", "b"])


def _rotate(value: np.ndarray, by) -> np.ndarray:
    by = np.asarray(by, dtype=np.uint64) if not np.isscalar(by) else np.full(len(value), by, dtype=np.uint64)
    return np.where(by == 0, value, (value << by) | (value >> ((np.uint64(BITS) - by) % np.uint64(BITS))))


def _turned(own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints rotated by ``k`` blocks, and their depth-16 nodes (with ``k`` in front)."""
    value = _rotate(own, k * BLOCK)
    return value, ((value >> np.uint64(BITS - BLOCK)) | np.uint64(k << BLOCK)).astype(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("fp").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_turned(own, k)[1] for k in range(BITS // BLOCK)]))], names=["node"])


@functools.cache
def _flips(bits: int) -> np.ndarray:
    """In which of the further ``bits`` two children may differ within the budget."""
    x = np.arange(1 << bits)
    return x[np.bitwise_count(x) <= BUDGET]


def _units(full: dict[int, int]):
    """``full``: by node, how many more bits it is opened. Such a node's units are pairs of its children."""
    nodes = np.array(sorted(full), dtype=np.int64)
    bits = np.array([full[n] for n in nodes.tolist()], dtype=np.int64)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(BITS // BLOCK):
                value, node = _turned(own, k)
                wider = np.zeros(len(node), dtype=np.int64)
                if len(nodes):
                    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                    wider = np.where(nodes[at] == node, bits[at], 0)
                yield _unit_rows(k, node[wider == 0] | (1 << 60), 0, BLOCK, value[wider == 0])
                for w in np.unique(wider[wider > 0]).tolist():
                    v, n = value[wider == w], node[wider == w]
                    child = (v >> np.uint64(BITS - BLOCK - w)).astype(np.int64) & ((1 << w) - 1)
                    for flips in np.array_split(_flips(w), -(-len(_flips(w)) * len(v) // _PART)):  # a bounded batch at a time
                        one, other = (np.repeat(child, len(flips)), (child[:, None] ^ flips).ravel())
                        first = np.minimum(one, other)
                        yield _unit_rows(k, np.repeat(n, len(flips)) << 40 | first << 20 | (one ^ other ^ first), one != first, BLOCK + w, np.repeat(v, len(flips)))

    return units


def _unit_rows(k, unit, second, depth, value) -> pa.RecordBatch:
    full = lambda x: np.broadcast_to(np.asarray(x, dtype=np.int32), len(value))
    columns = [full(k * BLOCK), np.asarray(unit, dtype=np.int64), full(second), full(depth), value.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["turn", "unit", "second", "depth", "value"])


def links(prints: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``: not all pairs, but any two within the budget end up connected."""
    counts = prints.select("fp").mapInArrow(_nodes, "node long").groupBy("node").count().where(F.col("count") > node_rows)
    # at most 4 * 65536 nodes exist, whatever the input
    held = {r.node: r["count"] for r in counts.toLocalIterator()}
    full = {node: min(16, (n // node_rows).bit_length() + 2) for node, n in held.items()}
    units = prints.select("fp").mapInArrow(_units(full), "turn int, unit long, second int, depth int, value long")
    # an opened node's rows come once for each pair of children
    rows = BITS // BLOCK * prints.count() + sum(n * len(_flips(full[node])) for node, n in held.items())
    return units.repartition(max(1, -(-rows // TASK_ROWS)), F.col("unit")).sortWithinPartitions("unit").mapInArrow(_walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: the smallest node that can be reached.

    Each round hooks every node to the smallest root around it and jumps pointers once; rounds grow
    with the logarithm of a component's width. Sums meet map-side, so a hub costs a row per task, and
    roots that many nodes share are joined by broadcast (``join_classes``), so a component of any
    size stays spread.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "component-edges")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"), F.count("*").alias("n")), "component-state")
    while True:
        # how many edges a node has is how many rows look it up
        around = join_classes(both, state.select(F.col("node").alias("b"), "root", "n"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = stored(state.join(around, "node").select("node", "n", "root", F.least("root", "near").alias("low")), "component-hooked")
        # a root learns the smallest root that any of its members saw
        root_low = hooked.groupBy("root").agg(F.min("low").alias("root_low"), F.count("*").alias("n"))
        size = stored(root_low, "component-roots")
        moved = stored(join_classes(hooked.withColumnRenamed("n", "edges"), size, "root").select("node", "edges", "root", F.least("low", "root_low").alias("next")), "component-moved", instead=hooked)
        ahead = moved.groupBy("next").agg(F.count("*").alias("n")).join(moved.select(F.col("node").alias("next"), F.col("next").alias("next_root")), "next", "left")
        jump = stored(ahead, "component-jump", instead=size)
        new = join_classes(moved, jump, "next").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("next_root", "next")).alias("root"), F.col("edges").alias("n"))
        new = stored(new, "component-state", instead=state)
        forget(moved, jump)
        if new.where("root <> old").isEmpty():
            forget(both)
            return new.select("node", "root")
        state = new


def print_classes(prints: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(fp, n, component_id, stays) for every distinct ``fp`` of (doc_id, fp). One ``fp`` of a component stays; ``n`` rows hold it."""
    # copies meet map-side; from here on a group of copies is one row
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    root = components(links(distinct, node_rows))
    linked = stored(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-linked")
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "fp")).alias("best"), F.count("*").alias("n"))
    met = join_classes(linked.withColumnRenamed("n", "rows"), stored(best, "simhash-best"), "root")
    return stored(met.select("fp", F.col("rows").alias("n"), F.col("best.first_id").alias("component_id"), (F.col("fp") == F.col("best.fp")).alias("stays")), "simhash-classes")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = stored(fingerprints(docs, key, text), "simhash-fingerprints")
    return join_classes(rows, print_classes(rows, node_rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(x.as_py() or "") for x in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield batch.append_column("fp", pa.array(prints))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """``docs`` with one row of each component, one of the smallest id."""
    rest, whole = set_aside(docs, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), rest)
    rows = stored(rows.mapInArrow(_with_print, T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])), "simhash-rows")
    classes = print_classes(rows.select("doc_id", "fp"), node_rows)
    kept = join_classes(rows, classes, "fp").where("stays and doc_id <=> component_id")
    return kept.dropDuplicates(["fp"]).select(*whole({text: F.col("text").cast(docs.schema[text].dataType)}))
