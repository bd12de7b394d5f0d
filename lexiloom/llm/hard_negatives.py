"""Hard negatives by inner product: length buckets with sorted coordinate lists, pruned before exact verification.

All rows are laid into buckets of bounded size by descending length. A bucket is one row of a stored table and holds
its vectors and, for every coordinate of the vectors scaled to length one, the order of its rows by that coordinate. Anchors
are packed, a bounded number of packs at a time is broadcast to where buckets lie, and buckets never move. A pack skips
a bucket whose longest vector can't reach what any of its anchors still needs. What an anchor needs at
least, over its own length and the bucket's, is a cosine; so in each of the anchor's largest coordinates a vector can
only lie within a range, which is looked up in the sorted list. Rows within all ranges are verified by exact
integer inner products, and the best found so far raises what is needed next.

Two passes: an anchor's positives, its best rows of the same label; then for each positive the best rows of other labels
whose score lies between two shares of the positive's. What an anchor needs at first comes from a bounded sample of
the rows (``PILOT``): a k-th best of some rows is never above the k-th best of all, so no result depends on it.

Defined cases: rows with a null label, id or vector, an empty vector, a null or non-finite component, or components too large
for exact shares of products (squares that add up to 2^56) take no part; only vectors of one length are compared; a row isn't its
own positive, a repeated row of it is, and repeated anchors are answered each; ties go to the smaller id; fewer rows than asked are all
returned; positives with a score below zero have no negatives; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

POSITIVES, NEGATIVES = 5, 3
#: Shares of a positive's score, in hundredths, between which a negative's lies.
LEAST, MOST = 50, 95
#: Components of a bucket's vectors and of a pack's; rows of either at most; packs that are broadcast at once.
BUCKET_CELLS, BUCKET_ROWS = 1 << 18, 4096
PACK_CELLS, PACK_ROWS, PACKS = 1 << 16, 1024, 8
#: Tasks over which buckets are dealt at most; beyond it a task lays out several.
PARTS = 10_000
#: Coordinates of an anchor that are looked up, and the share of a bucket above which a lookup isn't worth it.
FOCUS, WEAK = 5, 0.25
#: Rows from which the first bounds come.
PILOT = 4096
_SLACK = 1e-9


def _rows(rows: DataFrame, is_anchor: Column, key: str, vector: str, label: Column) -> DataFrame:
    """(row, vec_id, label, vector as integers, square, asks) of the rows that take part."""
    v = F.col("v")
    given = rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * 256).cast("double")).alias("f"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**30)))
    square = F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x)
    some = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & fine, F.lit(False)))
    some = some.select("vec_id", "label", F.transform("f", lambda x: x.cast("int")).alias("vector"), square.alias("square"), "asks").where(F.col("square") < 2.0**56)
    return some.withColumn("row", F.monotonically_increasing_id())


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


_BUCKET = "longest double, n int, row binary, vec_id binary, label binary, vector binary, lists binary"


def _bucket(table: pa.Table, dim: int) -> dict:
    """Rows in the order of descending length as one bucket; ``lists``: by coordinate, the order of the unit vectors."""
    x = _matrix(table.column("vector"), dim)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    unit = x / np.maximum(length, 1)[:, None]
    lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
    held = lambda name: np.ascontiguousarray(table.column(name).to_numpy().astype(np.int64)).tobytes()
    return {"longest": float(length.max()), "n": len(x), "row": held("row"), "vec_id": held("vec_id"), "label": held("label"), "vector": x.astype(np.int32).tobytes(), "lists": np.ascontiguousarray(lists).tobytes()}


def _buckets(dim: int, size: int):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_pylist([_bucket(table.slice(0, size), dim)], schema=_schema())
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield pa.RecordBatch.from_pylist([_bucket(pa.Table.from_batches(held), dim)], schema=_schema())

    return buckets


def _schema() -> pa.Schema:
    kinds = {"double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _BUCKET.split(", "))])


class Bucket:
    """A bucket as its row holds it."""

    def __init__(self, held: dict, dim: int):
        self.row, self.id, self.label = (np.frombuffer(held[c], np.int64) for c in ("row", "vec_id", "label"))
        self.x = np.frombuffer(held["vector"], np.int32).reshape(-1, dim)
        self.exact = self.x.astype(np.float64)
        self.length = np.sqrt((self.exact**2).sum(axis=1))
        self.unit = self.exact / np.maximum(self.length, 1)[:, None]
        self.lists = np.frombuffer(held["lists"], np.uint16).reshape(dim, -1)
        self._sorted: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        """The sorted list of a coordinate."""
        if f not in self._sorted:
            self._sorted[f] = self.unit[self.lists[f], f]
        return self._sorted[f]

    def feasible(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | slice:
        """Rows whose product with an anchor could reach ``least``; all, where the lists don't say much."""
        if least <= 0 or not length or not len(self.length):
            return slice(None)
        long_enough = int(np.searchsorted(-self.length, -least / length * (1 - _SLACK), side="right"))
        if not long_enough:
            return np.zeros(0, dtype=np.int64)
        cosine = least / (length * self.length[0]) - _SLACK
        if cosine <= 0:
            return slice(0, long_enough)
        focus = np.argpartition(-np.abs(unit), min(FOCUS, len(unit)) - 1)[:FOCUS]
        ranges = []
        for f in focus.tolist():
            c = float(unit[f])
            reach = np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - c * c))
            low = -1.0 if c < -cosine else c * cosine - reach
            high = 1.0 if c > cosine else c * cosine + reach
            values = self.values(f)
            ranges.append((np.searchsorted(values, low - _SLACK), np.searchsorted(values, high + _SLACK, side="right"), f, low - _SLACK, high + _SLACK))
        ranges.sort(key=lambda r: r[1] - r[0])
        start, stop, f, _, _ = ranges[0]
        if stop - start > WEAK * len(self.length):
            return slice(0, long_enough)
        some = self.lists[f][start:stop].astype(np.int64)
        some = some[some < long_enough]
        for _, _, f, low, high in ranges[1:]:
            own = self.unit[some, f]
            some = some[(own >= low) & (own <= high)]
        return some

    def products(self, some: np.ndarray | slice, anchors: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products of some rows with anchors, a column each."""
        if length * self.length.max(initial=0) < 2.0**52:  # then doubles are exact
            return self.exact[some] @ anchors.T.astype(np.float64)
        return self.x[some].astype(np.int64) @ anchors.T


def _first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` by descending score, then id, then row."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]
    return np.lexsort((rows, ids, -score))[:k]


class Asked:
    """What is known of one anchor: its best so far, one list for its positives or one for each interval."""

    def __init__(self, row: int, label: int, need: float, intervals: list[tuple[int, int]] | None, k: int):
        self.row, self.label, self.intervals, self.k = row, label, intervals, k
        n = 1 if intervals is None else len(intervals)
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in range(n)]
        self.given = need
        self.need = self._need()

    def _need(self) -> float:
        """The least score that could still change a list."""
        if self.intervals is None:
            own = float(self.best[0][0][-1]) if len(self.best[0][0]) == self.k else -np.inf
            return max(self.given, own)
        each = [float(b[0][-1]) if len(b[0]) == self.k else float(low) for (low, high), b in zip(self.intervals, self.best, strict=True) if low <= high]
        return max(self.given, min(each, default=np.inf))

    def take(self, bucket: Bucket, some, score: np.ndarray) -> None:
        own = self.label == bucket.label[some]
        at = np.flatnonzero((own if self.intervals is None else ~own) & (score >= self.need))
        if not len(at):
            return
        score = score[at].astype(np.int64)
        ids, rows = bucket.id[some][at], bucket.row[some][at]
        for n, (low, high) in enumerate(self.intervals or [(None, None)]):
            if low is None:
                fits = np.flatnonzero(rows != self.row)
            else:
                fits = np.flatnonzero((score >= low) & (score <= high))
            if len(fits):
                joined = [np.concatenate([a, b[fits]]) for a, b in zip(self.best[n], (score, ids, rows), strict=True)]
                first = _first(*joined, self.k)
                self.best[n] = tuple(x[first] for x in joined)
        self.need = self._need()


def _search(dim: int, k: int):
    """The ``k`` best of each list of each anchor over a task's buckets, (anchor, list, row, vec_id, score)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[np.ndarray, np.ndarray, list[Asked]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pack = batch.column("pack")[i].as_py()
                if pack not in asked:
                    asked[pack] = _unpacked(batch.column("anchors")[i].values, dim, k)
                bucket = Bucket({c: batch.column(c)[i].as_py() for c in ("row", "vec_id", "label", "vector", "lists")}, dim)
                _meet(bucket, *asked[pack])
        out = [[], [], [], [], []]
        for _, _, own in asked.values():
            for one in own:
                for n, (score, ids, rows) in enumerate(one.best):
                    for column, values in zip(out, (np.full(len(ids), one.row), np.full(len(ids), n), rows, ids, score), strict=True):
                        column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "list", "row", "vec_id", "score"])

    return search


def _unpacked(anchors: pa.StructArray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, list[Asked]]:
    at = {name: anchors.field(name) for name in ("row", "label", "need", "intervals")}
    x = _matrix(anchors.field("vector"), dim)
    own = []
    for row, label, need, intervals in zip(*(at[c].to_pylist() for c in at), strict=True):
        own.append(Asked(row, label, -np.inf if need is None else need, None if intervals is None else [(i["low"], i["high"]) for i in intervals], k))
    return x, np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), own


def _meet(bucket: Bucket, x: np.ndarray, length: np.ndarray, own: list[Asked]) -> None:
    whole: dict[int, slice] = {}
    for i, one in enumerate(own):
        some = bucket.feasible(x[i] / max(length[i], 1.0), length[i], one.need)
        if isinstance(some, slice):
            whole[i] = some
        elif len(some):
            one.take(bucket, some, bucket.products(some, x[i : i + 1], length[i])[:, 0])
    for start in range(0, len(whole), 128):  # these meet the bucket in one product
        group = list(whole)[start : start + 128]
        product = bucket.products(slice(None), x[group], max(length[group]))
        for column, i in enumerate(group):
            own[i].take(bucket, whole[i], np.ascontiguousarray(product[whole[i], column]))


_FOUND = "anchor long, list long, row long, vec_id long, score long"


def _packs(asks: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(pack, reach, least, anchors) of (row, label, vector, square, need, intervals), and the number of packs."""
    packs = max(1, -(-asks.count() // size))
    need = F.coalesce("need", F.lit(float("-inf")))
    rows = asks.select(F.pmod(F.xxhash64("row"), F.lit(packs)).alias("pack"), F.sqrt("square").alias("reach"), need.alias("least"), F.struct("row", "label", "vector", "need", "intervals").alias("anchor"))
    return stored(rows.groupBy("pack").agg(F.max("reach").alias("reach"), F.min("least").alias("least"), F.collect_list("anchor").alias("anchors")), "negatives-packs"), packs


def _met(packs: DataFrame, buckets: DataFrame, dim: int, k: int) -> DataFrame:
    """Every pack with every bucket that is long enough for it; the smaller side is broadcast by the caller."""
    both = buckets.join(packs, F.col("reach") * F.col("longest") * (1 + _SLACK) >= F.col("least"))
    return both.select("pack", "anchors", "row", "vec_id", "label", "vector", "lists").mapInArrow(_search(dim, k), _FOUND)


def _best(asks: DataFrame, buckets: DataFrame, pilot: DataFrame, dim: int, k: int) -> DataFrame:
    """(anchor, list, rank, vec_id, score): the ``k`` best of every list of every anchor."""
    size = max(16, min(PACK_ROWS, PACK_CELLS // dim))
    packs, n = _packs(asks, size)
    bound = _met(packs, F.broadcast(pilot), dim, k)  # pilot: one bucket
    # What every list of an anchor reaches in the sample, the anchor needs at least.
    lists = F.size(F.coalesce("intervals", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))))
    per_list = bound.groupBy("anchor", "list").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    per_anchor = per_list.where(F.col("n") >= k).groupBy("anchor").agg(F.count("*").alias("full"), F.min("kth").alias("kth"))
    bounds = per_anchor.withColumnRenamed("anchor", "row")
    raised = asks.withColumn("lists", lists).join(bounds, "row", "left").withColumn("need", F.when(F.col("full") == F.col("lists"), F.greatest(F.col("kth").cast("double"), "need")).otherwise(F.col("need")))
    packs, n = _packs(raised.select("row", "label", "vector", "square", "need", "intervals"), size)
    found = [stored(_met(F.broadcast(packs.where(F.col("pack").between(at, at + PACKS - 1))), buckets, dim, k), "negatives-found") for at in range(0, n, PACKS)]
    all_ = functools.reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "vec_id", "row"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor", "list", "rank", "vec_id", "score")


def _lay_out(rows: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(all buckets, one of a sample), stored."""
    size = max(64, min(BUCKET_ROWS, BUCKET_CELLS // dim))
    parts = max(1, min(PARTS, -(-rows.count() // size)))
    by = [F.desc("square"), "vec_id", "row"]
    plain = rows.select("row", "vec_id", "label", "vector", "square")
    buckets = stored(plain.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_buckets(dim, size), _BUCKET), "negatives-buckets")
    sample = plain.orderBy(F.xxhash64("row")).limit(min(PILOT, size)).coalesce(1).sortWithinPartitions(*by)
    return buckets, stored(sample.mapInArrow(_buckets(dim, size), _BUCKET), "negatives-pilot")


def _mined(rows: DataFrame, dim: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    buckets, pilot = _lay_out(rows, dim)
    anchors = rows.where("asks").select("row", "vec_id", "label", "vector", "square")
    none = F.lit(None).cast("array<struct<low:long,high:long>>")
    first = stored(_best(anchors.select("row", "label", "vector", "square", F.lit(None).cast("double").alias("need"), none.alias("intervals")), buckets, pilot, dim, positives), "negatives-positives")
    # The scores between which a negative lies, rounded to whole numbers from within.
    low, high = F.expr(f"({least} * score + 99) div 100"), F.expr(f"{most} * score div 100")
    some = F.col("score") >= 0
    whole = F.struct("rank", "vec_id", "score", F.when(some, low).otherwise(1).alias("low"), F.when(some, high).otherwise(0).alias("high"))
    held = first.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(whole)).alias("positives"))
    asked = stored(anchors.join(held, "row"), "negatives-anchors")
    intervals = F.transform("positives", lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high")))
    asks = asked.select("row", "label", "vector", "square", F.lit(None).cast("double").alias("need"), intervals.alias("intervals")).where(F.exists("intervals", lambda i: i["low"] <= i["high"]))
    found = _best(asks, buckets, pilot, dim, negatives)
    named = found.join(asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positives"), "anchor").withColumn("p", F.get("positives", F.col("list").cast("int")))
    return named.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive its hardest negatives."""
    held = stored(_rows(rows, is_anchor, key, vector, F.col("label") if label is None else label), "negatives-rows")
    lengths = held.where("asks").select(F.size("vector").alias("dim")).distinct().collect()  # a row for each length of vectors
    out = [_mined(held.where(F.size("vector") == r.dim), r.dim, positives, negatives, least, most) for r in lengths]
    if not out:
        return rows.sparkSession.sql("SELECT 0L anchor_id, 0L positive_id, 0 rank, 0L negative_id, 0L positive_score, 0L negative_score").where("false")
    return functools.reduce(DataFrame.unionByName, out)
