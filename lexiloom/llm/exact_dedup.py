"""Exact deduplication with an extendible-hash index kept on shared files.

Texts are equal when they are identical after lower-casing A-Z. The key is the XXH64 of the
normalised text. A histogram of key prefixes sets up the directory: a bucket that holds more bytes
than its capacity splits, doubling the directory where needed. Each bucket (a range of keys) has an
owner task, so a task's share is a bucket's capacity at any size of input; it chains the rows of
equal key, compares bytes, and writes the bucket's page to the shared folder. A range that cannot
split further because one key overfills it is dealt over several owners by salt. Their chains meet
in one aggregate by key and SHA-256, to which each owner gives a digest per distinct text, no text.

Defined cases: a null text is the empty text; a null id is smaller than any other; among repeated
rows with the same largest id exactly one is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, slices, stored, text_or_empty

#: Bits of the key that the histogram resolves; the directory uses as many of them as it needs.
PREFIX_BITS = 24
#: A bucket splits beyond so many bytes of text.
BUCKET_BYTES = 16 << 20
_ROW_BYTES = 64
PAGES = "page int, chain int, key long, doc_id long, keep_id long, group_size long, kept boolean, dealt boolean, text_sha256 string"


def _normal(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Texts with A-Z in lower case, as bytes, and their keys."""
    texts = pc.cast(pc.ascii_lower(batch.column("text")), pa.binary())
    return texts, np.array([xxhash.xxh64_intdigest(x.as_buffer()) for x in texts], dtype=np.uint64)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, keys = _normal(batch)
        prefix, at = np.unique(keys >> np.uint64(64 - PREFIX_BITS), return_inverse=True)
        size = np.bincount(at, pc.binary_length(texts).to_numpy(zero_copy_only=False) + _ROW_BYTES, len(prefix))
        yield pa.RecordBatch.from_arrays([pa.array(prefix.astype(np.int64)), pa.array(size.astype(np.int64))], names=["prefix", "bytes"])


class Directory:
    """Where each key prefix lives: ``bucket[prefix]``, and over how many owners a bucket is dealt."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        """``sizes``: bytes by prefix of the deepest level that may be used; its length is a power of two."""
        deepest = len(sizes).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        self.depth, leaves, level = 0, [], [(0, 0)]
        while level:
            overfull = []
            for prefix, depth in level:
                width = 1 << (deepest - depth)
                held = int(total[(prefix + 1) * width] - total[prefix * width])
                if held > capacity and depth < deepest:
                    overfull += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
                else:
                    leaves.append((prefix, depth, held))
            self.depth += bool(overfull)  # the directory doubles
            level = overfull
        self.bucket = np.zeros(1 << self.depth, dtype=np.int32)
        self.owners = np.ones(len(leaves), dtype=np.int32)
        for i, (prefix, depth, held) in enumerate(sorted(leaves, key=lambda x: x[0] << (self.depth - x[1]))):
            width = 1 << (self.depth - depth)
            self.bucket[prefix * width : (prefix + 1) * width] = i
            self.owners[i] = max(1, -(-held // capacity))
        #: Owners are numbered through; a bucket's first one.
        self.first = (np.cumsum(self.owners) - self.owners).astype(np.int32)


def build_directory(texts: DataFrame, capacity: int = BUCKET_BYTES) -> Directory:
    """Two numbers per prefix reach the driver, for at most eight prefixes a bucket and 2 ** PREFIX_BITS in all."""
    fine = stored(texts.mapInArrow(_histogram, "prefix long, bytes long").groupBy("prefix").agg(F.sum("bytes").alias("bytes")), "dedup-histogram")
    total = fine.agg(F.sum("bytes")).first()[0] or 0
    depth = min(PREFIX_BITS, max(1, -(-total // capacity) - 1).bit_length() + 3)
    coarse = fine.groupBy(F.shiftright("prefix", PREFIX_BITS - depth).alias("prefix")).agg(F.sum("bytes").alias("bytes")).toArrow()
    sizes = np.zeros(1 << depth)
    sizes[coarse.column("prefix").to_numpy()] = coarse.column("bytes").to_numpy()
    return Directory(sizes, capacity)


def _route(held):
    """``held``: the directory, broadcast: four bytes a prefix and eight a bucket."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = held.value
        for n, batch in enumerate(slices(batches)):
            _, keys = _normal(batch)
            bucket = directory.bucket[(keys >> np.uint64(64 - directory.depth)).astype(np.int64)] if directory.depth else np.zeros(len(keys), dtype=np.int32)
            salt = (np.arange(len(keys)) + n * 7919) % directory.owners[bucket]
            owner, dealt = directory.first[bucket] + salt, directory.owners[bucket] > 1
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array(dealt), pa.array(keys.view(np.int64)), *batch.columns], names=["owner", "dealt", "key", *batch.schema.names])

    return route


def _owned(rows: DataFrame, directory: Directory) -> DataFrame:
    """``rows`` (doc_id, text, …), each in the partition of its key's owner."""
    held = rows.sparkSession.sparkContext.broadcast(directory)
    schema = T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("dealt", T.BooleanType()), T.StructField("key", T.LongType()), *rows.schema.fields])
    return rows.mapInArrow(_route(held), schema).repartitionById(int(directory.owners.sum()), F.col("owner"))


def _chains(keys: list[int], texts: list) -> list[int]:
    """Number of each row's class: rows of one key are chained, and bytes decide."""
    heads: dict[int, list[int]] = {}
    first: list = []
    out = []
    for key, text in zip(keys, texts, strict=True):
        chain = heads.setdefault(key, [])
        own = next((c for c in chain if first[c] == text), None)
        if own is None:
            chain.append(own := len(first))
            first.append(text)
        out.append(own)
    return out


def _winners(chain: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each class its winning row and its number of rows; null ids come as the smallest long."""
    order = np.lexsort((-np.arange(len(ids)), ids, chain))
    last = np.flatnonzero(np.append(chain[order][1:] != chain[order][:-1], True)) if len(order) else order
    return order[last], np.bincount(chain)


def _classes(page: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts, class of each row, and each class's winning row and number of rows."""
    texts = pc.cast(pc.ascii_lower(page.column("text")), pa.binary()).to_pylist()
    chain = np.array(_chains(page.column("key").to_pylist(), texts), dtype=np.int64)
    row, size = _winners(chain, page.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
    return texts, chain, row, size


def _pages(emit):
    """``emit`` over the whole page of an owner, which the bucket's capacity bounds."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if page is not None:
            yield from emit(page.combine_chunks()).to_batches()

    return pages


def _index(page: pa.Table) -> pa.Table:
    """Every row of a page with its class."""
    texts, chain, row, size = _classes(page)
    kept = np.zeros(len(chain), dtype=bool)
    kept[row] = True
    digest = [hashlib.sha256(texts[r]).hexdigest() for r in row]
    return pa.table(
        {
            "page": pa.array(np.full(len(chain), page.column("owner")[0].as_py(), np.int32)), "chain": pa.array(chain, pa.int32()), "key": page.column("key"), "doc_id": page.column("doc_id"), "keep_id": page.column("doc_id").take(pa.array(row[chain])),
            "group_size": pa.array(size[chain]), "kept": pa.array(kept), "dealt": page.column("dealt"), "text_sha256": pa.array([digest[c] for c in chain], pa.string()),
        }
    )


def _first(page: pa.Table) -> pa.Table:
    """The winning row of each class, with its digest."""
    texts, _, row, _ = _classes(page)
    row = np.sort(row)
    own = page.take(pa.array(row))
    added = {"page": pa.array(np.full(len(row), page.column("owner")[0].as_py(), np.int32)), "chain": pa.array(np.arange(len(row)), pa.int32()), "text_sha256": pa.array([hashlib.sha256(texts[r]).hexdigest() for r in row], pa.string())}
    return pa.table(added | {c: own.column(c) for c in own.column_names})


def _met(heads: DataFrame) -> DataFrame:
    """(key, text_sha256, best) of the heads (page, chain, key, doc_id, text_sha256, group_size) of dealt buckets: the row that stays."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "page", "chain")).alias("best")
    return heads.groupBy("key", "text_sha256").agg(best, F.sum("group_size").alias("total"))


def _inputs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _inputs(docs, key, text)
    directory = build_directory(rows.select("text"), capacity)
    index = stored(_owned(rows, directory).mapInArrow(_pages(_index), PAGES), "dedup-index")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not (directory.owners > 1).any():
        return index.select(*out)
    heads = index.where("dealt and kept").select("page", "chain", "key", "doc_id", "text_sha256", "group_size")
    wins = (F.col("page") == F.col("best.page")) & (F.col("chain") == F.col("best.chain"))
    met = heads.join(_met(heads), ["key", "text_sha256"]).select("page", "chain", F.col("best.doc_id").alias("keep_id"), F.col("total").alias("group_size"), wins.alias("wins"))
    joined = index.where("dealt").select("page", "chain", "doc_id", "kept", "text_sha256").join(met, ["page", "chain"])
    return index.where("not dealt").select(*out).unionByName(joined.withColumn("kept", F.col("kept") & F.col("wins")).select(*out))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with one row of each class of equal texts, the one of the largest id; whole rows travel once, into the index."""
    directory = build_directory(_inputs(docs, key, text).select("text"), capacity)
    rest, whole = set_aside(docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), F.col(text).isNull().alias("no_text"), rest)
    owned = _owned(rows, directory)
    schema = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("chain", T.IntegerType()), T.StructField("text_sha256", T.StringType()), *owned.schema.fields])
    kept = stored(owned.mapInArrow(_pages(_first), schema), "dedup-index")
    if (directory.owners > 1).any():
        met = _met(kept.where("dealt").select("page", "chain", "key", "doc_id", "text_sha256", F.lit(1).alias("group_size"))).select("best.page", "best.chain")
        kept = kept.where("not dealt").unionByName(kept.where("dealt").join(met, ["page", "chain"], "left_semi").select(*kept.columns))
    return kept.select(*whole({key: F.col("doc_id").cast(docs.schema[key].dataType), text: F.when(~F.col("no_text"), F.col("text"))}))
