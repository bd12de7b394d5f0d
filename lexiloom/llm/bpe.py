"""Byte-level BPE encoding and decoding of whole texts, long ones by overlapping chunks.

A text up to a chunk's length is encoded at once. A longer one is cut into overlapping chunks that
different tasks pre-tokenise. A chunk that starts inside a pre-token is wrong at first, but once
one of its boundaries is also a boundary of the chunk before, both go on alike; there the chunks
are stitched. The stretches between stitches are encoded in parallel and their ids concatenated.
Stitches follow a character that isn't white space, so that no look-ahead reaches over them. Texts
whose chunks don't meet within the overlap go through again with wider chunks and overlaps; only a
pre-token longer than those keeps a stretch long. Decoding concatenates raw bytes.

Defined cases: a null text is the empty text: no ids, the hash of no bytes; equal long texts are
encoded once; repeated rows each get their row; null ids are kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

#: Characters of a chunk, and of the next one that it also sees.
CHUNK, OVERLAP = 1 << 15, 1 << 10
_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.cache
def encoding(ranks: str, pattern: str):
    """The encoding of a rank file, loaded once a worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


@functools.cache
def _splitter(pattern: str):
    return regex.compile(pattern)


def encode(text: str, ranks: str, pattern: str) -> np.ndarray:
    return np.array(encoding(ranks, pattern).encode_ordinary(text), dtype="<u4")


def decode(ids: np.ndarray, ranks: str, pattern: str) -> bytes:
    return encoding(ranks, pattern).decode_bytes(ids.tolist())


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens that follow a character which isn't white space, without those at the cut end."""
    starts = [m.start() for m in _splitter(pattern).finditer(text)]
    return [s for s in starts[:-1] if s and not text[s - 1].isspace()]


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, characters) of the overlapping chunks of a text."""
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(1, len(text)), chunk)]


def _whole(ranks: str, pattern: str):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, own, raw = [], [], []
            for text in batch.column("text"):
                ids = encode(text.as_py(), ranks, pattern)
                n.append(len(ids))
                own.append(hashlib.sha256(ids.tobytes()).hexdigest())
                raw.append(hashlib.sha256(decode(ids, ranks, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(raw, pa.string())], names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    return whole


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text"), strict=True):
                own = chunks(text.as_py(), chunk, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([blob] * len(own)), pa.array(range(len(own)), pa.int32()), pa.array([s for s, _ in own], pa.int64()), pa.array([t for _, t in own], pa.string())], names=["blob", "chunk", "start", "text"])

    return cut


def _split(pattern: str, chunk: int, overlap: int):
    """By chunk: boundaries in its first stretch and in the one that it shares with the next, as positions in the text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            heads, tails = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text"), strict=True):
                found = boundaries(text.as_py(), pattern)
                heads.append([start + x for x in found if x <= overlap])
                tails.append([start + x for x in found if x >= chunk])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("chunk"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["blob", "chunk", "heads", "tails"])

    return split


def _encode_stretch(ranks: str, pattern: str):
    def encode_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, ids = batch.to_pydict(), []
            for start, text, begin, end in zip(at["start"], at["text"], at["begin"], at["end"], strict=True):
                ids.append(encode(text[begin - start : None if end is None else end - start], ranks, pattern))
            raw = [decode(x, ranks, pattern) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("chunk"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(raw, pa.binary())], names=["blob", "chunk", "ids", "raw"])

    return encode_stretch


def _join(stretches: pa.Table) -> pa.Table:
    """All stretches of one text, in order."""
    stretches = stretches.sort_by("chunk")
    ids, raw = hashlib.sha256(), hashlib.sha256()
    n = 0
    for a, b in zip(stretches.column("ids"), stretches.column("raw"), strict=True):
        ids.update(a.as_buffer())
        raw.update(b.as_buffer())
        n += len(a.as_buffer()) // 4
    return pa.table({"blob": stretches.column("blob").slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [ids.hexdigest()], "decoded_sha256": [raw.hexdigest()]})


def encode_long(texts: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(blob, n_tokens, ids_sha256, decoded_sha256) for distinct (blob, text)."""
    done = None
    while True:
        pieces = stored(texts.mapInArrow(_cut(chunk, overlap), "blob string, chunk int, start long, text string").repartition("blob", "chunk"), "bpe-chunks")
        split = stored(pieces.mapInArrow(_split(pattern, chunk, overlap), "blob string, chunk int, heads array<long>, tails array<long>"), "bpe-boundaries")
        before = split.select("blob", (F.col("chunk") + 1).alias("chunk"), "tails")
        meets = split.where("chunk > 0").select("blob", "chunk", "heads").join(before, ["blob", "chunk"], "left")
        stitches = stored(meets.select("blob", "chunk", F.array_min(F.array_intersect("heads", "tails")).alias("begin")), "bpe-stitches")
        astray = stored(stitches.where("begin is null").select("blob").distinct(), "bpe-astray")
        begins = stitches.join(astray, "blob", "left_anti")
        stretches = (
            pieces.join(astray, "blob", "left_anti")
            .join(begins, ["blob", "chunk"], "left")
            .join(begins.select("blob", (F.col("chunk") - 1).alias("chunk"), F.col("begin").alias("end")), ["blob", "chunk"], "left")
            .select("blob", "chunk", "start", "text", F.coalesce("begin", F.lit(0)).alias("begin"), "end")
        )
        part = stretches.mapInArrow(_encode_stretch(ranks, pattern), "blob string, chunk int, ids binary, raw binary").groupBy("blob").applyInArrow(_join, f"blob string, {_DIGEST}")
        done = part if done is None else done.unionByName(part)
        if astray.isEmpty():
            return done
        texts, chunk, overlap = stored(texts.join(astray, "blob", "left_semi"), "bpe-texts"), 8 * chunk, 8 * overlap


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    long_ = F.char_length("text") > chunk + overlap
    short = rows.where(~long_).mapInArrow(_whole(ranks, pattern), f"doc_id long, {_DIGEST}")
    blobs = rows.where(long_).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    texts = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return short.unionByName(blobs.select("doc_id", "blob").join(encode_long(texts, ranks, pattern, chunk, overlap), "blob").drop("blob"))
