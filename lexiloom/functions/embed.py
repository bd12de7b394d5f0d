"""Deterministic hash embedding, and the seam for trained models."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are embedded at once, for their numbers take several times the room of the vectors.
AT_ONCE = 1024


def give_back() -> None:
    """Free memory goes back, for workers are used again and what their allocators keep would add up on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """Unit vector from SHA-256: block ``i`` of 16 dimensions is the hash of ``i|text`` as 16 big-endian shorts over [-1, 1]."""
    starts = [b"%d|" % i for i in range(0, dims, 16)]

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).drop_null().to_pylist()
        x = np.empty((len(raw), dims))
        for at in range(0, len(raw), AT_ONCE):
            words = np.frombuffer(b"".join(hashlib.sha256(start + own).digest() for own in raw[at : at + AT_ONCE] for start in starts), ">u2")
            some = words.reshape(-1, 16 * len(starts))[:, :dims] / 65535 * 2 - 1
            norm = np.sqrt(np.add.accumulate(some * some, axis=1)[:, -1:])  # added one by one, as ``unit`` does
            x[at : at + AT_ONCE] = some / np.where(norm == 0, 1.0, norm)
        give_back()
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(there * dims)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~there))

    return vectors(text.cast("string"))


def unit(vector: Column) -> Column:
    """``vector`` over its length; of length zero it stays. Both are bound once, not computed for each element."""

    def over_length(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(F.when(norm == 0, 1.0).otherwise(norm)), lambda n: F.transform(v, lambda x: x / n))[0]

    return F.transform(F.array(vector), over_length)[0]


def embed_with(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 100) -> DataFrame:
    """``rows`` with ``embedding`` from a model that ``load`` opens once a task; it sees lists of at most ``batch`` texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            yield frame.assign(embedding=[v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])])

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>")


def chunk_size_for(max_input_tokens: int, ceiling: int = 512) -> int:
    """Chunk size in tokens that a model with this input window takes."""
    return min(ceiling, int(max_input_tokens * 0.85))
