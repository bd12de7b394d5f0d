"""Shared helpers of the training-data operators: reading tables, joins with hot keys, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import forget, hadoop_path, new_folder, shared_dir, stored

__all__ = ["HEAVY", "class_counts", "forget", "hadoop_path", "join_classes", "new_folder", "set_aside", "shared_dir", "slices", "stored", "table", "text_or_empty", "whole_groups"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that are joined by broadcast at most: those that hold more than this share of all rows.
HEAVY = 1000


def class_counts(classes: DataFrame) -> tuple[int, int]:
    return tuple(classes.agg(F.sum("n"), F.max("n")).first())


def join_classes(rows: DataFrame, classes: DataFrame, key: str | list[str], how: str = "inner", sparse: str | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """``rows`` with the columns of ``classes``, which has one row a ``key`` and, in ``n``, how many rows hold it.

    A key with more than a thousandth of all rows is joined by broadcast, so its rows stay where they
    are; as the counts add up to the rows there are under a thousand of those. All others shuffle.
    ``how``: inner, or left for rows whose key has no class; rows without a key have none. With left,
    classes whose ``sparse`` column is null are as good as none. ``counts``: sum and maximum of ``n``
    where they are known. Both frames are read more than once, so they should be stored.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = counts or class_counts(classes)
    some = F.lit(True) if sparse is None else F.col(sparse).isNotNull()
    if not total or most * HEAVY <= total:
        return rows.join(classes.where(some).drop("n"), keys, how)
    often = F.col("n") * HEAVY > total
    heavy, light = F.broadcast(classes.where(often).drop("n")), classes.where(~often & some).drop("n")
    far = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return far.unionByName(rows.join(heavy, keys))


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Batches that come in the order of ``column`` as tables of about ``rows`` rows that part no value of it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held, n = [*held, batch], n + batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        own = table.column(column).to_numpy()
        last = int(np.searchsorted(own, own[-1]))  # the last value may go on
        if last:
            yield table.slice(0, last)
        held, n = table.slice(last).to_batches(), len(own) - last
    if n:
        yield pa.Table.from_batches(held)


#: Rows that a Python task holds as objects at once.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, without copying; at the end the worker gives its free memory back.

    Workers are used again by later tasks, so what their allocators keep would add up on an executor.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def set_aside(docs: DataFrame, *apart: str) -> tuple[Column, Callable[[dict[str, Column]], list[Column]]]:
    """(``rest``: all columns but ``apart`` as one struct, its fields named by place; what turns it back).

    So no column of ``docs`` can clash with a name that an operator uses. The second is a function of
    the columns set ``apart`` that gives all columns of ``docs``, in order.
    """
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    place = {c: f"f{i}" for i, c in enumerate(c for c in docs.columns if c not in apart)}
    rest = F.struct(F.lit(True).alias("f"), *[F.col(quoted(c)).alias(f) for c, f in place.items()]).alias("rest")
    return rest, lambda given: [(given[c] if c in given else F.col(f"rest.{place[c]}")).alias(c) for c in docs.columns]
