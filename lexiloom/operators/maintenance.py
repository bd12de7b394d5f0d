"""Incremental maintenance of the index tables: what changed, what goes, history, embedder changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

HISTORY_KEEP, HISTORY_LIMIT = 50, 10


def changes(manifest: DataFrame, walk: DataFrame) -> DataFrame:
    """(path, action, sha256): each path is indexed, skipped or deleted. One outer join of (path, sha256) tables."""
    old = manifest.select("path", F.col("sha256").alias("old"), F.lit(True).alias("known"))
    new = walk.select("path", F.col("sha256").alias("new"), F.lit(True).alias("seen"))
    both = old.join(new, "path", "full_outer")
    action = F.when(F.col("seen").isNull(), "deleted").when(F.col("known") & F.col("old").eqNullSafe(F.col("new")), "skipped").otherwise("indexed")
    return both.select("path", action.alias("action"), F.col("new").alias("sha256"))


def to_index(manifest: DataFrame, walk: DataFrame) -> DataFrame:
    """Rows of ``walk`` whose content the manifest doesn't know."""
    return walk.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_anti")


def to_delete(manifest: DataFrame, walk: DataFrame) -> DataFrame:
    return manifest.join(walk.select("path"), "path", "left_anti")


def index_counts(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(files_indexed, files_skipped, files_deleted, chunks_added)."""
    counts = changed.agg(*[F.count_if(F.col("action") == a).alias(f"files_{a}") for a in ("indexed", "skipped", "deleted")])
    added = chunks.join(changed.where("action = 'indexed'").select("path"), "path", "left_semi").agg(F.count("*").alias("chunks_added"))
    return counts.crossJoin(added)  # one row each


def manifest_of(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, sha256, chunk_count): pages without text stay, with zero chunks."""
    counted = chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))
    return pages.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).join(counted, "path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def upsert(table: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``table`` with all rows of the keys in ``new`` replaced by it."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def split_errors(parsed: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, (path, error)): a failing file is reported and keeps its old index."""
    return parsed.where(F.col(error).isNull()).drop(error), parsed.where(F.col(error).isNotNull()).select("path", error)


def embedder_state(meta: DataFrame, model: str, dim: int) -> DataFrame:
    """(changed, previous): from (key, value) rows; an index that names no model adopts this one."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    known = meta.agg(value("embedder_model").alias("previous"), value("embedder_dim").alias("dim"))
    changed = F.col("previous").isNotNull() & ((F.col("previous") != model) | (F.coalesce(F.col("dim").cast("int"), F.lit(dim)) != dim))
    return known.select(changed.alias("changed"), "previous")


def vector_dim(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.max(F.size("embedding")).alias("dim"))


def history_rows(pages: DataFrame, written_at: Column, first_id: int = 1) -> DataFrame:
    """Snapshots (id, path, sha256, body, frontmatter, byte_size, written_at) of (path, text, frontmatter?) to append; ids in order of time and path.

    Ids are numbered per range partition, so no task sorts the whole history.
    """
    frontmatter = F.col("frontmatter") if "frontmatter" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").alias("body"), frontmatter.alias("frontmatter"), F.octet_length("text").alias("byte_size"), written_at.alias("written_at"))
    # Stored before anything is counted: a range exchange that runs again may deal its rows otherwise.
    sorted_ = rows.repartitionByRange("written_at", "path").sortWithinPartitions("written_at", "path")
    placed = stored(sorted_.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "history-parts")
    counted = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("part", (before + first_id - F.col("first_at")).alias("start"))
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).cast("long").alias("id"), "path", "sha256", "body", "frontmatter", "byte_size", "written_at")


def newest(history: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """The ``keep`` newest rows of each path."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("written_at"), F.desc("id")))
    return history.withColumn("n", n).where(F.col("n") <= max(1, keep)).drop("n")


def history_of(history: DataFrame, path: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    return history.where(F.col("path") == path).orderBy(F.desc("written_at"), F.desc("id")).limit(max(1, min(100, limit)))


def under_folder(paths: DataFrame, folder: str) -> DataFrame:
    """Rows at or below a folder."""
    return paths.where((F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/"))


def moved(pages: DataFrame, old: str, new: str) -> DataFrame:
    """Paths at or below ``old`` renamed to ``new``."""
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return pages.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))).otherwise(F.col("path")))
