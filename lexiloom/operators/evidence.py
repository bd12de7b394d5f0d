"""Evidence packages: passages within a token budget, with citations, conflicts and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, fit_text, squash
from .lexical import small


#: What a passage tells besides its text, where its candidate has it: where it stands, and the signals of its ranking.
SIGNALS = ("path", "heading_path", "score", "retrievers", "retrieval_score", "reranker_score")


def selected(candidates: DataFrame, budget: int, max_passages: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, snippet, rank) cut to passages: citation_id, text, tokens, and the candidate's ``SIGNALS``.

    Only allowed chunks, each once, in order; a blank snippet ends the selection; the passage that
    crosses the budget is cut to what is left.
    """
    rows = candidates
    if allowed is not None:  # of the allowed ones only those that are candidates are told apart
        met = allowed.join(small(candidates.select("chunk_id").distinct()), "chunk_id", "left_semi")
        rows = candidates.join(met.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("n = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= max_passages)
    before = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("need", estimate_tokens(F.col("snippet")))
    rows = rows.withColumn("used", F.coalesce(F.sum("need").over(before), F.lit(0))).withColumn("ended", F.coalesce(F.bool_or(F.col("need") == 0).over(before), F.lit(False)) | (F.col("need") == 0))
    rows = rows.where(~F.col("ended") & (F.col("used") < budget)).withColumn("text", fit_text(F.col("snippet"), F.least(F.lit(budget) - F.col("used"), F.col("need"))))
    return rows.where("text <> ''").select("query_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("citation_id"), "chunk_id", "rank", "text", estimate_tokens(F.col("text")).alias("tokens"), *[c for c in SIGNALS if c in candidates.columns])


def conflicts(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, conflict_id, passage_ids): claims (query_id, conflict_id, chunk_id) that more than one passage carries."""
    met = claims.join(passages.select("query_id", "chunk_id", "citation_id"), ["query_id", "chunk_id"]).groupBy("query_id", "conflict_id").agg(F.sort_array(F.collect_set("citation_id")).alias("passage_ids"))
    return met.where(F.size("passage_ids") > 1)


def gaps(rows: DataFrame) -> DataFrame:
    """(query_id, gap): notes on what is missing, white space squashed, each once, none blank."""
    return rows.select("query_id", squash(F.col("gap")).alias("gap")).where("gap <> ''").distinct()


def totals(passages: DataFrame) -> DataFrame:
    return passages.groupBy("query_id").agg(F.count("*").alias("passages"), F.sum("tokens").alias("tokens"))
