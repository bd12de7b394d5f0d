"""Query plans, weighted reciprocal-rank fusion, boosts, deduplication and final ranking."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, heading_tokens, path_tokens, query_terms, squash

RRF_K, CANDIDATES, FINAL = 10, 30, 10


def check_limit(name: str, value: float) -> int:
    if not math.isfinite(value) or value < 1:
        raise ValueError(f"{name} must be at least 1")
    return int(value)


def limits(k: float | None = None, per_retriever: float = 30, candidates: float = CANDIDATES, final: float = FINAL) -> tuple[int, int, int]:
    """(per retriever, candidates, final); asking for ``k`` raises the first two to it."""
    per, cand, last = (check_limit(n, v) for n, v in (("perRetrieverK", per_retriever), ("candidateK", candidates), ("finalK", final if k is None else k)))
    return max(per, last if k is not None else per), max(cand, last if k is not None else cand), last


def check_weight(name: str, value: float) -> float:
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be finite and not negative")
    return float(value)


def normal_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query) with white space squashed; blank queries go."""
    return queries.withColumn("query", squash(F.col("query"))).where("query <> ''")


def passthrough(queries: DataFrame) -> DataFrame:
    """One original variation per arm: (query_id, arm, variation_id, ord, text, weight)."""
    arms = F.explode(F.array(F.lit("lexical"), F.lit("semantic")))
    return queries.select("query_id", arms.alias("arm"), F.lit("original").alias("variation_id"), F.lit(0).alias("ord"), F.col("query").alias("text"), F.lit(1.0).alias("weight"))


def normal_plan(variations: DataFrame, queries: DataFrame) -> DataFrame:
    """Variations (query_id, arm, variation_id, ord, text, weight) made regular.

    Invalid ones go; the original (by id or equal text) comes first with weight 1 and the query's own
    text; of expansions with one id the last counts, at the first one's place; expansions that weigh
    more than the original together are scaled down to it.
    """
    valid = variations.where(F.coalesce((F.trim("variation_id") != "") & (F.trim("text") != "") & (F.col("weight") > 0) & (F.col("weight") < float("inf")), F.lit(False))).join(queries, "query_id")
    valid = valid.withColumn("is_original", (F.col("variation_id") == "original") | (canonical(F.col("text")) == canonical(F.col("query"))))
    first = F.row_number().over(Window.partitionBy("query_id", "arm", "is_original").orderBy("ord"))
    expansions = valid.withColumn("n", first).where(~F.col("is_original") | (F.col("n") > 1))
    unique = expansions.groupBy("query_id", "arm", "variation_id").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"), F.max_by("weight", "ord").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("query_id", "arm"))
    scaled = unique.select("query_id", "arm", "variation_id", (F.row_number().over(Window.partitionBy("query_id", "arm").orderBy("ord"))).alias("ord"), squash(F.col("text")).alias("text"), (F.col("weight") * F.least(F.lit(1.0), 1 / total)).alias("weight"))
    return passthrough(queries).unionByName(scaled)


def planned(queries: DataFrame, planner: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str | None]:
    """(variations, fallback): the planner's, made regular; if it fails, passthrough and the kind of error."""
    if planner is None:
        return passthrough(queries), None
    try:
        return normal_plan(planner(queries), queries), None
    except Exception as error:  # a planner is foreign code: its failure must not stop the search
        return passthrough(queries), f"planner_error:{type(error).__name__}"


def fuse(hits: DataFrame, k: float = RRF_K, candidates: int = CANDIDATES) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, list_idx, retriever, weight, chunk_id, rank).

    (query_id, chunk_id, score, fused_rank, retrievers, contributions): the score is the sum of
    weight / (k + rank); ties go to the chunk seen first, in the order of lists and ranks.
    """
    if not math.isfinite(k) or k < 0:
        raise ValueError("k must be finite and not negative")
    check_limit("candidates", candidates)
    each = F.col("weight") / (F.lit(float(k)) + F.col("rank"))
    seen = F.struct("list_idx", "rank")
    fused = hits.where("weight > 0").groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_list(F.struct("list_idx", "rank", "retriever", "weight", each.alias("part")))).alias("contributions"), F.min(seen).alias("first_seen")
    )
    fused = fused.withColumn("score", F.round(F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["part"]), 12)).withColumn("retrievers", F.array_distinct(F.transform("contributions", lambda c: c["retriever"])))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", "chunk_id"))
    return fused.withColumn("fused_rank", rank).where(F.col("fused_rank") <= candidates).select("query_id", "chunk_id", "score", "fused_rank", "retrievers", "contributions")


def unnamed_lists(hits: DataFrame) -> DataFrame:
    """Lists without weight or retriever: weight 1, and the retriever of their first hit."""
    first = F.first("hit_retriever", ignorenulls=True).over(Window.partitionBy("query_id", "list_idx").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("retriever", F.coalesce("retriever", first))


def haystack(snippet: Column, headings: Column, title: Column, path: Column) -> Column:
    """Text in which the tie-break looks for terms."""
    return F.lower(F.concat_ws(" ", snippet, F.array_join(headings, " "), title, F.regexp_replace(path, r"[/_\-.]+", " ")))


def lexical_tie_break(fused: DataFrame) -> DataFrame:
    """(…, query, haystack) renumbered: among equal scores by share of distinct terms, then their number, then as before."""
    terms = query_terms(F.col("query"))
    there = F.size(F.filter(terms, lambda t: F.contains(F.col("haystack"), t))) / F.greatest(F.size(terms), F.lit(1))
    often = F.aggregate(terms, F.lit(0.0), lambda a, t: a + (F.length("haystack") - F.length(F.replace(F.col("haystack"), t, F.lit("")))) / F.length(t))
    rows = fused.withColumn("overlap", there).withColumn("frequency", F.round(often).cast("int"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("overlap"), F.desc("frequency"), "fused_rank"))
    return rows.withColumn("fused_rank", rank)


def _share(terms: Column, tokens: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, tokens)) / F.size(terms)).otherwise(F.lit(0.0))


def boosted(fused: DataFrame, path_factor: float = 2.0, heading_factor: float = 1.0) -> DataFrame:
    """(…, query, path, heading_path, score, fused_rank) with path_score, final_score and position.

    Two stable sorts in a row amount to one by final score, path score and fused rank.
    """
    terms = query_terms(F.col("query"))
    by_path = F.col("score") * (1 + (_share(terms, path_tokens(F.col("path"))) * path_factor if path_factor > 0 else F.lit(0.0)))
    rows = fused.withColumn("path_score", F.round(by_path, 12)).withColumn("path_match", _share(terms, path_tokens(F.col("path")))).withColumn("heading_match", _share(terms, heading_tokens(F.col("heading_path"))))
    by_heading = F.col("path_score") * (1 + (_share(terms, heading_tokens(F.col("heading_path"))) * heading_factor if heading_factor > 0 else F.lit(0.0)))
    rows = rows.withColumn("final_score", F.round(by_heading, 12))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("path_score"), "fused_rank")))


def first_of(rows: DataFrame, *by: str, order: str = "position") -> DataFrame:
    """The first row of each (query, by...)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", *by).orderBy(order))).where("_n = 1").drop("_n")


def final_top(rows: DataFrame, k: int = FINAL, order: str = "position") -> DataFrame:
    """The ``k`` first rows of each query, ranked from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).where(F.col("rank") <= k)


def reranked(candidates: DataFrame, rerank: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str | None]:
    """Candidates in the reranker's order: (query_id, chunk_id, rerank_pos, final_score?) by ``rerank``.

    Unknown ids and repeats go, what the reranker left out follows in the old order; a failing
    reranker leaves everything as it was and says so.
    """
    if rerank is None:
        return candidates, None
    try:
        given = rerank(candidates)
        given.schema  # noqa: B018  analysis errors show here
    except Exception as error:  # foreign code again
        return candidates, f"reranker_error:{type(error).__name__}"
    given = first_of(given, "chunk_id", order="rerank_pos").select("query_id", "chunk_id", "rerank_pos", F.col("final_score").alias("new_score"))
    rows = candidates.withColumn("signaled_score", F.col("final_score")).join(given, ["query_id", "chunk_id"], "left").withColumn("final_score", F.coalesce(F.when(~F.isnan("new_score"), F.col("new_score")), F.col("final_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_pos").asc_nulls_last(), "position")
    return rows.withColumn("position", F.row_number().over(order)).drop("new_score", "rerank_pos"), None


def exact_phrase(query: Column, path: Column, headings: Column, snippet: Column) -> Column:
    """Whether the joined query terms stand in the path, a heading or the snippet."""
    phrase = F.array_join(query_terms(query), " ")
    spaced = F.lower(F.regexp_replace(path, r"[/_\-.]+", " "))
    return (phrase != "") & (F.contains(spaced, phrase) | F.exists(headings, lambda h: F.contains(canonical(h), phrase)) | F.contains(canonical(snippet), phrase))


def _ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Per query the chunk ids in order; at most ``candidates`` of them."""
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "chunk_id"))), lambda x: x["chunk_id"]).alias(name))


def trace(fused: DataFrame, boosted_rows: DataFrame | None = None, reranked_rows: DataFrame | None = None, final: DataFrame | None = None) -> DataFrame:
    """Per query: candidates, how many each retriever gave, and the ids in order: fused, and before and after reranking and in the end, where given."""
    out = fused.groupBy("query_id").agg(F.count("*").alias("candidates"), *[F.count_if(F.array_contains("retrievers", r)).alias(f"from_{r}") for r in ("bm25", "vector")])
    stages = ((fused, "fused_rank", "candidate_ids"), (boosted_rows, "position", "before_rerank_ids"), (reranked_rows, "position", "after_rerank_ids"), (final, "rank", "final_ids"))
    for rows, order, name in stages:
        if rows is not None:
            out = out.join(_ids(rows, order, name), "query_id", "left")
    return out


def signal_trace(rows: DataFrame) -> DataFrame:
    """Per candidate of the reranked ``rows`` (with ``query``, ``heading_path``, ``text``): its scores at each stage, matches and contributions."""
    signaled = F.col("signaled_score") if "signaled_score" in rows.columns else F.col("final_score")
    exact = exact_phrase(F.col("query"), F.col("path"), F.col("heading_path"), F.col("text"))
    return rows.select("query_id", "chunk_id", F.col("score").alias("retrieval_score"), signaled.alias("signaled_score"), "final_score", exact.alias("exact_match"), "path_match", "heading_match", "contributions")
