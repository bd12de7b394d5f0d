"""Retrieval quality: recall, reciprocal rank, nDCG, rates, summaries, comparison and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("exact", "semantic", "ambiguous", "multi_document", "contradictory", "unanswerable")
CUTS, NDCG_CUTS, TOLERANCE = (1, 5, 10), (5, 10), 0.02
METRICS = ("recall_1", "recall_5", "recall_10", "candidate_recall", "mrr", "ndcg_5", "ndcg_10", "empty_rate", "wrong_source_rate")
LATENCIES = ("p50", "p95", "max")


def rounded(value: Column) -> Column:
    return F.round(value, 6)


def distinct_paths(ranked: DataFrame, k: int) -> DataFrame:
    """(case_id, path, rank): results (case_id, path, rank) with each path once, renumbered, cut to ``k``."""
    from pyspark.sql import Window

    first = ranked.groupBy("case_id", "path").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "path"))
    return first.withColumn("rank", n).where(F.col("rank") <= k)


def case_results(cases: DataFrame, judged: DataFrame, ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per case (case_id, query_class, answerable).

    ``judged``: (case_id, path, relevance), ``ranked`` and ``candidates``: (case_id, path, rank) with
    distinct paths. Metrics of unanswerable cases are null, but for the rates.
    """
    graded = judged.groupBy("case_id", "relevance").agg(F.count("*").alias("sources"))
    hits = candidates.join(judged, ["case_id", "path"]).select("case_id", "path", "relevance", "rank")
    return graded_results(cases, graded, hits, ranked)


def graded_results(cases: DataFrame, graded: DataFrame, hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """The same from counts: how many relevant sources a case has need not be listed.

    ``graded``: (case_id, relevance, sources), how many of each grade there are; ``hits``: (case_id, path,
    relevance, rank), the candidates that are relevant; ``ranked``: (case_id, path, rank), what is shown.
    """
    from pyspark.sql import Window

    gain = lambda rank: (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(rank + 1)
    total = graded.groupBy("case_id").agg(F.sum("sources").alias("sources"))
    # The best order lists the grades from the top; a cut holds so many of them.
    above = F.coalesce(F.sum("sources").over(Window.partitionBy("case_id").orderBy(F.desc("relevance")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = graded.where("sources > 0").withColumn("above", above).where(F.col("above") < max(NDCG_CUTS))
    places = places.select("case_id", "relevance", F.explode(F.sequence(F.col("above") + 1, F.least(F.col("above") + F.col("sources"), F.lit(max(NDCG_CUTS))))).alias("ideal"))
    best = places.groupBy("case_id").agg(*[F.sum(F.when(F.col("ideal") <= k, gain(F.col("ideal")))).alias(f"best_{k}") for k in NDCG_CUTS])
    shown = ranked.groupBy("case_id").agg(F.count("*").alias("results"))
    seen = hits.withColumnRenamed("rank", "candidate").join(ranked, ["case_id", "path"], "left")
    per = seen.groupBy("case_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in CUTS], F.count("*").alias("found"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"), F.bool_or(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("top_is_relevant"),
        *[F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias(f"gain_{k}") for k in NDCG_CUTS],
    )
    joined = cases.join(total, "case_id", "left").join(best, "case_id", "left").join(per, "case_id", "left").join(shown, "case_id", "left").withColumn("results", F.coalesce("results", F.lit(0)))
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(whole, F.lit(0)), F.lit(0.0))
    values = {f"recall_{k}": share(f"found_{k}", F.col("sources")) for k in CUTS} | {"candidate_recall": share("found", F.col("sources")), "mrr": F.coalesce("mrr", F.lit(0.0))} | {f"ndcg_{k}": share(f"gain_{k}", F.col(f"best_{k}")) for k in NDCG_CUTS}
    wrong = F.when(F.col("answerable"), (F.col("results") > 0) & ~F.coalesce("top_is_relevant", F.lit(False))).otherwise(F.col("results") > 0)
    return joined.select("case_id", "query_class", "answerable", *[rounded(F.when(F.col("answerable"), v)).alias(n) for n, v in values.items()], (F.col("results") == 0).alias("empty"), wrong.alias("wrong_source"))


def _summary() -> list[Column]:
    # The metrics have six digits already: summed as whole millionths, so that no order of additions matters.
    means = [rounded(F.sum(F.round(F.col(n) * 1e6).cast("long")) / F.count(n) / 1e6).alias(n) for n in METRICS[:7]]
    return [F.count("case_id").alias("cases"), *means, rounded(F.avg(F.col("empty").cast("double"))).alias("empty_rate"), rounded(F.avg(F.col("wrong_source").cast("double"))).alias("wrong_source_rate")]


def summary(results: DataFrame) -> DataFrame:
    return results.agg(*_summary())


def class_summary(results: DataFrame) -> DataFrame:
    """The same by query class, classes without cases included."""
    classes = results.sparkSession.createDataFrame([(c,) for c in CLASSES], "query_class string")
    return classes.join(results, "query_class", "left").groupBy("query_class").agg(*_summary())


def latency(times: DataFrame, column: str = "ms") -> DataFrame:
    """(p50, p95, max): nearest-rank percentiles."""
    return times.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"), F.max(column).alias("max"))


def compare(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Differences after - before of summaries, and of latencies (p50, p95, max) where both have them; null where either is."""
    names = [*METRICS, *(c for c in LATENCIES if c in before.columns and c in after.columns)]
    b = before.select(*on, *[F.col(m).alias(f"b_{m}") for m in names])
    joined = after.join(b, on) if on else after.crossJoin(b)  # summaries: one row each
    return joined.select(*on, *[rounded(F.col(m) - F.col(f"b_{m}")).alias(m) for m in names])


def regressions(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(query_class, recall_5): the classes, and ``overall``, whose recall@5 fell by more than ``tolerance``.

    ``before`` and ``after``: results of cases, as ``case_results`` gives them.
    """
    own = lambda r: class_summary(r).unionByName(summary(r).withColumn("query_class", F.lit("overall")))
    return compare(own(before), own(after), ["query_class"]).where(F.col("recall_5") < -tolerance).select("query_class", "recall_5")


def comparable(before: DataFrame, after: DataFrame) -> DataFrame:
    """(problem,) of two runs (corpus_hash, questions_hash), a row each: runs over other documents or questions can't be compared."""
    b = before.select(F.col("corpus_hash").alias("b_corpus"), F.col("questions_hash").alias("b_questions"))
    both = after.select("corpus_hash", "questions_hash").crossJoin(b)  # one row each
    same = lambda a, c, what: F.when(~F.col(a).eqNullSafe(F.col(c)), what)
    return both.select(F.explode(F.array_compact(F.array(same("corpus_hash", "b_corpus", "another corpus"), same("questions_hash", "b_questions", "other questions")))).alias("problem"))


def violations(cases: DataFrame) -> DataFrame:
    """(case_id, problem) of cases (case_id, query, query_class, answerable, relevant: array of (path, relevance))."""
    n = F.coalesce(F.size("relevant"), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    one_row = F.array_compact(
        F.array(
            F.when(blank(F.col("case_id")), "invalid id"), F.when(blank(F.col("query")), "invalid query"), F.when(~F.coalesce(F.col("query_class").isin(*CLASSES), F.lit(False)), "invalid class"),
            F.when(F.col("answerable") & (n == 0), "answerable without sources"), F.when(~F.col("answerable") & (n > 0), "unanswerable with sources"),
            F.when((n > 0) & F.exists("relevant", lambda r: blank(r["path"])), "judgment without path"), F.when(n > F.size(F.array_distinct(F.transform("relevant", lambda r: r["path"]))), "repeated path"),
            F.when((n > 0) & F.exists("relevant", lambda r: ~r["relevance"].isin(1, 2, 3)), "invalid relevance"),
        )
    )
    repeated = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate id").alias("problem"))
    return cases.select("case_id", F.explode(one_row).alias("problem")).unionByName(repeated)
