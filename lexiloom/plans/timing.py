"""Timings as rows: what each stage of a search takes for a batch, and what each case of an evaluation takes alone."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import fusion
from ..storage import stored
from .search import Index, rank_hits, retrieve, shown

STAGES = "stage string, at int, seconds double, rows long"


def search_stages(queries: DataFrame, index: Index, settings: Settings | None = None, planner=None, embed=None, rerank=None) -> tuple[DataFrame, DataFrame]:
    """(results of ``search``, (stage, at, seconds, rows)): each stage is stored before the next begins, so the times are its own."""
    settings, took = settings or Settings(), []

    def timed(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        out = stored(make(), f"timed-{name}")
        took.append((name, len(took), time.perf_counter() - began, out.count()))
        return out

    asked = timed("queries", lambda: fusion.normal_queries(queries))
    hits = timed("retrieve", lambda: retrieve(asked, index, settings, planner, embed))
    ranked = timed("rank", lambda: rank_hits(hits, asked, index, settings, rerank))
    results = timed("show", lambda: shown(ranked))
    return results, queries.sparkSession.createDataFrame(took, STAGES)


def run_cases(cases: DataFrame, answer: Callable[[DataFrame], DataFrame], warm_ups: int = 2) -> tuple[DataFrame, DataFrame]:
    """((case_id, path, rank), (case_id, latency_ms)) of (query_id, query) cases that are asked one at a time, by id.

    ``answer`` gives (query_id, path, rank) for a frame of one query. The first cases are asked before the clock runs, to
    warm up. For question files, which people write; batches are what ``search`` is for.
    """
    session, kinds = cases.sparkSession, cases.select("query_id", "query").schema
    asked = [tuple(r) for r in cases.select("query_id", "query").orderBy("query_id").collect()]
    for one in asked[:warm_ups]:
        answer(session.createDataFrame([one], kinds)).collect()
    rows, latencies = [], []
    for one in asked:
        began = time.perf_counter()
        found = answer(session.createDataFrame([one], kinds)).select("query_id", "path", "rank").collect()
        latencies.append((one[0], (time.perf_counter() - began) * 1000))
        rows += [tuple(r) for r in found]
    kind = kinds["query_id"].dataType.simpleString()
    return session.createDataFrame(rows, f"case_id {kind}, path string, rank long"), session.createDataFrame(latencies, f"case_id {kind}, latency_ms double")
