"""A batch over chunks without a stored index gives what the index gives, and stores neither postings nor vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions.embed import hash_embedding
from lexiloom.functions.text import index_tokens
from lexiloom.operators import evidence, lexical, nearest, retrieval, scan
from lexiloom.plans import frames


@pytest.fixture()
def chunks(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["uno", "dos", "tres", "Été", "a-b", "a", "b", "rare"], rng.integers(0, 12), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.09, 0.01])) for _ in range(400)]
    rows = [(f"p/{i}#0", t) for i, t in enumerate([*texts, *["uno dos a b a b"] * 60, None, ""])]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


QUERIES = [(1, "uno uno rare"), (2, "ete? a-b nowhere"), (3, "a-b-a x-y"), (4, "nowhere"), (5, "dos tres a"), (6, "")]


@pytest.mark.parametrize("cells", [scan.CELLS, 100])
def test_bm25_without_an_index_scans(spark, chunks, monkeypatch, cells):
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    index = lexical.lexicon(chunks)
    expected = {tuple(r) for r in retrieval.bm25(asked, k=20, index=index).select("query_id", "chunk_id", "score", "rank").collect()}
    phrases = {tuple(r) for r in retrieval.phrase_hits(asked, index=index).select("query_id", "phrase", "chunk_id", "tf").collect()}
    monkeypatch.setattr(scan, "CELLS", cells)  # 100: slices of 16 chunks
    monkeypatch.setattr(lexical, "lexicon", lambda *a: pytest.fail("built an index for one batch"))
    assert {tuple(r) for r in retrieval.bm25(asked, chunks, 20).select("query_id", "chunk_id", "score", "rank").collect()} == expected
    assert {tuple(r) for r in retrieval.phrase_hits(asked, chunks).select("query_id", "phrase", "chunk_id", "tf").collect()} == phrases
    assert {q for q, *_ in expected} == {1, 2, 3, 5}


def test_a_batch_too_wide_for_a_scan_is_indexed(spark, chunks, monkeypatch):
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    expected = retrieval.bm25(asked, chunks, 20).collect()
    monkeypatch.setattr(scan, "BROADCAST_ROWS", 3)
    assert scan.asked_units(asked) is None
    assert sorted(retrieval.bm25(asked, chunks, 20).select(*expected[0].asDict()).collect()) == sorted(expected)


def test_line_index_stores_chunks_only(spark, sf_dir):
    index = frames.line_index(spark, sf_dir)
    assert index.lexicon is None and index.blocks is None


def test_nearest_without_an_index_stores_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "vector_index", lambda *a: pytest.fail("stored vectors for one batch"))
    vectors = spark.range(50).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.when(F.col("id") != 7, hash_embedding(F.col("id").cast("string"), 20)).alias("embedding"))
    found = nearest.nearest(vectors.where("chunk_id = 'c3'").withColumnRenamed("chunk_id", "query_id"), vectors, 60)
    assert found.count() == 49 and found.where("rank = 1").first().chunk_id == "c3"


def test_blocks_of_long_vectors_are_bounded(spark):
    """Of 384 components a block of 2,048 vectors was 6 MB, and a task reads many at once."""
    vectors = spark.range(900, numPartitions=1).select(F.col("id").alias("chunk_id"), F.array_repeat(F.col("id").cast("double"), 384).alias("embedding"))
    sizes = [r.n for r in nearest.vector_index(vectors).blocks.select("n").collect()]
    assert sum(sizes) == 900 and max(sizes) * 384 <= nearest.BLOCK_CELLS


def test_tokens_are_the_same_with_and_without_accents(spark):
    got = spark.createDataFrame([("Plain OLD x_1",), ("Été ñandú İx",), (None,)], "t string").select(index_tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in got][::2] == [["plain", "old", "x", "1"], None] and got[1].w[:2] == ["ete", "nandu"]


def test_allowed_chunks_are_met_by_candidates_only(spark):
    rows = spark.createDataFrame([(1, "a", "one two", 1), (1, "b", "three", 2)], "query_id int, chunk_id string, snippet string, rank int")
    allowed = spark.createDataFrame([("a",), ("a",), ("z",)], "chunk_id string")
    assert [r.chunk_id for r in evidence.selected(rows, 50, allowed=allowed).collect()] == ["a"]
