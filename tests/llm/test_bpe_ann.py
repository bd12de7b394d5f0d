import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexiloom.llm import ann, bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", " ", "Hello world", "it's  3\n\n o'clock \n", "日本語 😀 naïve", "a" * 5000, " " * 3000, "x \n" * 2000, "\u0301\u200b", "word, word. " * 900]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], "doc_id long, text string, blob string, chunk int, start long")


def brute(rows):
    with open(RANKS, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    out = []
    for i, t in rows:
        ids = whole.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "overlap"), [(bpe.CHUNK, bpe.OVERLAP), (64, 16), (300, 40)])
def test_codec_equals_the_library_on_whole_texts(spark, chunk, overlap):
    rng = random.Random(chunk)
    parts = ["word", "Élan", " ", "  ", "\n", "\t\n ", "12", "!?", "'s", "日本", "😀", "x" * 50, " " * 30]
    rows = [*enumerate(TEXTS), (5, TEXTS[5]), *((50 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(400)))) for i in range(60)), (200, "ab cd " * 30_000), (201, "ab cd " * 30_000)]
    found = bpe.encode_documents(docs(spark, rows).repartition(3), RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == brute(rows)
    assert bpe.encode_documents(docs(spark, []), RANKS, PATTERN).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node long, row string")


def test_search_is_exact_up_to_recall(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = ann.nearest(frame, frame["vec_id"] % 20 == 0).toPandas()
    table = frame.toPandas()
    asked = table["vec_id"][table["vec_id"] % 20 == 0]
    exact = ann.brute_force(table, asked)
    hits = found.merge(exact, on=["query_id", "vec_id"])
    assert len(hits) / len(exact) >= 0.9
    assert np.allclose(hits["score_x"], hits["score_y"], rtol=0, atol=1e-12)
    assert (found.groupby("query_id")["rank"].apply(list).map(lambda x: x == list(range(1, 21)))).all()
    assert found.sort_values(["query_id", "rank"]).groupby("query_id")["score"].apply(lambda s: (s.diff().dropna() <= 0).all()).all()


def test_recall_holds_on_plain_random_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    table = pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()})
    frame = spark.createDataFrame([(i, v, 0, "r") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, node long, row string")
    found = ann.nearest(frame, frame["vec_id"] % 100 == 0).toPandas()
    exact = ann.brute_force(table, table["vec_id"][::100])
    assert len(found.merge(exact, on=["query_id", "vec_id"])) / len(exact) >= 0.9


def test_near_equal_vectors_are_told_apart(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x[::3] = x[0] + 0.002 * rng.normal(size=(2000, 32))
    x = x.astype(np.float32)
    table = pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()})
    frame = vectors(spark, [(i, v, 0, "r") for i, v in enumerate(x.tolist())])
    found = ann.nearest(frame, frame["vec_id"] % 50 == 0).toPandas()
    exact = ann.brute_force(table, table["vec_id"][::50])
    hot = exact[exact["query_id"] % 3 == 0]
    assert len(found.merge(exact, on=["query_id", "vec_id"])) / len(exact) >= 0.9
    assert len(found.merge(hot, on=["query_id", "vec_id"])) / len(hot) >= 0.9


def test_equal_codes_do_not_hide_the_nearest():
    rng = np.random.default_rng(6)
    x = (1 + 0.002 * rng.normal(size=(1500, 8))).astype(np.float32)
    index = ann.Index(np.ones((1, 8), np.float32), np.zeros((8, 256, 1), np.float32), 1)
    own, codes = index.assign(x)
    kind = pa.list_(pa.float32())
    error = np.sqrt(((x - 1.0) ** 2).sum(1)) + 1e-4
    nodes = pa.table({"node": np.arange(1500), "vector": pa.array(x.tolist(), kind), "list": own.astype(np.int32), "codes": pa.array([c.tobytes() for c in codes]), "error": error})
    asks = pa.table({"query": np.arange(5), "vector": pa.array(x[:5].tolist(), kind)})
    found = ann._score(index, 8, 200, 21)(nodes, asks).to_pandas()
    for q in range(5):
        exact = np.lexsort((np.arange(1500), -(x.astype(np.float64) @ x[q].astype(np.float64))))[:21]
        assert set(found[found["query"] == q]["node"]) == set(exact)
    assert (index.errors(x, own, codes) >= np.sqrt(((x - 1.0) ** 2).sum(1))).all()


def test_hot_vectors_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot, 0, "r") for i in range(300)] + [(1000 + i, rng.normal(size=8).astype(np.float32).tolist(), 0, "r") for i in range(120)]
    bad = [(20_000, None, 0, "r"), (20_020, [0.0] * 8, 0, "r"), (20_040, [float("nan")] + [1.0] * 7, 0, "r"), (20_060, [None] + [1.0] * 7, 0, "r"), (20_080, [float("inf")] + [1.0] * 7, 0, "r"), (20_100, [1.0], 0, "r"), (20_120, [], 0, "r"), (None, hot, 0, "r")]
    frame = vectors(spark, rows + bad + [(40, hot, 0, "r")])
    found = ann.nearest(frame, frame["vec_id"] % 20 == 0, k=20).toPandas()
    assert set(found["query_id"]) == set(range(0, 300, 20)) | set(range(1000, 1120, 20))
    for q in range(0, 300, 20):
        own = found[found["query_id"] == q].sort_values("rank").head(20)["vec_id"].tolist()
        expected = sorted([i for i in range(300) if i != q] + [40])[:20]
        assert own == (expected if q != 40 else own)
    forty = found[found["query_id"] == 40]
    assert all(len(x) <= 20 for q, x in found[found["query_id"] != 40].groupby("query_id"))
    assert len(forty) == 40 and sorted(forty["vec_id"]) == sorted(sorted([*range(300)])[:20] * 2)


def test_vectors_of_each_length_are_compared_among_themselves(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4 + 4 * (i % 2)).astype(np.float32).tolist(), 0, "r") for i in range(90)] + [(100, [1.0], 0, "r")]
    frame = vectors(spark, rows)
    found = ann.nearest(frame, frame["vec_id"] % 5 == 0, k=50).toPandas()
    assert {(q, len(x)) for q, x in found.groupby("query_id")} == {(q, 44) for q in range(0, 90, 5)}
    assert ((found["query_id"] - found["vec_id"]) % 2 == 0).all()


def test_fewer_candidates_than_asked(spark):
    frame = vectors(spark, [(0, [1.0, 0.0], 0, "r"), (1, [0.5, 0.5], 0, "r"), (2, [0.5, -0.5], 0, "r")])
    found = ann.nearest(frame, frame["vec_id"] % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    for rows in ([], [(0, [1.0, 0.0], 0, "r")], [(0, None, 0, "r")], [(0, [0.0], 0, "r")]):
        frame = vectors(spark, rows)
        assert ann.nearest(frame, frame["vec_id"] % 20 == 0).count() == 0


def test_vectors_of_doubles(spark):
    """Scores are exact on doubles that single precision would round."""
    rng = np.random.default_rng(9)
    x = 1 + 1e-9 * rng.normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(rows, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    want = ann.brute_force(pd.DataFrame({"vec_id": range(300), "embedding": x.tolist()}), pd.Series(range(0, 300, 50)), 5)
    assert [g[:3] for g in got] == [tuple(w) for w in want[["query_id", "rank", "vec_id"]].itertuples(index=False)]
