"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, dim, positives=5, negatives=3):
    own = [(i, n, [math.floor(256 * float(np.float32(x))) for x in v], lab) for n, (i, v, lab, _) in enumerate(rows) if lab is not None and i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v, lab in own:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, l2) for j, m, w, l2 in own if m != n)
        for minus, p, _, _ in [s for s in scored if s[3] == lab][:positives]:
            fits = [s for s in scored if s[3] != lab and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(i, p, r + 1, s[1], -minus, -s[0]) for r, s in enumerate(fits)]
    return sorted(out)


def made(n, dim, seed, spread=1.0, ids=None):
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(4, dim))
    x = (center[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))) * rng.lognormal(0, 0.5, size=(n, 1))
    return [(int(i if ids is None else ids[i]), [float(np.float32(c)) for c in v], int(rng.integers(0, 3)), "s") for i, v in enumerate(x)]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET_CELLS", 1)  # 64 rows a bucket
    monkeypatch.setattr(hard_negatives, "PACK_CELLS", 1)  # 16 anchors a pack
    monkeypatch.setattr(hard_negatives, "PACKS", 2)
    monkeypatch.setattr(hard_negatives, "PILOT", 40)


def mined(spark, rows):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()))


@pytest.mark.parametrize("spread", [0.2, 1.0])
def test_many_buckets_and_packs(spark, small, spread):
    rows = made(900, 6, 1, spread, ids=[k if k % 3 else 50 * k for k in range(900)])
    got = mined(spark, rows)
    assert got == brute(rows, 6) and len(got) > 1000


def test_hot_vector_ties_and_repeats(spark, small):
    rows = made(300, 4, 2)
    rows += [(1000 + i, rows[5][1], i % 2, "s") for i in range(150)] + [(50 * (1000 + i), rows[5][1], 0, "s") for i in range(8)]
    rows += [rows[0], rows[50], rows[50]]
    assert mined(spark, rows) == brute(rows, 4)


def test_defined_cases(spark):
    good = made(120, 4, 3)
    odd = [(None, [1.0] * 4, 1, ""), (150, None, 1, ""), (200, [1.0, None, 0.0, 0.0], 1, ""), (250, [1.0, float("nan"), 0.0, 0.0], 1, ""), (300, [1.0, float("inf"), 0.0, 0.0], 1, ""), (350, [1.0] * 4, None, ""), (400, [], 1, ""), (450, [1e20] * 4, 1, ""), (500, [0.0] * 4, 1, "")]
    rows = good + odd
    assert mined(spark, rows) == brute([r for r in rows if r[0] != 450], 4)
    longer = made(40, 3, 4)
    assert mined(spark, good + longer) == sorted(brute(good, 4) + brute(longer, 3))
    assert mined(spark, [(50, [1.0], 1, "")]) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_doubles_and_whole_numbers(spark):
    rows = made(200, 5, 5)
    wide = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).withColumn("label", F.col("label").cast("long"))
    assert sorted(map(tuple, hard_negatives.mine(wide, F.col("vec_id") % 50 == 0).collect())) == brute(rows, 5)


def test_lists_prune_and_lose_nothing():
    """Whatever the anchor needs, no row that reaches it is left out, and close to the top most rows are."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(2000, 8)) * rng.lognormal(0, 0.4, size=(2000, 1))).astype(np.int64)
    x = x[np.argsort(-(x**2).sum(axis=1))]
    table = pa.table({"row": np.arange(2000), "vec_id": np.arange(2000), "label": np.zeros(2000, np.int64), "vector": pa.array(x.tolist(), pa.list_(pa.int32()))})
    bucket = hard_negatives.Bucket(hard_negatives._bucket(table, 8), 8)
    left = []
    for q in x[rng.integers(0, 2000, 60)]:
        score, length = x @ q, math.sqrt((q * q).sum())
        for share in (1.0, 0.999, 0.95, 0.5, 0.01):
            need = float(np.quantile(score, share))
            some = bucket.feasible(q / length, length, need)
            kept = np.arange(2000)[some]
            assert set(np.flatnonzero(score >= need)) <= set(kept.tolist())
            left += [len(kept)] if share == 0.999 else []
    assert np.mean(left) < 600
