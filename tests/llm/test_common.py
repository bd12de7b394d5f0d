import random

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [0, 400])
def test_join_by_class_equals_a_plain_join(spark, how, hot):
    rng = random.Random(hot)
    keys = [rng.randrange(2000) for _ in range(3000)] + [7] * hot + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long")
    counts = rows.where("k % 3 <> 0").groupBy("k").agg(F.count("*").alias("n"))
    classes = counts.select("k", "n", (F.col("k") * 2).alias("twice"))
    found = sorted(map(tuple, common.join_classes(rows, classes, "k", how).select("id", "k", "twice").collect()))
    known = [(i, k, None if k is None or k % 3 == 0 else 2 * k) for i, k in enumerate(keys)]
    assert found == sorted(x for x in known if how == "left" or x[2] is not None)
    assert common.join_classes(rows, classes.limit(0), "k", how).count() == (len(keys) if how == "left" else 0)


def test_stored_frames_are_replaced_and_forgotten(spark):
    first = common.stored(spark.range(5).toDF("x"), "frame")
    second = common.stored(first.where("x > 1"), "frame", instead=first)
    path, store = common.hadoop_path(spark, first.stored_at)
    assert second.count() == 3 and not store.exists(path)
    common.forget(second)
    assert not store.exists(common.hadoop_path(spark, second.stored_at)[0])


def test_all_columns_come_back_whatever_their_names(spark):
    docs = spark.createDataFrame([(1, "t", 2, "q", 3.0)], "doc_id long, text string, rest int, `a.b` string, f0 double")
    rest, whole = common.set_aside(docs, "text")
    out = docs.select("text", rest).select(*whole({"text": F.upper("text")}))
    assert out.schema.simpleString() == docs.schema.simpleString() and tuple(out.first()) == (1, "T", 2, "q", 3.0)
