"""Evaluation questions from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, query string, intent string, queryClass string, relevant array<struct<path:string,chunkIds:array<string>,relevance:int>>, answerable boolean, notes string"


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, bad): cases as columns; lines that aren't JSON objects with their number. Blank lines are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line")).where(F.trim("line") != "")
    parsed = lines.select((F.col("at") + 1).alias("line_number"), F.try_parse_json("line").alias("json"), F.from_json("line", SCHEMA).alias("case"))
    cases = parsed.where("json is not null").select(F.col("case.id").alias("case_id"), "case.query", "case.intent", F.col("case.queryClass").alias("query_class"), "case.relevant", "case.answerable")
    return cases, parsed.where("json is null").select("line_number")
