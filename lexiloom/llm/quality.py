"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

A forest of shallow trees is grown over statistics of labelled texts; every path of a tree becomes
a conjunctive rule; a lasso logistic regression weighs the rules and drops most; what is left is
compiled into one Spark column expression, which scores any number of rows without Python.

Defined cases: a null text is the empty text and gets a score; null labels and ids of labels are
ignored; of repeated labels of an id the largest counts; repeated rows get the same score; without
two label values among the training rows the score is the label's frequency (0.5 if there are
none); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, slices, stored, text_or_empty

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "mark", "symbol", "exclamation", "pipe", "stop", "comma", "wide",
    "distinct_words", "top_word", "same_as_before", "distinct_lines", "line_length", "marked_words", "upper_words", "trigram_repeats",
)
#: Training uses at most so many labelled rows, the ones of smallest hash; the model is small and more rows don't change it.
MAX_TRAIN_ROWS = 100_000
TRAIN_PARTITIONS = 4
_MARKS = re.compile(rb"[#$%&*!|]+$")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b" "), _class(b"\n"), _class(bytes(x for x in range(33, 127) if not chr(x).isalnum())), _class(b"#$%&*@^~<>{}[]\\"), _class(b"!"), _class(b"|"), _class(b"."), _class(b","), _class(bytes(range(194, 245)))], axis=1)


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for a whole text, in one pass over bytes and one over words."""
    data = text.encode()
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES / n
    words = data.split()
    k = max(1, len(words))
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], words[2:]))  # noqa: B905
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), sum(map(len, words)) / k, *shares.tolist(),
        len(count) / k, max(count.values(), default=0) / k, sum(map(bytes.__eq__, words, words[1:])) / k,
        len(set(lines)) / max(1, len(lines)), float(np.log1p(len(data) / max(1, len(lines)))),
        sum(w[-1] in b"#$%&*!|" for w in words) / k, sum(map(bytes.isupper, words)) / k, 1 - len(pairs) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
    ]


def _values(texts: pa.Array) -> list[pa.Array]:
    values = np.array([statistics(x.as_py() or "") for x in texts], dtype=np.float64).reshape(-1, len(STATISTICS))
    return [pa.array(values[:, i]) for i in range(len(STATISTICS))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_values(batch.column("text"))], names=["doc_id", *STATISTICS])


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.append_column("stats", pa.StructArray.from_arrays(_values(batch.column("text")), names=list(STATISTICS)))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the statistics) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, threshold) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, within: str = "") -> Column:
        out = F.lit(True)
        for name, above, threshold in self.terms:
            value = F.col(within + name)
            out = out & (value > threshold if above else value <= threshold)
        return out


def tree_rules(debug: str) -> list[Rule]:
    """Every path from a root to an inner or outer node of the printed forest, as a rule; each once."""
    path: list[tuple[str, bool, float]] = []
    found: dict[frozenset, Rule] = {}
    for line in debug.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if m:
            depth = (len(m[1]) - 4) // 1
            path = [x for x in path if x[3] < depth] if path else []
            path.append((STATISTICS[int(m[3])], m[4] == ">", float(m[5]), depth))
            terms = tuple(x[:3] for x in path)
            found.setdefault(frozenset(terms), Rule(terms))
        elif re.match(r"\s*Tree \d+", line):
            path = []
    return list(found.values())


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, within: str = "") -> Column:
        """The model as one expression over the statistics, columns or fields of the struct ``within``."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.column(within), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(train: DataFrame, trees: int = 12, depth: int = 4, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """``train``: the statistics and ``label`` (0 or 1)."""
    seen = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return RuleModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train).select("features", F.col("label").cast("double").alias("label"), *STATISTICS).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=seed).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    fired = vectors.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")).cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    fired.unpersist()
    vectors.unpersist()
    return RuleModel(float(lasso.intercept), tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def held_out() -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, target: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) of rows that aren't held out; the smallest hashes where there are more than ``max_rows``."""
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("label")).where(~held_out())
    return wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of the rows that ``training_labels`` chooses: no more ids than its bound, so they are broadcast; no more rows either."""
    return stats.join(F.broadcast(training_labels(labels)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS).repartition(TRAIN_PARTITIONS)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Fits on the labels first."""
    stats = stored(measured(docs, key, text), "quality-statistics")
    model = fit_rules(training_rows(stats, labels))
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Only the bounded training rows are measured apart, for the fit; no row is stored on the way.
    """
    ids = F.broadcast(training_labels(labels).select("doc_id"))  # bounded, so no text is shuffled for the fit
    asked = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_semi")
    model = fit_rules(training_rows(stored(measured(asked), "quality-training"), labels))
    rest, whole = set_aside(docs, text)
    rows = docs.select(F.col(text).cast("string").alias("text"), rest)
    stats = T.StructField("stats", T.StructType([T.StructField(x, T.DoubleType()) for x in STATISTICS]))
    rows = rows.mapInArrow(_with_statistics, T.StructType([*rows.schema.fields, stats]))
    return rows.where(model.score("stats.") >= 0.5).select(*whole({text: F.col("text").cast(docs.schema[text].dataType)}))
