"""Incremental secret scan over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which
paths held which blob in which version, which (blob, rule version) pairs have been scanned, and what
was found; a run scans each unseen pair once, appends it, and the report joins the findings back to
all paths and versions that ever held the blob.

Defined cases: a null text is the empty text; empty texts have no findings; repeated rows and equal
texts share one scan and each row gets the findings; null ids are kept; an empty table gives no
rows; columns besides the named ones are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hadoop_path, join_classes, shared_dir, slices, stored, text_or_empty

KINDS = ("assign", "access", "hex")
#: Changes whenever a pattern or a length below does: blobs are then scanned anew.
RULE_VERSION = "base-1"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run of one class starts at its first character, so asking for the least length in the pattern drops the same runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

FINDINGS = "blob_id string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
VERSIONS = "path string, version long, blob_id string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def span_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [find_spans(x) for x in batch.column("text").to_pylist()]
        joined = [span_string(x) for x in rows]
        counts = [[sum(kind == k for _, kind, _ in x) for x in rows] for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob_id"), pa.array([RULE_VERSION] * len(rows), pa.string()), *(pa.array(x, pa.int64()) for x in counts), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array(joined, pa.string()), batch.column("n")],
            names=["blob_id", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n"],
        )


def address(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``blob_id``, the address of its text."""
    return docs.withColumn("blob_id", F.sha2(text_or_empty(text).cast("binary"), 256))


def unseen_findings(docs: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Scan every blob of ``docs`` that is not among the ``known`` (blob_id); a row each, with the rows ``n`` that hold it."""
    own = docs.select(text_or_empty(text).alias("text")).withColumn("blob_id", F.sha2(F.col("text").cast("binary"), 256))
    # copies meet map-side first, so a blob that a third of the rows share moves once per task
    blobs = own.groupBy("blob_id").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    if known is not None:
        blobs = blobs.join(known.select("blob_id"), "blob_id", "left_anti")
    return blobs.select("blob_id", "text", "n").mapInArrow(_scan, f"{FINDINGS}, n long").withColumn("rule_version", F.lit(RULE_VERSION))


class BlobLedger:
    """Append-only Parquet tables in a folder that all executors share.

    ``findings`` holds a row per scanned blob, below a folder per rule version; ``versions`` holds
    (path, version, blob_id) of every row ever handed in. With ``keep_texts`` each blob's text is kept once, in
    ``texts``, so that a new rule version can scan all history (``rescan``) without being handed it again. Each run appends a folder to both, which
    counts once Spark has marked it complete: a run that is lost or repeated leaves nothing that is
    read, and no pair is ever there twice. One run writes at a time.
    """

    def __init__(self, spark, path: str | None = None, keep_texts: bool = False):
        self.keep_texts = keep_texts
        self.spark, self.path = spark, (path or f"{shared_dir(spark)}/secret-ledger").rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame | None:
        folder, store = hadoop_path(self.spark, f"{self.path}/{table}")
        if not store.exists(folder):
            return None
        runs = [s.getPath().toString() for s in store.listStatus(folder)]
        done = [r for r in runs if store.exists(hadoop_path(self.spark, f"{r}/_SUCCESS")[0])]
        return self.spark.read.schema(schema).parquet(*done) if done else None

    def findings(self) -> DataFrame | None:
        """What was found in every blob that the current rules have seen."""
        return self._read(f"findings/{RULE_VERSION}", FINDINGS)

    def all_findings(self) -> DataFrame | None:
        """Of every blob ever scanned what the current rules found, or else those that scanned it last."""
        folder, store = hadoop_path(self.spark, f"{self.path}/findings")
        if not store.exists(folder):
            return None
        seen = sorted(((s.getModificationTime(), s.getPath().getName()) for s in store.listStatus(folder)), key=lambda x: (x[1] == RULE_VERSION, x))
        parts = [(at, found) for at, (_, name) in enumerate(seen) if (found := self._read(f"findings/{name}", FINDINGS)) is not None]
        if len(parts) < 2:
            return parts[0][1] if parts else None
        every = functools.reduce(DataFrame.unionByName, [found.withColumn("at", F.lit(at)) for at, found in parts])
        return every.groupBy("blob_id").agg(F.max_by(F.struct(*[c for c in every.columns if c not in ("blob_id", "at")]), "at").alias("x")).select("blob_id", "x.*")

    def pending(self) -> DataFrame | None:
        """(blob_id) of all history that the current rules haven't scanned."""
        versions, found = self.versions(), self.findings()
        if versions is None:
            return None
        blobs = versions.select("blob_id").distinct()
        return blobs if found is None else blobs.join(found.select("blob_id"), "blob_id", "left_anti")

    def rescan(self) -> int:
        """Scan every pending blob from its kept text; returns how many."""
        texts, pending = self._read("texts", "blob_id string, text string"), self.pending()
        if texts is None or pending is None:
            return 0
        run = f"{self.path}/findings/{RULE_VERSION}/{uuid.uuid4().hex}"
        # a text kept by two runs is scanned once
        own = texts.join(pending, "blob_id", "left_semi").groupBy("blob_id").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        own.select("blob_id", "text", "n").mapInArrow(_scan, f"{FINDINGS}, n long").drop("n").withColumn("rule_version", F.lit(RULE_VERSION)).write.parquet(run)
        return self.spark.read.schema(FINDINGS).parquet(run).count()

    def versions(self) -> DataFrame | None:
        return self._read("versions", VERSIONS)

    def scan(self, docs: DataFrame, key: str = "doc_id", text: str = "text", version: int = 0) -> int:
        """Record what every path ``key`` holds in ``version`` and scan the blobs not seen yet; returns their number."""
        run = uuid.uuid4().hex
        found = unseen_findings(docs, text, self.findings()).drop("n")
        found.write.parquet(f"{self.path}/findings/{RULE_VERSION}/{run}")
        if self.keep_texts:
            kept, new = self._read("texts", "blob_id string, text string"), address(docs.select(text_or_empty(text).alias("text"))).groupBy("blob_id").agg(F.first("text").alias("text"))
            (new if kept is None else new.join(kept.select("blob_id"), "blob_id", "left_anti")).write.parquet(f"{self.path}/texts/{run}")
        held = address(docs, text).select(F.col(key).cast("string").alias("path"), F.lit(version).cast("long").alias("version"), "blob_id")
        held.write.parquet(f"{self.path}/versions/{run}")
        return self.spark.read.schema(FINDINGS).parquet(f"{self.path}/findings/{RULE_VERSION}/{run}").count()

    def report(self) -> DataFrame:
        """One row per (path, version) ever handed in, with the findings of its blob and the rule version that they are of."""
        versions, found = self.versions(), self.all_findings()
        if versions is None or found is None:
            return self.spark.createDataFrame([], f"path string, version long, {FINDINGS}")
        classes = stored(found.join(versions.groupBy("blob_id").agg(F.count("*").alias("n")), "blob_id"), "secret-classes")
        return join_classes(versions, classes, "blob_id").select("path", "version", *classes.drop("n").columns)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span of a span string, overlapping ones merged, replaced by ``mark``."""
    places = F.transform(F.split(spans, ","), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        between = F.concat(done["out"], F.substr(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.when(span["start"] >= done["at"], between).otherwise(done["out"]).alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    return F.aggregate(places, start, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1)))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by a mark; rows without one are unchanged. ``n_chars``, where there, follows."""
    found = stored(unseen_findings(docs, text).select("blob_id", F.nullif("spans", F.lit("")).alias("spans"), "n"), "secret-spans")
    own = docs.select(F.struct("*").alias("row"), F.sha2(text_or_empty(text).cast("binary"), 256).alias("blob_id"))
    before = F.col("row").getField(text)
    joined = join_classes(own, found, "blob_id").withColumn("masked", F.when(F.col("spans").isNotNull(), redact(before, F.col("spans"))).otherwise(before))
    value = {text: F.col("masked")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("spans").isNotNull(), F.char_length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return joined.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
