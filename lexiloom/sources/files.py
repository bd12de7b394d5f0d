"""Files of a content folder as rows: listing, ignore rules, size caps, text and bytes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

MAX_FILE_BYTES = 5 << 20
# What is never indexed.
DEFAULT_IGNORES = ("node_modules", ".git", "drafts/**", "_*/**", "*.tmp")
MARKDOWN = (".md", ".mdx", ".markdown", ".mdown")


def ignore_regex(rule: str) -> tuple[bool, str] | None:
    """(negated, regular expression over relative paths) of one gitignore line; None for blanks and comments."""
    rule = rule.rstrip("\r\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule.removeprefix("!").removeprefix("\\")
    only_folders = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.+", i + 3
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and "]" in rule[i + 2 :]:
            end = rule.index("]", i + 2)
            body = rule[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return negated, ("^" if anchored else "(?:^|.*/)") + out + ("/.+$" if only_folders else "(?:/.+)?$")


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether gitignore rules leave a path out; the last one that fits decides."""
    out = F.lit(False)
    for rule in rules:
        if parsed := ignore_regex(rule):
            negated, pattern = parsed
            out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def read_rules(spark: SparkSession, root: str, names: Sequence[str] = (".gitignore", ".lexiloomignore")) -> list[str]:
    """Lines of the ignore files at the root, those that exist, through Hadoop's file system, so any store will do."""
    jvm, out = spark.sparkContext._jvm, []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(path):
            stream = store.open(path)
            try:
                out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            finally:
                stream.close()
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of every file below ``root``; a missing root is an error.

    Spark itself leaves out files and folders whose names start with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    relative = F.regexp_replace("path", "^" + re.escape(base) + "|^" + re.escape(base.replace("file:///", "file:/")), "")
    return files.select(relative.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def walk(spark: SparkSession, root: str, extensions: Sequence[str] = (".md",), binary: Sequence[str] = (), ignore: Sequence[str] = (), respect_ignore_files: bool = True, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, modified, text, bytes, sha256) of the files to index. Text files come decoded, others as bytes."""
    rules = [*DEFAULT_IGNORES, *ignore, *(read_rules(spark, root) if respect_ignore_files else ())]
    wanted = [e.lower() for e in (*extensions, *binary)]
    files = listing(spark, root).where(F.col("length") <= max_bytes).where(extension(F.col("path")).isin(wanted) & ~ignored(F.col("path"), rules))
    as_bytes = extension(F.col("path")).isin([e.lower() for e in binary]) if binary else F.lit(False)
    return files.select("path", "modified", F.when(~as_bytes, F.decode("content", "UTF-8")).alias("text"), F.when(as_bytes, F.col("content")).alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inside(root: str, path: str) -> str:
    """``path`` below ``root``; a path that leaves it is an error."""
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == ".." and not parts or "\0" in part:
            raise ValueError(f"path leaves the content folder: {path}")
        parts = parts[:-1] if part == ".." else [*parts, part] if part not in ("", ".") else parts
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def read_one(spark: SparkSession, root: str, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One file of the folder, none if it is too large."""
    one = spark.read.format("binaryFile").load(inside(root, path)).where(F.col("length") <= max_bytes)
    return one.select(F.lit(path).alias("path"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def scan_disk(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of Markdown files for health checks, without hidden, underscored, draft and module folders."""
    skipped = F.col("path").rlike(r"(?:^|/)(?:[._][^/]*|drafts|node_modules)/")
    return listing(spark, root).where(F.col("path").rlike(r"(?i)\.(?:md|mdx|markdown|mdown)$") & ~skipped).select("path", F.decode("content", "UTF-8").alias("text"))


def corpus_hash(files: DataFrame) -> DataFrame:
    """(corpus_hash,) of (path, sha256): the hash over the sorted file hashes, two levels deep.

    Files meet in 65,536 groups by the first digits of their hashes, so no task sorts the whole corpus.
    """
    grouped = files.select(F.sha2(F.concat_ws("\n", "path", "sha256"), 256).alias("h")).groupBy(F.substring("h", 1, 4).alias("g"))
    joined = lambda column: F.sha2(F.array_join(F.sort_array(F.collect_list(column)), ""), 256)
    return grouped.agg(joined("h").alias("h")).agg(joined("h").alias("corpus_hash"))
