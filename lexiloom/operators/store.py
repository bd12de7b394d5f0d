"""The index as versioned Parquet tables: incremental reconcile, page edits with history, embedder changes.

Every change appends: it writes its new rows and the paths whose older rows it replaces, each to a
folder of its own, and then one commit file that lists all folders. What a change costs follows the
change, not the index. A row is current unless a later commit replaced its path. Every
``COMPACT_AFTER`` commits the folders of a table are rewritten as one.

The full-text half is kept alike: each change writes its postings as a segment, and what it adds to or takes from the
counts of terms, chunks and tokens. Postings of replaced paths stay in their segments and are skipped when
opened; segments of about one size are merged once there are ``MERGE`` of them, without their dead postings.
Chunks and postings are written where they stay before what is computed from them, so no second copy is kept.

Readers follow the latest commit, so they never see half a change, and a failed or lost job leaves
only files that no commit names. Two writers on one commit number collide: the second fails instead
of overwriting the first.
"""

from __future__ import annotations

import functools
import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.embed import hash_embedding
from ..functions.text import page_title
from ..sources.markdown import parse_pages
from ..storage import forget, stored
from . import lexical, maintenance
from .chunking import chunk

SCHEMAS = {
    "pages": "path string, title string, frontmatter string, size long, last_modified timestamp, last_indexed timestamp",
    "chunks": "chunk_id string, path string, chunk_idx int, text string, heading_path array<string>",
    "vectors": "chunk_id string, path string, embedding array<float>",
    "manifest": "path string, sha256 string, chunk_count long, last_indexed timestamp",
    "history": "id long, path string, sha256 string, body string, frontmatter string, byte_size long, written_at timestamp",
    "meta": "key string, value string",
    "postings": lexical.BLOCKS,
    "terms": lexical.TERMS,
    "totals": lexical.TOTALS,
}


#: Tables whose rows of a path are replaced as a whole; history only grows, and meta is one small table.
PAGED = ("pages", "chunks", "vectors", "manifest")
COMPACT_AFTER = 20
#: Level of compression of texts and postings, which take a seventh less room than at the usual 3.
CLOSE = 9
#: Segments of postings of one size class that are merged, and how many times as many blocks the next class holds.
MERGE = 4


@dataclass(frozen=True)
class IndexResult:
    files_indexed: int
    files_skipped: int
    files_deleted: int
    chunks_added: int
    errors: DataFrame


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, model: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None):
        """``embed`` adds ``embedding`` to chunks under the name ``model``; without it the hash embedding is used."""
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.embed, self.model = embed, model or f"hash-{self.settings.embedding_dims}"

    # commits

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, dict[str, list]]:
        """(number of the latest commit, the folders of each table with the commits that wrote them); 0 for a new store."""
        path, store = self._path("commits")
        if not store.exists(path):
            return 0, {}
        names = [s.getPath().getName() for s in store.listStatus(path)]
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not last:
            return 0, {}
        stream = store.open(self._path(f"commits/{last}.json")[0])
        try:
            return last, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, folders: list, schema: str) -> DataFrame:
        """Rows of all folders, with the ``commit`` that wrote them."""
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, commit long")
        wanted = self.spark.createDataFrame([], schema).schema

        def part(folder: str) -> DataFrame:
            if "vectors/" not in folder:
                return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
            held = self.spark.read.parquet(f"{self.root}/{folder}")  # older stores hold doubles
            return held.select(*[F.col(f.name).cast(f.dataType) for f in wanted])

        parts = [part(folder).withColumn("commit", F.lit(n).cast("long")) for folder, n in folders]
        return functools.reduce(DataFrame.unionByName, parts)

    def read(self, name: str) -> DataFrame:
        """The current rows of a table; of history the newest of each path."""
        return self._current(name, self.version()[1])

    def _current(self, name: str, folders: dict[str, list]) -> DataFrame:
        rows = self._rows(folders.get(name, []), SCHEMAS[name])
        if name == "history":
            return maintenance.newest(rows.drop("commit"), self.settings.history_keep)
        if name == "terms":
            return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        if name == "totals":
            return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "tokens")])
        gone = self._gone(folders, min((n for _, n in folders.get(name, [])), default=0)) if name in PAGED else None
        if gone is not None:
            rows = rows.join(gone, "path", "left").where("until is null or commit >= until").drop("until")
        return rows.drop("commit")

    def _write(self, df: DataFrame, folder: str) -> None:
        level = CLOSE if folder.split("/")[0] in ("chunks", "postings") else 3
        df.write.mode("overwrite").options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": level}).parquet(f"{self.root}/{folder}")

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        """New rows of a table in a folder of their own, for a commit to name and what follows to read."""
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        folder = f"{name}/new-{uuid.uuid4().hex}"
        self._write(df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]), folder)
        out = self.spark.read.schema(wanted).parquet(f"{self.root}/{folder}")
        out.written_as = folder
        return out

    def commit(self, gone: DataFrame | None = None, fresh: tuple[str, ...] = (), **tables: DataFrame) -> int:
        """Append ``tables`` and replace what was there of the paths in ``gone``, all at once; ``fresh`` tables hold just the new rows."""
        before, folders = self.version()
        number = before + 1
        folders = {name: [] if name in fresh else list(own) for name, own in folders.items()}
        writes = {name: (df, SCHEMAS[name]) for name, df in tables.items()}
        if gone is not None:
            writes["gone"] = (gone.select("path").distinct(), "path string")
        for name, (df, schema) in writes.items():
            wanted = self.spark.createDataFrame([], schema).schema
            folder = getattr(df, "written_as", f"{name}/v{number}")
            if not hasattr(df, "written_as"):
                self._write(df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]), folder)
            folders.setdefault(name, []).append([folder, number])
        self._merge_segments(folders, number)
        for name in (n for n in SCHEMAS if n != "postings" and len(folders.get(n, [])) > COMPACT_AFTER):
            self._write(self._current(name, folders), f"{name}/v{number}-whole")
            folders[name] = [[f"{name}/v{number}-whole", number]]
        oldest = min((n for name in (*PAGED, "postings") for _, n in folders.get(name, [])), default=number)
        folders["gone"] = [[f, n] for f, n in folders.get("gone", []) if n > oldest]
        path, store = self._path(f"commits/{number}.json")
        out = store.create(path, False)
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()
        return number

    # full text

    def _gone(self, folders: dict[str, list], first: int) -> DataFrame | None:
        """(path, until) of paths that were replaced or removed after commit ``first``."""
        later = [(f, n) for f, n in folders.get("gone", []) if n > first]
        return self._rows(later, "path string").groupBy("path").agg(F.max("commit").alias("until")) if later else None

    def _merge_segments(self, folders: dict[str, list], number: int) -> None:
        """Segments of a size class with enough of them become one, without dead postings."""
        classes: dict[int, list] = {}
        for entry in folders.get("postings", []):
            blocks = self.spark.read.schema(SCHEMAS["postings"]).parquet(f"{self.root}/{entry[0]}").count()  # from the files' footers
            classes.setdefault(int(math.log(max(blocks, 1), MERGE)), []).append(entry)
        for size, entries in classes.items():
            if len(entries) < MERGE:
                continue
            rows = self._rows(entries, SCHEMAS["postings"])
            live = lexical.opened(rows, self._gone(folders, min(n for _, n in entries)), "term", positions=True)
            folder = f"postings/v{number}-class{size}"
            self._write(lexical.blocks(live, rows.agg(F.sum("n")).first()[0] or 0), folder)
            folders["postings"] = [e for e in folders["postings"] if e not in entries] + [[folder, number]]

    def lexicon(self) -> lexical.Lexicon:
        """What a lexical search reads; no text of chunks."""
        folders = self.version()[1]
        segments = folders.get("postings", [])
        gone = self._gone(folders, min((n for _, n in segments), default=0))
        blocks = self._rows(segments, SCHEMAS["postings"])
        return lexical.Lexicon(blocks if gone is not None else blocks.drop("commit"), self._current("terms", folders), self._current("totals", folders), gone)

    def index(self):
        """The stored index as ``plans.search`` asks it."""
        from ..plans.search import Index

        vectors = self.read("vectors").select("chunk_id", "embedding")
        return Index(self.read("pages"), self.read("chunks"), vectors, self.lexicon())

    def _counted(self, paths: DataFrame, added: DataFrame | None = None) -> dict[str, DataFrame]:
        """Postings of ``added`` chunks, and how the counts change when these replace what the index holds of ``paths``."""
        terms, sums = [], []
        if self.version()[1].get("chunks"):
            lost = self.read("chunks").join(lexical.small(paths.select("path").distinct()), "path", "left_semi").select("chunk_id", "text")
            counts = stored(lexical.counted(lexical.occurrences(lost)), "lost-counts")
            terms.append(counts.where("term <> ''").select("term", (-F.col("df")).alias("df")))
            sums.append(counts.where("term = ''").agg(*[(-F.coalesce(F.sum(c), F.lit(0))).alias(n) for c, n in (("df", "chunks"), ("tokens", "tokens"))]))
        out = {}
        if added is not None:
            out["postings"] = self._written("postings", lexical.chunk_blocks(added, added.count()))
            terms.append(lexical.block_counts(out["postings"]))
            sums.append(lexical.block_totals(out["postings"], added))
        if not terms:
            return out
        changed = functools.reduce(DataFrame.unionByName, terms).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        return out | {"terms": changed, "totals": functools.reduce(DataFrame.unionByName, sums)}

    # indexing

    def check_embedder(self) -> tuple[bool, str | None]:
        """(changed, previous model). A changed model empties what depends on it; pages and history stay."""
        state = maintenance.embedder_state(self.read("meta"), self.model, self.settings.embedding_dims).first()
        if state.changed or state.previous is None:
            meta = self.spark.createDataFrame([("embedder_model", self.model), ("embedder_dim", str(self.settings.embedding_dims))], SCHEMAS["meta"])
            self.commit(fresh=("meta", "chunks", "vectors", "manifest", "postings", "terms", "totals") if state.changed else ("meta",), meta=meta)
        return state.changed, state.previous

    def _parsed(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pages, facts of good pages without their text, errors) of (path, text, modified, sha256, size); each file is parsed once."""
        parsed = stored(parse_pages(files).drop("text", "bytes"), "parsed-pages")
        good, errors = maintenance.split_errors(stored(parsed.drop("plain"), "parsed-facts"))
        return parsed, good, errors

    def _tables(self, parsed: DataFrame, good: DataFrame, now: Column) -> dict[str, DataFrame]:
        """New rows of each table; ``parsed`` goes once its chunks are there."""
        title = page_title(F.get_json_object("frontmatter", "$.title"), F.col("path"))
        pages = good.select("path", title.alias("title"), "frontmatter", "size", F.col("modified").alias("last_modified"), now.alias("last_indexed"))
        few = len(parsed.inputFiles()) < self.spark.sparkContext.defaultParallelism  # pages of few files are dealt out
        plain = parsed.where("error is null").select("path", "plain")
        chunks = self._written("chunks", chunk(plain, self.settings.chunk_size, self.settings.chunk_overlap, spread=few))
        forget(parsed)
        vectors = self.embed(chunks) if self.embed else chunks.withColumn("embedding", hash_embedding(F.col("text"), self.settings.embedding_dims))
        counted = chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))
        manifest = good.select("path", "sha256").join(counted, "path", "left").select("path", "sha256", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), now.alias("last_indexed"))
        return {"pages": pages, "chunks": chunks, "vectors": vectors.select("chunk_id", "path", "embedding"), "manifest": manifest}

    def reconcile(self, walked: DataFrame) -> IndexResult:
        """Bring the index in line with the files (path, text, modified, sha256) of a walk.

        Unchanged files are skipped, missing ones removed; a file that fails keeps what was indexed.
        """
        self.check_embedder()
        now, manifest = F.current_timestamp(), self.read("manifest")
        known = bool(self.version()[1].get("manifest"))
        todo = maintenance.to_index(lexical.small(manifest), walked) if known else walked  # the text of all files stays where it is
        parsed, good, errors = self._parsed(todo.withColumn("size", F.length("text")))
        gone = stored(maintenance.to_delete(manifest, walked).select("path"), "gone-paths")
        indexed, deleted = good.count(), gone.count()
        skipped = walked.join(manifest.select("path", "sha256"), ["path", "sha256"], "left_semi").count() if known else 0
        if not indexed and not deleted:
            forget(parsed)
            return IndexResult(0, skipped, 0, 0, errors)
        new, replaced = self._tables(parsed, good, now), gone.union(good.select("path"))
        self.commit(gone=replaced, **new, **self._counted(replaced, new["chunks"]))
        return IndexResult(indexed, skipped, deleted, new["chunks"].count(), errors)

    def save(self, pages: DataFrame, current: DataFrame | None = None) -> IndexResult:
        """Index new texts (path, text) of pages; what those pages hold now, ``current`` (path, text), joins their history.

        History keeps the newest ``history_keep`` snapshots of a page, with the frontmatter it had.
        """
        now = F.current_timestamp()
        files = pages.select("path", "text", now.alias("modified"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").alias("size"))
        tables = {}
        if current is not None:
            first = (self._rows(self.version()[1].get("history", []), SCHEMAS["history"]).agg(F.max("id")).first()[0] or 0) + 1
            held = current.join(pages.select("path"), "path", "left_semi").join(self.read("pages").select("path", "frontmatter"), "path", "left")
            tables["history"] = maintenance.history_rows(held, now, first)
        parsed, good, errors = self._parsed(files)
        new, replaced = self._tables(parsed, good, now), good.select("path")
        self.commit(gone=replaced, **new, **tables, **self._counted(replaced, new["chunks"]))
        return IndexResult(good.count(), 0, 0, new["chunks"].count(), errors)

    def remove(self, paths: DataFrame) -> int:
        """Drop pages; returns how many chunks went. Their history stays."""
        lost = self.read("chunks").join(paths.select("path"), "path", "left_semi").count()
        self.commit(gone=paths, **self._counted(paths))
        return lost

    def remove_folder(self, folder: str) -> int:
        return self.remove(maintenance.under_folder(self.read("manifest"), folder))

    def move(self, old: str, new: str) -> int:
        """Pages at or below ``old`` under their new path, in place of what was there; returns how many. Their history stays with the old path."""
        rows = {name: self.read(name) for name in PAGED}
        inside = stored(maintenance.under_folder(rows["manifest"].select("path"), old), "moved-paths")
        moved = {name: stored(maintenance.moved(own.join(inside, "path", "left_semi"), old, new), f"moved-{name}") for name, own in rows.items()}
        own_id = F.concat("path", F.lit("#"), F.substring_index("chunk_id", "#", -1))
        tables = {name: own.withColumn("chunk_id", own_id) if "chunk_id" in own.columns else own for name, own in moved.items()}
        tables["pages"] = tables["pages"].withColumn("title", page_title(F.get_json_object("frontmatter", "$.title"), F.col("path")))
        n = inside.count()
        if n:
            replaced = inside.union(tables["manifest"].select("path"))
            self.commit(gone=replaced, **tables, **self._counted(replaced, tables["chunks"]))
        return n
