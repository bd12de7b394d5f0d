"""A content folder as a stream of changes, operations that wait until a path is quiet, and the feed of what the index does.

The watcher is a streaming source whose offsets name snapshots of the folder: (path, size, time) of every file
once its writing has settled. A batch is the difference of two snapshots, so an edit, an addition and a deletion
between two triggers arrive once each, and a batch that is repeated after a failure is the same batch.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "path string, op string, ts timestamp, seq long"
#: A file counts once it hasn't been written to for so long; a path's operation goes on once it has been quiet for so long.
SETTLE_MS, QUIET_MS = 250, 500
HEARTBEAT_S = 25.0
#: Changes that one task of a batch hands out.
PART = 10_000

Snapshot = dict[str, list[int]]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def snapshot(path: str, before: Snapshot, settle_ms: int, now: float | None = None) -> Snapshot:
    """{path: [size, time]} of the files below ``path``; a file still being written stays as it was ``before``."""
    store, root = _opened(path)
    latest = (time.time() if now is None else now) * 1000 - settle_ms
    out: Snapshot = {}
    for found in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if found.type != pafs.FileType.File:
            continue
        name = found.path[len(root) :].lstrip("/")
        if found.mtime_ns // 1_000_000 <= latest:
            out[name] = [found.size, found.mtime_ns]
        elif name in before:
            out[name] = before[name]
    return out


def differences(before: Snapshot, after: Snapshot) -> list[tuple[str, str]]:
    """(path, op) by path: add, change or unlink."""
    changed = {p: "add" if p not in before else "change" for p, at in after.items() if before.get(p) != at}
    return sorted((changed | {p: "unlink" for p in before if p not in after}).items())


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, str, float, int]]):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state = options["path"], options["state"].rstrip("/")
        self.settle = int(options.get("settlems", SETTLE_MS))
        self.last: int | None = None

    def _load(self, number: int) -> tuple[Snapshot, float]:
        if not number:
            return {}, 0.0
        store, root = _opened(self.state)
        with store.open_input_stream(f"{root}/{number}.json") as f:
            held = json.loads(f.read())
        return held["files"], held["at"]

    def _newest(self) -> int:
        store, root = _opened(self.state)
        names = [f.base_name for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        self.last = self._newest() if self.last is None else self.last
        before, _ = self._load(self.last)
        after = snapshot(self.path, before, self.settle)
        if after != before:
            store, root = _opened(self.state)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/.{self.last + 1}.tmp") as f:
                f.write(json.dumps({"at": time.time(), "files": after}).encode())
            store.move(f"{root}/.{self.last + 1}.tmp", f"{root}/{self.last + 1}.json")  # whole or not at all
            self.last += 1
        return {"snapshot": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows, seq = [], 0
        (before, _), (after, at) = self._load(start["snapshot"]), self._load(end["snapshot"])
        for seq, (path, op) in enumerate(differences(before, after)):
            rows.append((path, op, at, end["snapshot"] * (1 << 32) + seq))
        return [_Part(rows[i : i + PART]) for i in range(0, len(rows), PART)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, op, at, seq in partition.rows:
            yield path, op, datetime.fromtimestamp(at, timezone.utc), seq

    def commit(self, end: dict) -> None:
        """Snapshots before the one that is done with aren't needed again."""
        store, root = _opened(self.state)
        for found in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if found.base_name.endswith(".json") and int(found.base_name[:-5]) < end["snapshot"]:
                store.delete_file(found.path)


class FolderWatch(DataSource):
    """``spark.readStream.format("folder_watch")`` with options path, state (a shared folder of its own) and settleMs."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def watch(spark: SparkSession, path: str, state: str, settle_ms: int = SETTLE_MS) -> DataFrame:
    """Stream of (path, op, ts, seq): add, change and unlink of the files below ``path``."""
    spark.dataSource.register(FolderWatch)
    return spark.readStream.format("folder_watch").option("path", path).option("state", state).option("settleMs", settle_ms).load()


def _when_quiet(quiet_ms: int):
    def when_quiet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            op, ts, seq, first = state.get
            state.remove()
            # what was added and went again before anybody looked never was
            if not (first == "add" and op == "unlink"):
                yield pd.DataFrame({"path": [key[0]], "op": ["add" if first == "add" else op], "ts": [ts], "seq": [seq]})
            return
        held = state.getOption
        for batch in batches:
            for row in batch.sort_values(["ts", "seq"]).itertuples(index=False):
                if held is None or (row.ts, row.seq) >= (held[1], held[2]):
                    held = (row.op, row.ts.to_pydatetime(), int(row.seq), row.op if held is None else held[3])
        state.update(held)
        state.setTimeoutDuration(quiet_ms)

    return when_quiet


def when_quiet(changes: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The last operation of each path of a stream (path, op, ts, seq), once nothing more has come for it; each change starts the wait anew."""
    state = "op string, ts timestamp, seq long, first string"
    return changes.groupBy("path").applyInPandasWithState(_when_quiet(quiet_ms), CHANGE, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(events: DataFrame, quiet: str = f"{QUIET_MS} milliseconds") -> DataFrame:
    """The same by the events' own times: (path, op, started, changes), the last operation of each run of changes of a path without a pause beyond ``quiet``.

    Over a stream, put a watermark on ``ts`` first.
    """
    by = events.groupBy("path", F.session_window("ts", quiet).alias("burst"))
    return by.agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.count("*").alias("changes")).select("path", "op", F.col("burst.start").alias("started"), "changes")


def apply_each(batch: DataFrame, apply: Callable[[DataFrame], DataFrame | None], set_aside: str) -> None:
    """Hand a batch to ``apply``; the paths whose errors (path, error) it returns are kept in ``set_aside``, the others go on."""
    errors = apply(batch)
    if errors is not None:
        errors.select("path", "error", F.current_timestamp().alias("at")).write.mode("append").json(set_aside)


class IndexFeed(StreamingQueryListener):
    """Writes what a stream that keeps an index does to a folder, a JSON object a file: index.started, index.completed, heartbeat.

    An event is (at, type, path, changes); ``heartbeat`` comes while nothing else has for so many seconds.
    """

    def __init__(self, folder: str, heartbeat: float = HEARTBEAT_S):
        self.folder, self.heartbeat, self.n, self.quiet_since = folder, heartbeat, 0, time.time()

    def _write(self, kind: str, changes: int | None = None) -> None:
        store, root = _opened(self.folder)
        store.create_dir(root, recursive=True)
        now = time.time()
        self.n, self.quiet_since = self.n + 1, now
        with store.open_output_stream(f"{root}/{int(now * 1000):015d}-{self.n:06d}.json") as f:
            f.write(json.dumps({"at": datetime.fromtimestamp(now, timezone.utc).isoformat(), "type": kind, "path": None, "changes": changes}).encode())

    def _beat(self) -> None:
        if time.time() - self.quiet_since >= self.heartbeat:
            self._write("heartbeat")

    def onQueryStarted(self, event) -> None:
        self._write("index.started")

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self._write("index.completed", event.progress.numInputRows)
        else:
            self._beat()

    def onQueryIdle(self, event) -> None:
        self._beat()

    def onQueryTerminated(self, event) -> None:
        pass


def read_feed(spark: SparkSession, folder: str) -> DataFrame:
    """(at, type, path, changes) of a feed's folder."""
    return spark.read.schema("at timestamp, type string, path string, changes long").json(folder)
