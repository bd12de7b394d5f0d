"""The watched folder, the wait for quiet, and the feed."""

import os
import time

from pyspark.sql import functions as F

from lexiloom.streaming import watch as W


def write(path, text, age=5.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (time.time() - age,) * 2)


def test_snapshots_wait_for_writes_to_settle(tmp_path):
    write(tmp_path / "a.md", "one")
    write(tmp_path / "sub" / "b.md", "two")
    first = W.snapshot(str(tmp_path), {}, 250)
    assert W.differences({}, first) == [("a.md", "add"), ("sub/b.md", "add")]
    write(tmp_path / "a.md", "half a", age=0)
    write(tmp_path / "new.md", "half a", age=0)
    assert W.snapshot(str(tmp_path), first, 60_000) == first
    later = W.snapshot(str(tmp_path), first, 250, now=time.time() + 1)
    (tmp_path / "sub" / "b.md").unlink()
    last = W.snapshot(str(tmp_path), later, 250, now=time.time() + 1)
    assert W.differences(first, last) == [("a.md", "change"), ("new.md", "add"), ("sub/b.md", "unlink")]


def test_edits_and_deletions_between_triggers_arrive_once(spark, tmp_path):
    content, seen = tmp_path / "content", []
    stream = lambda: W.watch(spark, str(content), str(tmp_path / "state")).writeStream.foreachBatch(lambda b, n: seen.append(sorted((r.path, r.op) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "checkpoint"))

    def settle(n):
        until = time.time() + 60
        while len([x for x in seen if x]) < n and time.time() < until:
            time.sleep(0.2)

    write(content / "a.md", "1")
    write(content / "b.md", "1")
    running = stream().trigger(processingTime="300 milliseconds").start()
    settle(1)
    running.stop()
    write(content / "a.md", "22")
    write(content / "a.md", "333")
    (content / "b.md").unlink()
    write(content / "c.md", "1")
    running = stream().trigger(processingTime="300 milliseconds").start()  # goes on where it stopped
    settle(2)
    time.sleep(1)
    running.stop()
    assert [x for x in seen if x] == [[("a.md", "add"), ("b.md", "add")], [("a.md", "change"), ("b.md", "unlink"), ("c.md", "add")]]


def test_quiet_paths_go_on_and_the_feed_tells(spark, tmp_path):
    log, out = tmp_path / "log", []
    at = F.timestamp_seconds
    rows = lambda own: spark.createDataFrame(own, "path string, op string, t long, seq long").select("path", "op", at("t").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(str(log))
    rows([("a", "add", 1, 1), ("a", "change", 2, 2), ("b", "change", 1, 3), ("c", "add", 1, 4), ("c", "unlink", 2, 5)])
    stream = spark.readStream.schema(W.CHANGE).parquet(str(log))
    feed = W.IndexFeed(str(tmp_path / "feed"), heartbeat=0.0)
    spark.streams.addListener(feed)
    try:
        running = W.when_quiet(stream, 1500).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(sorted((r.path, r.op) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").start()
        until = time.time() + 90
        while len(out) < 2 and time.time() < until:
            time.sleep(0.2)
        rows([("b", "unlink", 9, 9)])
        while len(out) < 3 and time.time() < until:
            time.sleep(0.2)
        running.stop()
    finally:
        spark.streams.removeListener(feed)
    assert sorted(out[:2]) == [("a", "add"), ("b", "change")] and out[2:] == [("b", "unlink")]
    kinds = {r.type: r.changes for r in W.read_feed(spark, str(tmp_path / "feed")).orderBy("at").collect()}
    assert {"index.started", "index.completed", "heartbeat"} <= set(kinds) and kinds["index.completed"] == 1


def test_debounced_by_event_time_and_set_aside(spark, tmp_path):
    rows = [("a", "add", 0.0), ("a", "change", 0.4), ("a", "unlink", 1.0), ("a", "add", 5.0), ("b", "change", 0.2)]
    events = spark.createDataFrame([(p, o, int(t * 1000), i) for i, (p, o, t) in enumerate(rows)], "path string, op string, t long, seq long").withColumn("ts", F.timestamp_millis("t"))
    assert sorted((r.path, r.op, r.changes) for r in W.debounced(events).collect()) == [("a", "add", 1), ("a", "change", 2), ("a", "unlink", 1), ("b", "change", 1)]
    W.apply_each(events, lambda b: b.where("path = 'b'").select("path", F.lit("broken").alias("error")), str(tmp_path / "aside"))
    assert [(r.path, r.error) for r in spark.read.json(str(tmp_path / "aside")).collect()] == [("b", "broken")]
