"""The stored index: incremental runs, broken files, edits with history, embedder changes."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.config import Settings
from lexiloom.operators.store import IndexStore
from lexiloom.sources import files


@pytest.fixture
def content(tmp_path):
    root = tmp_path / "content"
    root.mkdir()
    for name in "abc":
        (root / f"{name}.md").write_text(f"---\ntitle: Page {name}\n---\n# {name}\n\nText of page {name}.")
    return root


def store_at(spark, tmp_path, **given):
    return IndexStore(spark, str(tmp_path / "index"), Settings(embedding_dims=16), **given)


def counts(result):
    return result.files_indexed, result.files_skipped, result.files_deleted


def test_incremental_runs(spark, tmp_path, content):
    store, walk = store_at(spark, tmp_path), lambda: files.walk(spark, str(content))
    assert counts(store.reconcile(walk())) == (3, 0, 0)
    assert counts(store.reconcile(walk())) == (0, 3, 0)
    (content / "a.md").write_text("changed text")
    assert counts(store.reconcile(walk())) == (1, 2, 0)
    (content / "b.md").unlink()
    assert counts(store.reconcile(walk())) == (0, 2, 1)
    assert {r.path: r.title for r in store.read("pages").collect()} == {"a.md": "A", "c.md": "Page c"}
    assert {r.path: r.text for r in store.read("chunks").collect()}["a.md"] == "changed text"
    assert {r.path for r in store.read("vectors").collect()} == {"a.md", "c.md"}


def test_a_broken_file_is_reported_and_keeps_its_index(spark, tmp_path, content):
    store = store_at(spark, tmp_path)
    store.reconcile(files.walk(spark, str(content)))
    (content / "b.md").write_text("---\ntags: [x\n---\nnew")
    (content / "empty.md").write_text("---\ntitle: E\n---\n")
    result = store.reconcile(files.walk(spark, str(content)))
    assert [r.path for r in result.errors.collect()] == ["b.md"] and result.files_indexed == 1
    assert {r.path: r.chunk_count for r in store.read("manifest").collect()} == {"a.md": 1, "b.md": 1, "c.md": 1, "empty.md": 0}
    assert "Text of page b" in {r.path: r.text for r in store.read("chunks").collect()}["b.md"]


def test_another_embedder_empties_what_depends_on_it(spark, tmp_path, content):
    store = store_at(spark, tmp_path, model="model-a")
    store.reconcile(files.walk(spark, str(content)))
    page = spark.createDataFrame([("a.md", "saved")], "path string, text string")
    store.save(page, page)
    other = store_at(spark, tmp_path, model="model-b")
    assert other.check_embedder() == (True, "model-a") and other.check_embedder() == (False, "model-b")
    assert other.read("manifest").count() == other.read("chunks").count() == 0
    assert other.read("pages").count() == 3 and other.read("history").count() == 1
    assert counts(other.reconcile(files.walk(spark, str(content)))) == (3, 0, 0)


def test_edits_history_and_folders(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), Settings(embedding_dims=16, history_keep=2))
    page = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    now = None
    for body in ("one", "two", "three", "four"):
        new = page(("docs/x.md", body), ("docs/sub/y.md", body + " y"))
        store.save(new, now)
        now = new
    assert [(r.id, r.body) for r in store.read("history").where("path = 'docs/x.md'").orderBy("id").collect()] == [(4, "two"), (6, "three")]
    assert store.read("chunks").where("path = 'docs/x.md'").select("text").first().text == "four"
    assert store.remove_folder("docs/sub") == 1
    assert [r.path for r in store.read("pages").collect()] == ["docs/x.md"]
    assert store.read("history").count() == 4


def folder_bytes(root):
    return sum(f.stat().st_size for f in root.rglob("*.parquet"))


def test_a_change_writes_only_itself(spark, tmp_path):
    store = store_at(spark, tmp_path)
    rows = [(f"p{i}.md", f"---\nn: {i}\n---\n" + " ".join(f"word{i}-{k}" for k in range(400))) for i in range(120)]
    walked = lambda own: spark.createDataFrame([(p, t, None) for p, t in own], "path string, text string, modified timestamp").withColumn("sha256", F.sha2("text", 256))
    store.reconcile(walked(rows))
    whole = folder_bytes(tmp_path / "index")
    before = store.version()[0]
    assert counts(store.reconcile(walked(rows))) == (0, 120, 0) and store.version()[0] == before  # nothing changed, nothing is written
    page = spark.createDataFrame([("p7.md", "---\nn: 8\n---\nnew text")], "path string, text string")
    store.save(page, spark.createDataFrame([rows[7]], "path string, text string"))
    assert folder_bytes(tmp_path / "index") - whole < whole / 3
    assert store.read("chunks").where("path = 'p7.md'").first().text == "new text" and store.read("pages").count() == 120
    old = store.read("history").first()
    assert (old.path, old.frontmatter, old.body) == ("p7.md", '{"n": 7}', rows[7][1])
    assert counts(store.reconcile(walked(rows[:100]))) == (1, 99, 20)
    assert store.read("manifest").count() == store.read("pages").count() == 100


def test_many_commits_are_compacted(spark, tmp_path, monkeypatch):
    from lexiloom.operators import store as module

    monkeypatch.setattr(module, "COMPACT_AFTER", 2)
    store = store_at(spark, tmp_path)
    for i in range(5):
        store.save(spark.createDataFrame([("a.md", f"text {i}"), (f"b{i % 3}.md", f"other {i}")], "path string, text string"))
    assert max(len(own) for own in store.version()[1].values()) <= 3
    assert {r.path: r.text for r in store.read("chunks").collect()} == {"a.md": "text 4", "b0.md": "other 3", "b1.md": "other 4", "b2.md": "other 2"}
    store.remove(spark.createDataFrame([("a.md",)], "path string"))
    assert {r.path for r in store.read("pages").collect()} == {"b0.md", "b1.md", "b2.md"}


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.commit(meta=spark.createDataFrame([("k", "1")], "key string, value string"))
    before = store.version()
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        store.commit(meta=spark.createDataFrame([("k", "2")], "key string, value string"), pages=spark.range(1).select(F.raise_error(F.lit("lost")).alias("path"), *[F.lit(None).alias(c) for c in ("title", "frontmatter", "size", "last_modified", "last_indexed")]))
    assert store.version() == before and store.read("meta").first().value == "1"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_history_ids_are_unique_and_in_order(spark, adaptive):
    from lexiloom.operators import maintenance

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        pages = spark.range(300_000, numPartitions=7).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("text"), (F.col("id") % 5).alias("at"))
        rows = maintenance.history_rows(pages, F.col("path").substr(7, 1), 11)
        got = rows.select("id", "path", F.row_number().over(Window.orderBy("written_at", "path")).alias("n"))
        assert got.agg(F.count("*"), F.countDistinct("id"), F.count_if(F.col("id") != F.col("n") + 10)).first()[:] == (300_000, 300_000, 0)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_full_text_of_a_changed_index_equals_a_rebuilt_one(spark, tmp_path, monkeypatch):
    """Saves, a removal, a reconcile and merged segments; what is asked reads no text of chunks."""
    import random

    from lexiloom.operators import lexical
    from lexiloom.operators import store as module

    monkeypatch.setattr(module, "COMPACT_AFTER", 3)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(3000)]
    body = lambda: " ".join(rng.choices(words, k=rng.randrange(5, 60)))
    now = {f"p{i}.md": body() for i in range(60)}
    store = store_at(spark, tmp_path)
    page = lambda own: spark.createDataFrame(list(own.items()), "path string, text string")
    walked = lambda own: page(own).select("path", "text", F.lit(None).cast("timestamp").alias("modified"), F.sha2("text", 256).alias("sha256"))
    store.reconcile(walked(now))
    for turn in range(5):
        new = {f"p{i}.md": body() for i in rng.sample(range(70), 6)}
        store.save(page(new))
        now |= new
        if turn == 2:
            lost = rng.sample(sorted(now), 5)
            store.remove(page({p: "" for p in lost}))
            now = {p: t for p, t in now.items() if p not in lost}
    now = dict(list(now.items())[:-3]) | {"last.md": "w1-w2 w1 w2 seldom"}
    store.reconcile(walked(now))
    assert 1 < len(store.version()[1]["postings"]) < 7  # merged by size
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(20)] + [(90, "w1-w2"), (91, "seldom"), (92, "none")], "query_id int, query string")
    own = store.lexicon()
    rebuilt = lexical.lexicon(store.read("chunks"))
    for q in (own.terms, rebuilt.terms), (own.totals, rebuilt.totals):
        assert sorted(map(tuple, q[0].collect())) == sorted(map(tuple, q[1].collect()))
    got = lexical.bm25(asked, own, 6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25(asked, rebuilt, 6).collect()))
    assert not any("/chunks/" in f for f in got.inputFiles())
    assert sorted(map(tuple, lexical.phrase_hits(asked, own).collect())) == sorted(map(tuple, lexical.phrase_hits(asked, rebuilt).collect()))
    from lexiloom.plans.search import search

    found = search(asked.where("query_id = 91"), store.index(), Settings(embedding_dims=16, vector_weight=0))
    assert [r.path for r in found.collect()] == ["last.md"]


def shuffled(spark, after=-1):
    """(bytes that stages later than ``after`` wrote to shuffles, the last stage)."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    stages = [found.apply(i) for i in range(found.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_a_new_index_shuffles_and_leaves_little_beside_itself(spark, tmp_path):
    """Texts aren't shuffled to be compared or chunked, postings go compressed, and no stored step stays."""
    import random

    from lexiloom.operators import lexical
    from lexiloom.storage import shared_dir

    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.5)) % 20_000}" for _ in range(40_000)]
    rows = [(f"p{i}.md", "# a\n" + "\n\n".join(" ".join(rng.choices(words, k=60)) + "." for _ in range(30))) for i in range(300)]
    pages = spark.createDataFrame([(p, t, None) for p, t in rows], "path string, text string, modified timestamp").withColumn("sha256", F.sha2("text", 256))
    pages.write.parquet(str(tmp_path / "pages"))
    shared = type(tmp_path)(shared_dir(spark).removeprefix("file://"))
    texts, left, last = sum(len(t) for _, t in rows), folder_bytes(shared), shuffled(spark)[1]
    store = store_at(spark, tmp_path)
    assert counts(store.reconcile(spark.read.parquet(str(tmp_path / "pages")))) == (300, 0, 0)
    assert shuffled(spark, last)[0] < texts
    assert folder_bytes(shared) - left < texts / 10
    index = {name: folder_bytes(tmp_path / "index" / name) for name in ("chunks", "postings")}
    assert index["chunks"] < texts and index["postings"] < 2 * texts
    assert store.read("manifest").count() == 300 and store.read("chunks").agg(F.countDistinct("path")).first()[0] == 300
    chunks, own = lexical.occurrences(store.read("chunks")).cache(), store.lexicon()
    assert own.totals.first()[:] == chunks.where("term = ''").agg(F.count("*"), F.sum("dl")).first()[:]
    back = lexical.opened(own.blocks, None, "term", positions=True).select(chunks.columns)
    assert back.count() == chunks.where("term <> ''").count() and back.exceptAll(chunks).isEmpty()
