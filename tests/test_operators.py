"""Exact values of single operators."""

import pytest
from pyspark.sql import functions as F

from lexiloom import config
from lexiloom.config import Settings, capabilities, load_settings
from lexiloom.functions import text as T
from lexiloom.functions.embed import chunk_size_for, embed_with, hash_embedding
from lexiloom.functions import snippet as S
from lexiloom.operators import chunking, evaluation, evidence, fusion, health, lexical, maintenance, pages, retrieval
from lexiloom.plans import search
from lexiloom.sources import files, markdown, questions
from tests.reference_chunks import split_text
from tests.reference_snippet import around_terms, make_snippet
from lexiloom.streaming import changes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_query_terms_and_sentences(spark):
    assert one(spark, T.query_terms(F.col("q")), q="How do we Deploy to Production?") == ["deploy", "production"]
    assert one(spark, T.query_terms(F.col("q")), q="postgres-over-mongo, ADR-0042") == ["postgres", "over", "mongo", "adr", "0042"]
    assert one(spark, F.size(T.sentences(F.col("t"))), t="First sentence. Second sentence! Third? Yes.") == 4
    assert one(spark, F.size(T.sentences(F.col("t"))), t="Born c. 1162 in Mongolia. He died in 1227.") == 2


def test_answers_and_snippets(spark):
    text = "Rome was founded long ago. The traditional date for the fall is 476 AD. Many people lived there. It was large."
    assert one(spark, T.best_answer(F.col("t"), F.lit("when did rome fall")), t=text) == "The traditional date for the fall is 476 AD."
    assert one(spark, T.best_answer(F.col("t"), F.lit("  ")), t=text) is None
    assert one(spark, T.best_answer(F.col("t"), F.lit("quantum")), t=text) is None
    long = " ".join(f"Sentence number {i} talks about ordinary things here." for i in range(8)) + " Database migrations run first. " + "Then the rest follows as usual. " * 6
    shown = make_snippet(long, "migrations")
    assert shown.startswith("…") and "Database migrations" in shown and len(shown) <= 284
    run_on = "word " * 80 + "compression ratio matters " + "word " * 40
    shown = make_snippet(run_on, "compression ratio", 120)
    assert "compression ratio" in shown and len(shown) <= 130 and shown.startswith("…")
    assert around_terms("nothing here", ["term"], 120, False) == "nothing here"
    assert make_snippet("  short ", "x") == "short"


def test_first_heading_and_titles(spark):
    assert one(spark, T.first_heading(F.col("t")), t="---\ntitle: x\n---\n\n# Real Title\n\ntext") == "Real Title"
    assert one(spark, T.first_heading(F.col("t")), t="## only second") is None
    assert one(spark, T.page_title(F.lit(None).cast("string"), F.col("p")), p="a/my-page_two.md") == "My page two"
    assert one(spark, T.result_title(F.lit(" "), F.col("p")), p="a/my-page.MD") == "my-page"
    assert one(spark, T.extension(F.col("p")), p="a.b/.gitignore") == ""


def test_sections_follow_headings(spark):
    plain = "# Top\nintro\n## A\ntext a\n### A1\ntext a1\n## B\ntext b"
    rows = chunking.chunk(spark.createDataFrame([("p.md", plain), ("blank.md", " \n ")], "path string, plain string")).orderBy("chunk_idx").collect()
    assert [r.heading_path for r in rows] == [["Top"], ["Top", "A"], ["Top", "A", "A1"], ["Top", "B"]]
    assert [r.chunk_id for r in rows] == [f"p.md#{i}" for i in range(4)]


def test_many_headings_on_a_page(spark):
    plain = "before\n" + "".join(f"{'#' * (1 + i % 3)} h{i}\ntext {i}\n" for i in range(30_000))
    rows = chunking.chunk(spark.createDataFrame([("p.md", plain)], "path string, plain string")).orderBy("chunk_idx").collect()
    assert len(rows) == 30_001 and rows[0].heading_path == [] and rows[0].text == "before"
    assert all(r.heading_path == [f"h{j}" for j in range(i - i % 3, i + 1)] for i, r in enumerate(rows[1:]))


def test_splitting_packs_paragraphs_sentences_and_cuts():
    assert split_text("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5]
    assert split_text("One two. Three four. Five six.", 20) == ["One two.", "Three four.", "Five six."]
    assert split_text("aa\n\nbb\n\n" + "c" * 12, 10) == ["aa\n\nbb", "c" * 10, "c" * 2]


def test_overlap_only_under_the_same_headings(spark):
    rows = spark.createDataFrame([("p", 0, "abcdef", ["h"]), ("p", 1, "second", ["h"]), ("p", 2, "third", ["x"])], "path string, chunk_idx int, text string, heading_path array<string>")
    assert [r.text for r in chunking.overlapped(rows, 3).orderBy("chunk_idx").collect()] == ["abcdef", "def\n\nsecond", "third"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, list_idx int, retriever string, weight double, chunk_id string, rank int")


def test_fusion_weighs_lists(spark):
    single = fusion.fuse(hits(spark, [("q", 0, "bm25", 1.0, "a", 1)])).first()
    assert single.score == pytest.approx(1 / 11, abs=1e-9)
    both = fusion.fuse(hits(spark, [("q", 0, "bm25", 1.0, "a", 1), ("q", 0, "bm25", 1.0, "b", 2), ("q", 1, "vector", 1.0, "a", 1), ("q", 1, "vector", 1.0, "c", 2), ("q", 2, "x", 0.0, "z", 1)])).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in both] == ["a", "b", "c"] and both[0].retrievers == ["bm25", "vector"]
    for weights, first in (((4.0, 1.0), "lexical"), ((1.0, 4.0), "semantic")):
        rows = [("q", 0, "bm25", weights[0], "lexical", 1), ("q", 0, "bm25", weights[0], "semantic", 2), ("q", 1, "vector", weights[1], "semantic", 1), ("q", 1, "vector", weights[1], "lexical", 2)]
        assert fusion.fuse(hits(spark, rows)).orderBy("fused_rank").first().chunk_id == first
    assert fusion.fuse(hits(spark, [("q", 0, "bm25", 1.0, f"c{i}", i + 1) for i in range(12)]), candidates=8).count() == 8
    with pytest.raises(ValueError):
        fusion.fuse(hits(spark, []), k=float("nan"))


def ranked(spark, rows, query):
    return spark.createDataFrame([("q", query, *r) for r in rows], "query_id string, query string, chunk_id string, path string, heading_path array<string>, score double, fused_rank int")


def test_boosts(spark):
    rows = ranked(spark, [("1", "vietnam-war.md", [], 0.1, 1), ("2", "cold-war.md", [], 0.1, 2)], "vietnam war")
    assert [r.final_score for r in fusion.boosted(rows).orderBy("position").collect()] == pytest.approx([0.3, 0.2])
    rows = ranked(spark, [("1", "x.md", ["Authentication", "OAuth flow"], 0.1, 1), ("2", "y.md", ["OAuth notes"], 0.1, 2)], "oauth flow")
    assert [r.final_score for r in fusion.boosted(rows).orderBy("position").collect()] == pytest.approx([0.2, 0.15])
    rows = ranked(spark, [("1", "ancient/egypt.md", [], 0.031, 1), ("2", "people/alexander-the-great.md", [], 0.016, 2)], "alexander great")
    assert fusion.boosted(rows).orderBy("position").first().chunk_id == "2"


def test_tie_break_uses_terms_only_between_equals(spark):
    rows = spark.createDataFrame([("q", "deploy rollback runbook", "1", 0.3, 1, "talks about deploy only"), ("q", "deploy rollback runbook", "2", 0.3, 2, "deploy runbook rollback steps")], "query_id string, query string, chunk_id string, score double, fused_rank int, haystack string")
    assert [r.chunk_id for r in fusion.lexical_tie_break(rows).orderBy("fused_rank").collect()] == ["2", "1"]
    rows = spark.createDataFrame([("q", "deploy", "a", 0.5, 1, "no match"), ("q", "deploy", "b", 0.5, 2, "deploy deploy"), ("q", "deploy", "c", 0.4, 3, "deploy")], rows.schema)
    assert [r.chunk_id for r in fusion.lexical_tie_break(rows).orderBy("fused_rank").collect()] == ["b", "a", "c"]


def test_pages_are_collapsed_with_backfill(spark):
    rows = spark.createDataFrame([("q", "a#0", "a", 1), ("q", "a#1", "a", 2), ("q", "a#2", "a", 3), ("q", "b#0", "b", 4), ("q", "c#0", "c", 5)], "query_id string, chunk_id string, path string, position int")
    assert [r.path for r in fusion.final_top(fusion.first_of(rows, "path"), 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_reranker_failure_and_order(spark):
    rows = spark.createDataFrame([("q", f"c{i}", float(-i), i) for i in range(1, 4)], "query_id string, chunk_id string, final_score double, position int")

    def broken(_):
        raise TypeError("secret message")

    same, why = fusion.reranked(rows, broken)
    assert why == "reranker_error:TypeError" and same is rows
    moved, _ = fusion.reranked(rows, lambda r: r.where("position = 3").selectExpr("query_id", "chunk_id", "1 AS rerank_pos", "9.0D AS final_score"))
    assert [(r.chunk_id, r.final_score) for r in moved.orderBy("position").collect()] == [("c3", 9.0), ("c1", -1.0), ("c2", -2.0)]


def test_pieces_in_columns_equal_those_of_a_text_at_a_time(spark):
    import random

    rng = random.Random(3)
    words = ["one", "Two.", "three!", "\n\n", "\n \n", "four?", "x" * 30, "...", "é", "\n", "5.5"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 8, 40, 120])))) for i in range(300)] + [(800, ""), (801, None), (802, ". lost"), (803, "a. " * 50), (804, "\n\n" * 9)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.p for r in df.select("id", chunking.pieces_of(F.col("text"), 25).alias("p")).collect()}
    for i, t in rows:
        assert got[i] == (split_text(t, 25) if t else []), (i, t)


def test_snippets_in_columns_equal_those_of_a_row_at_a_time(spark):
    import random

    rng = random.Random(8)
    words = ["Paris", "in", "1999", "compress", "compression", "the", "ratio", "Dr.", "Smith", "went", "42%", "x_y", "no.", "Yes!", "why?", "a\n\nb", "écu", "comp", "ratio-ratio"]
    text = lambda: rng.choice(["", " ", "\n"]) + " ".join(rng.choices(words, k=rng.choice([2, 30, 90, 200]))) + rng.choice(["", " ", "."])
    asked = ["when did compression happen", "who is smith", "how many ratio", "", "the", "ratio compress comp", "where was x_y", None, "what year"]
    rows = [(i, text(), rng.choice(asked)) for i in range(400)] + [(900, None, "x"), (901, "", "ratio"), (902, "w" * 700, "ratio"), (903, "ratio " * 200, "ratio comp")]
    df = spark.createDataFrame(rows, "id int, text string, query string")
    got = {r.id: (r.shown, r.cut) for r in df.select("id", S.snippet(F.col("text"), F.col("query")).alias("shown"), S.around_terms(F.col("text"), F.array(F.lit("comp"), F.lit("ratio")), 120, F.lit(True)).alias("cut")).collect()}
    for i, t, q in rows:
        assert got[i] == ((None, None) if t is None else (make_snippet(t, q or ""), around_terms(t, ["comp", "ratio"], 120, True))), (i, t, q)


def test_limits_and_weights():
    assert fusion.limits(50) == (50, 50, 50) and fusion.limits() == (30, 30, 10) and fusion.limits(5.9)[2] == 5
    with pytest.raises(ValueError):
        fusion.limits(0)
    with pytest.raises(ValueError):
        fusion.check_weight("w", -1)


def test_bm25_and_vectors_find_the_page(spark):
    chunks = spark.createDataFrame([("a.md#0", "the quick brown fox"), ("b.md#0", "lazy dogs sleep, don't they"), ("c.md#0", "Élan vital")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "fox"), (2, "---"), (3, "don't"), (4, "elan"), (5, "")], "query_id int, query string")
    assert {(r.query_id, r.chunk_id) for r in retrieval.bm25(asked, chunks).collect()} == {(1, "a.md#0"), (3, "b.md#0"), (4, "c.md#0")}
    vectors = spark.createDataFrame([("a.md", [1.0, 0.0]), ("b.md", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    found = retrieval.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>"), vectors, 1).first()
    assert (found.chunk_id, found.distance, found["rank"]) == ("a.md", 0.0, 1)
    assert retrieval.nearest(asked.where("false").select("query_id", F.array(F.lit(0.0)).alias("embedding")), vectors, 1).count() == 0


def test_bm25_of_runs_and_repeats_equals_the_formula(spark):
    import math
    import re

    texts = {"a": "a-a a a b", "b": "x well-known fact", "c": "well known well-known well", "d": "", "e": "b b"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "well-known b"), (2, "a-a b b"), (3, "nothing")], "query_id int, query string")
    words = {c: re.findall("[a-z]+", t) for c, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)

    def score(query):
        out = {}
        for unit in ([u for u in re.findall("[a-z]+", w)] for w in query.split()):
            tf = {c: sum(w[i : i + len(unit)] == unit for i in range(len(w))) for c, w in words.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(words) - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for c, n in tf.items():
                if n:
                    out[c] = out.get(c, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[c]) / mean))
        return {c: round(s, 9) for c, s in out.items()}

    expected = {(q, c): s for q, text in ((1, "well-known b"), (2, "a-a b b"), (3, "nothing")) for c, s in score(text).items()}
    index = lexical.lexicon(chunks)
    assert {(r.query_id, r.chunk_id): r.score for r in lexical.scores(asked, index).collect()} == pytest.approx(expected)
    for found in (retrieval.bm25(asked, chunks), retrieval.bm25(asked, index=index)):
        assert {(r.query_id, r.chunk_id): r.score for r in found.collect()} == pytest.approx(expected)


def test_pruned_top_k_equals_scoring_everything(spark, monkeypatch):
    import random

    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(9000)]
    texts = [(f"d{i}.md#{i % 3}", " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(600)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 8)) + [f"{a}-{b}" for a, b in [rng.sample(words, 2)] if i % 3 == 0])) for i in range(40)], "query_id int, query string")
    index = lexical.lexicon(chunks)
    want = sorted(map(tuple, lexical.top(lexical.scores(asked, index), 5).collect()))
    assert sorted(map(tuple, lexical.bm25(asked, index, 5).collect())) == want
    assert sorted(map(tuple, retrieval.bm25(asked, chunks, 5).collect())) == want
    share = lexical.scored_share(asked, index, 5).agg(F.sum("candidates"), F.sum("postings")).first()
    assert share[0] < share[1] / 3


def test_nearest_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from lexiloom.operators import nearest as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    monkeypatch.setattr(module, "PACK_CELLS", 1)  # 16 queries a pack
    monkeypatch.setattr(module, "PACKS", 1)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (300, 6)).astype(float)  # many ties
    x = np.concatenate([x, np.repeat(x[3:4], 120, axis=0), 50 + rng.normal(size=(300, 6))])  # one vector often, a far cluster
    vectors = spark.createDataFrame([(f"c{i:03}", v) for i, v in enumerate(x.tolist())], "chunk_id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 14)], "query_id int, embedding array<double>")
    expected = {(q, f"c{i:03}", r + 1) for q in range(0, 700, 14) for r, i in enumerate(np.lexsort((np.arange(len(x)), np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)))[:7])}
    index = retrieval.vector_index(vectors)
    for found in (retrieval.nearest(asked, vectors, 7), retrieval.nearest(asked, k=7, index=index)):
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in found.collect()} == expected
    share = module.compared(asked, index, 7).first()
    assert share.pairs == 50 * len(x) and share.compared < share.pairs / 2
    few = retrieval.nearest(asked, vectors.where("chunk_id < 'c003'"), 7)
    assert few.groupBy("query_id").count().where("count = 3").count() == 50
    assert retrieval.nearest(asked, vectors.where("false"), 7).collect() == []


def test_settings_come_from_file_and_environment(tmp_path):
    (tmp_path / "s.json").write_text('{"final": 5, "formats": ["md", "csv"], "dedup_by_page": false}')
    env = config.read_env("# c\nexport LEXILOOM_FINAL='7'\nLEXILOOM_RRF_K=2.5\nLEXILOOM_LEXICAL_TIE_BREAK=1\nodd line\n")
    got = load_settings(env, str(tmp_path / "s.json"), candidates=40)
    assert (got.final, got.formats, got.dedup_by_page, got.rrf_k, got.lexical_tie_break, got.candidates) == (7, ("md", "csv"), False, 2.5, True, 40)
    for bad in ({"LEXILOOM_FINAL": "many"}, {"LEXILOOM_DEDUP_BY_PAGE": "perhaps"}, {"LEXILOOM_FINAL": "0"}):
        with pytest.raises(ValueError):
            load_settings(bad)
    (tmp_path / "s.json").write_text('{"finale": 5}')
    with pytest.raises(ValueError):
        load_settings({}, str(tmp_path / "s.json"))


def test_nested_frontmatter_and_block_scalars():
    text = "owner:\n  name: Ann\n  at:\n    city: X # c\n    list:\n      - 1\n      - k: v\n        w: {a: 1, b: [x, 'y, z']}\ntags:\n- a\n-\n  - n\nbody: |\n  line\n    more\n\n  last\nfold: >-\n  a\n  b\n\n  c\nnone:\n__proto__: x\n"
    assert markdown.parse_yaml(text) == {
        "owner": {"name": "Ann", "at": {"city": "X", "list": [1, {"k": "v", "w": {"a": 1, "b": ["x", "y, z"]}}]}}, "tags": ["a", ["n"]], "body": "line\n  more\n\nlast\n", "fold": "a b\nc", "none": None,
    }
    for bad in ("tags: [a", "just text", "a: 1\n   b: 2", "a: 'x", "- a\n- b", "m: {a"):
        with pytest.raises(ValueError, match="frontmatter line"):
            markdown.parse_yaml(bad)


def test_hash_embedding_is_a_unit_vector(spark):
    import hashlib

    found = one(spark, hash_embedding(F.col("t"), 20), t="hello")
    raw = [int(hashlib.sha256(f"{i}|hello".encode()).hexdigest()[4 * j : 4 * j + 4], 16) / 65535 * 2 - 1 for i in (0, 16) for j in range(16)][:20]
    norm = sum(x * x for x in raw) ** 0.5
    assert found == pytest.approx([x / norm for x in raw], abs=1e-12)
    assert chunk_size_for(512) == 435 and chunk_size_for(10_000) == 512
    rows = embed_with(spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string"), lambda: lambda texts: [[float(len(t))] for t in texts])
    assert {r.id: r.embedding for r in rows.collect()} == {1: [2.0], 2: [0.0]}


def test_metrics_of_known_runs(spark):
    cases = spark.createDataFrame([("one", "exact", True), ("none", "unanswerable", False)], "case_id string, query_class string, answerable boolean")
    judged = spark.createDataFrame([("one", "deploy", 3), ("one", "rollback", 2)], "case_id string, path string, relevance int")
    ranked_ = spark.createDataFrame([("one", p, i + 1) for i, p in enumerate(("unrelated", "deploy", "other", "rollback"))] + [("none", "x", 1)], "case_id string, path string, rank int")
    got = {r.case_id: r for r in evaluation.case_results(cases, judged, ranked_, ranked_).collect()}
    assert (got["one"].recall_1, got["one"].recall_5, got["one"].mrr, got["one"].wrong_source) == (0, 1, 0.5, True)
    assert got["none"].recall_1 is None and got["none"].ndcg_5 is None and got["none"].wrong_source
    ideal = spark.createDataFrame([("one", "deploy", 1), ("one", "rollback", 2)], "case_id string, path string, rank int")
    assert evaluation.case_results(cases, judged, ideal, ideal).where("case_id = 'one'").first().ndcg_5 == 1
    times = evaluation.latency(spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 100)], "ms int")).first()
    assert (times.p50, times.p95, times.max) == (3, 100, 100)


def test_evidence_keeps_to_the_budget(spark):
    rows = spark.createDataFrame([("q", "a", "x" * 40, 1), ("q", "b", "y" * 40, 2), ("q", "a", "again", 3)], "query_id string, chunk_id string, snippet string, rank int")
    assert [r.citation_id for r in evidence.selected(rows, 10).collect()] == ["S1"]
    cut = evidence.selected(rows, 12).orderBy("rank").collect()
    assert [r.text for r in cut] == ["x" * 40, "y" * 7 + "…"]
    claims = spark.createDataFrame([("q", "c", "a"), ("q", "c", "b"), ("q", "c", "zzz"), ("q", "d", "a")], "query_id string, conflict_id string, chunk_id string")
    assert [(r.conflict_id, r.passage_ids) for r in evidence.conflicts(claims, evidence.selected(rows, 100)).collect()] == [("c", ["S1", "S2"])]
    noted = spark.createDataFrame([("q", " a  b "), ("q", "a b"), ("q", " ")], "query_id string, gap string")
    assert [r.gap for r in evidence.gaps(noted).collect()] == ["a b"]


def test_incremental_counts(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    old, new = table([("a", "1"), ("b", "2"), ("c", "3")]), table([("a", "1"), ("b", "9")])
    counts = maintenance.index_counts(maintenance.changes(old, new), spark.createDataFrame([("b", 0), ("b", 1)], "path string, chunk_idx int")).first()
    assert tuple(counts) == (1, 1, 1, 2)
    assert [r.path for r in maintenance.to_index(old, new).collect()] == ["b"]
    assert [r.path for r in maintenance.to_delete(old, new).collect()] == ["c"]


def test_embedder_change(spark):
    meta = spark.createDataFrame([("embedder_model", "model-a"), ("embedder_dim", "4")], "key string, value string")
    assert tuple(maintenance.embedder_state(meta, "model-a", 4).first()) == (False, "model-a")
    assert tuple(maintenance.embedder_state(meta, "model-b", 4).first()) == (True, "model-a")
    assert tuple(maintenance.embedder_state(meta.limit(0), "model-b", 4).first()) == (False, None)


def test_health_of_one_page(spark):
    facts = spark.createDataFrame([("a.md", "Guide", True, 1, "s", 0, 1, "short"), ("b.md", "guide ", False, 1, "s", 1, 1, "x" * 300), ("c.md", None, False, 0, "t", 0, 0, "")], "path string, title string, frontmatter_empty boolean, chunk_count int, sha256 string, heading_chunks int, total_chunks int, first_chunk_text string")
    disk = spark.createDataFrame([("a.md", None), ("b.md", "Other"), ("new.md", None)], "path string, h1 string")
    found = health.findings(facts, disk)
    got = {(r.check, r.path) for r in found.collect()}
    assert got == {("not-indexed", "new.md"), ("unfindable", "c.md"), ("duplicate-body", "a.md"), ("duplicate-body", "b.md"), ("duplicate-title", "a.md"), ("duplicate-title", "b.md"), ("no-structure", "a.md"), ("thin-page", "a.md"), ("no-frontmatter", "a.md"), ("no-h1", "a.md"), ("title-mismatch", "b.md")}
    assert {r.severity: r.n for r in health.severity_counts(found).collect()} == {"error": 4, "warn": 3, "info": 4}
    assert {r.check: r.hint for r in found.collect()} == {c: health.HINTS[c] for c in {r.check for r in found.collect()}}
    assert {(r.check, r.key, r.path) for r in health.duplicate_members(facts).collect()} == {("duplicate-body", "s", "a.md"), ("duplicate-body", "s", "b.md"), ("duplicate-title", "guide", "a.md"), ("duplicate-title", "guide", "b.md")}
    assert health.failed(found).first().failed and not health.failed(found, strict=False).first().failed and not health.failed(found.where("severity = 'info'")).first().failed


def test_attributes_filters_and_pages(spark):
    rows = spark.createDataFrame([("a", "A", '{"tags": ["x", 1], "n": 2, "o": {"k": 1}, "z": null, "constructor": 1}'), ("b", "B", "{}")], "path string, title string, frontmatter string")
    attrs = pages.page_attrs(rows)
    assert {(r.path, r.key, r.value) for r in attrs.collect()} == {("a", "tags", "x"), ("a", "tags", "1"), ("a", "n", "2")}
    assert [r.path for r in pages.list_pages(rows, attrs, {"tags": "x", "n": "2"}).collect()] == ["a"]
    assert [r.path for r in pages.list_pages(rows, attrs, sort="-path", limit=1).collect()] == ["b"]
    assert pages.parse_filters({"filter[a]": "1", "sort": "x"}) == {"a": "1"} and pages.parse_int("900", 50, 1, 500) == 500
    with pytest.raises(ValueError):
        pages.parse_int("many", 50, 1, 500)


def test_folder_walk(spark, tmp_path):
    for name, text in {"keep.md": "k", "drafts/x.md": "d", "node_modules/y.md": "n", "_private/z.md": "p", "sub/deep.MD": "s", "note.txt": "t", "big.md": "b" * 200, "skip.md": "i", ".gitignore": "skip.md\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.walk(spark, str(tmp_path), max_bytes=100)
    assert {r.path: r.text for r in got.collect()} == {"keep.md": "k", "sub/deep.MD": "s"}
    assert {r.path for r in files.walk(spark, str(tmp_path), respect_ignore_files=False).collect()} == {"keep.md", "sub/deep.MD", "big.md", "skip.md"}
    assert {r.path for r in files.scan_disk(spark, str(tmp_path)).collect()} == {"keep.md", "sub/deep.MD", "big.md", "skip.md"}
    assert files.read_one(spark, str(tmp_path), "sub/deep.MD").first().text == "s"
    with pytest.raises(ValueError):
        files.inside("/root", "../etc")


def test_markdown_parsing(spark):
    text = "---\ntitle: 'It''s'\ntags: [a, \"b\"]\nlist:\n  - 1\n  - two\nn: 3.5\n---\n# Title *em*\n\nA [link](u) and `code`.\nSame paragraph.\n\n- one\n- two\n\n```\n# not a heading\n```\n\n> quoted\n"
    rows = markdown.parse_pages(spark.createDataFrame([("a.md", text), ("b.md", "---\nbad: [1\n---\nx"), ("c.md", "plain")], "path string, text string")).collect()
    got = {r.path: r for r in rows}
    assert got["a.md"].plain == "# Title em\n\nA link and code.\nSame paragraph.\n\none\ntwo\n\n    # not a heading\n\nquoted"
    assert got["a.md"].frontmatter == '{"title": "It\'s", "tags": ["a", "b"], "list": [1, "two"], "n": 3.5}'
    assert got["b.md"].error and got["b.md"].plain is None and got["c.md"].plain == "plain"
    md = "| a | b |\n| --- | :---: |\n|  |  |\n| # x | y \\| z |\n- [ ] item\n2. two\n> q\n```\n| raw |\n```\n\n\n\n# H\n\n# H\nend"
    assert one(spark, markdown.normal_markdown(F.col("t")), t=md) == "a | b\n\\# x | y | z\nitem\ntwo\nq\n```\n| raw |\n```\n\n# H\n\nend"


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("# A\n# A\nx", "# A\nx"), ("# A\n\n# A\nx", "# A\n\nx"), ("# A\n \n# A\n\n# A \nx\n# A", "# A\n \n\nx\n# A"), ("x\n\n", "x\n\n"), ("", ""), ("# A\n## A\n# A", "# A\n## A\n# A"),
    ],
)
def test_repeated_headings_go(spark, text, plain):
    assert one(spark, markdown.drop_repeated_headings(F.col("t")), t=text) == plain


def test_fences_stay_as_they_are(spark):
    md = "- a\r\n```\n- raw\n| --- |\n```\n- b\n~~~ x\n> raw\n\n- open"
    assert one(spark, markdown.normal_blocks(F.col("t")), t=md) == "a\n```\n- raw\n| --- |\n```\nb\n~~~ x\n> raw\n\n- open"
    assert one(spark, F.length(markdown.normal_markdown(F.repeat(F.lit("- line\n# h\n"), 30_000))), t="") > 100_000


def test_converted_and_csv_pages(spark, tmp_path):
    (tmp_path / "s.csv").write_text('service,tier\napi,"1, high"\n')
    assert markdown.csv_pages(spark, str(tmp_path)).first().plain == "service | tier\napi | 1, high"

    def convert(data):
        if data == b"bad":
            raise RuntimeError("broken file")
        return "# Name\n\ntext"

    rows = markdown.converted_pages(spark.createDataFrame([("a.docx", b"x"), ("b.docx", b"bad")], "path string, bytes binary"), convert).collect()
    assert {r.path: (r.title, r.plain, r.error) for r in rows} == {"a.docx": ("Name", "# Name\n\ntext", None), "b.docx": (None, "", "RuntimeError: broken file")}
    with pytest.raises(ValueError):
        markdown.format_of(F.col("p"), ["odd"])


def test_questions(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "q", "queryClass": "exact", "relevant": [{"path": "a", "relevance": 3}], "answerable": true}\n\nnot json\n')
    cases, bad = questions.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert cases.first().relevant[0].relevance == 3 and [r.line_number for r in bad.collect()] == [3]
    assert evaluation.violations(cases).count() == 0


def test_change_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", "add", "2024-01-01 00:00:00", 1), ("a", "change", "2024-01-01 00:00:01", 2), ("b", "unlink", "2024-01-01 00:00:02", 3)], "path string, op string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    stream = changes.read_changes(spark, str(tmp_path / "log"), log.schema)
    changes.apply_batches(stream, lambda batch, n: seen.extend((r.path, r.op) for r in batch.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen) == [("a", "change"), ("b", "unlink")]
    state = log.where("seq < 3").select("path", "op", "ts").limit(1)
    assert {r.path for r in changes.merge_state(state, changes.last_operation(log).select("path", "op", "ts")).collect()} == {"a"}
    bursts = changes.bursts(log, "1500 milliseconds")
    assert [r.changes for r in bursts.collect()] == [3]


def test_search_end_to_end(spark):
    rows = [("ops/deploy-guide.md", "Deploy guide", "{}", "# Deploy\n\nHow to deploy the service.\n\n## Rollback\n\nRun the rollback script."), ("misc/cats.md", "Cats", "{}", "# Cats\n\nCats sleep all day.")]
    settings = Settings(embedding_dims=16)
    index = search.build_index(spark.createDataFrame(rows, "path string, title string, frontmatter string, plain string"), settings)
    asked = spark.createDataFrame([(1, " deploy  rollback "), (2, " ")], "query_id int, query string")
    found = search.search(asked, index, settings).orderBy("query_id", "rank").collect()
    assert [r.path for r in found] == ["ops/deploy-guide.md", "misc/cats.md"] and "bm25" in found[0].retrievers
    tie = search.search(asked, index, load_settings({"LEXILOOM_FORMATS": "md,csv"}, lexical_tie_break=True, embedding_dims=16, final=1))
    assert tie.count() == 1
    with pytest.raises(ValueError):
        Settings(chunk_overlap=0.9)
    assert "md" in capabilities()["built_in_formats"]


def test_timings_are_rows(spark):
    from lexiloom.plans import timing

    pages = spark.createDataFrame([("a.md", "A", "{}", "alpha beta"), ("b.md", "B", "{}", "beta gamma")], "path string, title string, frontmatter string, plain string")
    index, settings = search.build_index(pages, Settings(embedding_dims=16)), Settings(embedding_dims=16)
    asked = spark.createDataFrame([(2, "gamma"), (1, "alpha")], "query_id int, query string")
    results, stages = timing.search_stages(asked, index, settings)
    plain = search.search(asked, index, settings)
    assert sorted(map(str, results.collect())) == sorted(map(str, plain.collect()))
    rows = stages.orderBy("at").collect()
    assert [r.stage for r in rows] == ["queries", "retrieve", "rank", "show"] and all(r.seconds > 0 for r in rows) and rows[0]["rows"] == 2
    ranked, latency = timing.run_cases(asked, lambda one: search.search(one, index, settings), warm_ups=1)
    assert {(r.case_id, r.path) for r in ranked.where("rank = 1").collect()} == {(1, "a.md"), (2, "b.md")}
    assert [r.case_id for r in latency.orderBy("case_id").collect()] == [1, 2] and latency.where("latency_ms > 0").count() == 2
