import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexiloom.llm import queries, quality
from lexiloom.llm.common import table
from tests.llm.test_bpe_ann import brute as brute_codec
from tests.llm.test_dedup import ASCII, brute_components, brute_exact, slow_fingerprint
from tests.llm.test_pages_chat import brute_url
from tests.llm.test_secrets_packing_quality import brute_pieces, brute_spans

COLUMNS = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op7_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op9_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op10_chat_format": ["conv_id", "turn", "role", "message"],
}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_with_the_stated_columns(spark, sf_dir, name):
    assert entry.queries()[name] is queries.QUERIES[name]
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]


def test_whole_tables_equal_brute_force(spark, sf_dir, documents):
    run = lambda name: queries.QUERIES[name](spark, sf_dir).collect()
    spans = {i: brute_spans(t or "") for i, t in documents}
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in run("op1_secret_scan")} == {i: tuple(sum(k == x for _, k, _ in s) for x in range(3)) for i, s in spans.items()}
    assert sum(map(len, spans.values())) > 5
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in run("op2_best_fit_packing")) == brute_pieces(documents)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in run("op4_exact_dedup")) == brute_exact(documents)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run("op5_simhash_near_dedup")) == brute_components([(i, slow_fingerprint(t or "")) for i, t in documents])
    urls = {r.page_id: r.url for r in table(spark, sf_dir, "pages").collect()}
    for r in run("op3_url_filter"):
        host, path, best = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and (best is None or r.verdict == best[0])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_says_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for table_name in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table_name} AS SELECT * FROM '{sf_dir}/{table_name}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf_dir)
    assert found.columns == [d[0] for d in cursor.description]
    order = lambda r: repr(r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(cursor.fetchall(), key=order)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    found = [r for r in queries.QUERIES["op6_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(found) > 80
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.93
    good, bad = ([r.score for r in found if truth[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_codec_over_the_whole_table_equals_the_library(spark, sf_dir, documents):
    found = queries.QUERIES["op7_bpe_codec"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == brute_codec(documents)


def mask(text):
    """Base spans replaced, overlapping ones as one."""
    out, at = "", 0
    for start, _, end in brute_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, sf_dir):
    names = table(spark, sf_dir, "documents").columns
    kept = corpus_pipeline.STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir)
    assert kept.columns == names
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    winners = {keep for _, keep, _, _ in brute_exact(rows)}
    rows = [x for x in rows if x[0] in winners]
    stay = {c for _, _, c in brute_components([(i, slow_fingerprint(t or "")) for i, t in rows])}
    rows = [(i, mask(t or "")) for i, t in rows if i in stay]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == brute_pieces(rows)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()


def test_hold_out_rule_is_the_stated_one():
    assert {i for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert re.fullmatch(r"[a-z0-9_]+", "_".join(quality.STATISTICS)) and len(set(quality.STATISTICS)) == len(quality.STATISTICS)
    assert hashlib.sha256("ABC".translate(ASCII).encode()).hexdigest() == hashlib.sha256(b"abc").hexdigest()
