"""The queries of the numbered operators over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, hard_negatives, html_extract, packing, pieces, quality, secrets, simhash, spelling, tool_chat, url_filter
from .common import new_folder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ledger takes in all documents as two deliveries, the English ones first, and reports on every path."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.BlobLedger(spark, new_folder(spark, "op1-ledger"))
    for delivery in (docs.where("lang <=> 'en'"), docs.where("not lang <=> 'en'")):
        ledger.scan(delivery)
    return ledger.report().select(F.col("path").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_chat.format_chat(table(spark, sf_dir, "conversations"), tool_chat.schema_table(spark))


def op11_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_best_fit_packing, op3_url_filter, op4_exact_dedup, op5_simhash_near_dedup, op6_quality_classifier, op7_bpe_codec, op8_nearest_neighbours, op9_html_extraction, op10_chat_format, op11_sentencepiece_codec, op12_hard_negatives, op13_spelling_variants)
} | {"pipeline": _pipeline}


def _crc_table() -> list[int]:
    """CRC-32 of each byte value, by its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1 for n in out]
    return out


def _spans_sql() -> str:
    """Matches of each kind with where they start: the lengths of all that stands between matches, and of the matches before."""
    any_case = "|".join("".join(c if not c.isalpha() else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = (("assign", f"({any_case})[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    each = [f"""SELECT r, {i} AS kind, '{name}' AS name, i, length(m) AS n, least_n, start FROM (
          SELECT r, i, m, length(g) >= {least} AS least_n, sum(length(s)) OVER before + sum(length(m)) OVER before - length(m) AS start
          FROM (SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(regexp_extract_all(t, '{p}', {group})) AS g, unnest(string_split_regex(t, '{p}')[:len(ms)]) AS s
            FROM (SELECT r, t, regexp_extract_all(t, '{p}') AS ms FROM d) WHERE len(ms) > 0) WINDOW before AS (PARTITION BY r ORDER BY i))""" for i, (name, p, group, least) in enumerate(kinds)]
    return " UNION ALL ".join(each)


ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), all_ AS ({_spans_sql()}),
        found AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) AS spans FROM all_ WHERE least_n GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob_id FROM d LEFT JOIN found USING (r)
    """,
    # The given pages hold no link between hosts; where there are some, distrust spreads by iteration.
    "op3_url_filter": """
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        j AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
        r AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j),
        s AS (SELECT host, count(*) FILTER (ruled = 'block') > 0.5 * count(*) AS blocked FROM r WHERE host <> '' GROUP BY host)
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN s USING (host)
    """,
    # The given conversations make no tool calls; a table that does is beyond SQL's JSON functions.
    "op10_chat_format": """
        SELECT c.conv_id, c.turn, c.role, to_json({'content': c.text, 'role': c.role})::VARCHAR AS message, 0::BIGINT AS n_calls, 0::BIGINT AS n_valid, p.turn AS links_to, c.turn::BIGINT * 1048576 AS position, true AS ordered
        FROM conversations c LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p ON c.role = 'assistant' AND p.conv_id = c.conv_id AND p.turn = c.turn - 1
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op12_hard_negatives": """
        WITH v_ AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s_ AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = v.label AS same, v.r, v.vec_id, list_inner_product(a.e, v.e)::BIGINT AS score FROM v_ a JOIN v_ v ON a.r <> v.r AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0),
        p_ AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS n FROM s_ WHERE same QUALIFY n <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id, s.r)::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p_ p JOIN s_ s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
    """,
    # CRC-32 over the bytes of a text; near words by what is left of them without one letter.
    "op13_spelling_variants": f"""WITH RECURSIVE
        runs_ AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
        low_ AS (SELECT d || ':' || x AS t, x AS w, count(*) AS m FROM (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM runs_ WHERE length(w) >= 7) GROUP BY ALL),
        bytes_ AS (SELECT w, m, list_transform(flatten(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)), lambda x: x::BIGINT) AS b FROM low_),
        hash_ AS (SELECT w, m, xor(list_reduce(b, lambda h, c: xor(h >> 8, ({_crc_table()}::BIGINT[])[(xor(h, c) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes_),
        word_ AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(m)::BIGINT AS n FROM hash_ GROUP BY 1 HAVING length(word) >= 7 AND sum(m) >= 2),
        less_ AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM word_)),
        near_ AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less_ a JOIN less_ b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less_ a JOIN word_ b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less_ a JOIN word_ b ON a.rest = b.word),
        best_ AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near_ GROUP BY word),
        form_ AS (SELECT word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM word_ LEFT JOIN best_ USING (word)),
        lead_ AS (SELECT word, word AS root FROM form_ UNION ALL SELECT l.word, f.form FROM lead_ l JOIN form_ f ON l.root = f.word WHERE f.form IS NOT NULL),
        root_ AS (SELECT l.word, l.root FROM lead_ l JOIN form_ f ON l.root = f.word WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM form_ JOIN root_ USING (word)""",
}
