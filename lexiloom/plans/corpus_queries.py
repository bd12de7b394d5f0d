"""Queries of page metadata, maintenance, health, evaluation, evidence and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import canonical
from ..operators import evaluation, evidence, fusion, health, maintenance, retrieval
from ..operators import pages as P
from ..operators.lexical import small
from ..operators.store import IndexStore
from ..sources import files
from ..storage import new_folder, stored
from ..streaming import changes
from . import frames
from .frames import CHUNKS, MANIFEST, PAGES, SNAPSHOTS, chunks, labelled_pages, line_index, manifest, pages, queries, snapshots, table
from .registry import query
from .search_queries import LISTS, lists

ATTRS = PAGES + ", lab_ AS (SELECT p.*, quality, toxic FROM pages_ p LEFT JOIN labels USING (doc_id)), attrs_ AS (SELECT path, 'lang' AS key, lang AS value FROM lab_ UNION ALL SELECT path, 'source', source FROM lab_ UNION ALL SELECT path, 'quality', CAST(quality AS VARCHAR) FROM lab_ WHERE quality IS NOT NULL UNION ALL SELECT path, 'toxic', CAST(toxic AS VARCHAR) FROM lab_ WHERE toxic IS NOT NULL)"


def attrs(spark, sf):
    return P.page_attrs(labelled_pages(spark, sf))


@query("i01_unchanged_skip", f"WITH {SNAPSHOTS} SELECT n.path, n.sha256 FROM new_ n LEFT JOIN old_ o USING (path) WHERE o.sha256 IS DISTINCT FROM n.sha256")
def _(spark, sf):
    return maintenance.to_index(*snapshots(spark, sf)).select("path", "sha256")


@query("i02_delete_sweep", f"WITH {SNAPSHOTS} SELECT path FROM old_ WHERE path NOT IN (SELECT path FROM new_)")
def _(spark, sf):
    return maintenance.to_delete(*snapshots(spark, sf)).select("path")


@query("i03_reconcile", f"WITH {SNAPSHOTS} SELECT path, CASE WHEN n.sha256 IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'skipped' ELSE 'indexed' END AS action FROM old_ o FULL JOIN new_ n USING (path)")
def _(spark, sf):
    return maintenance.changes(*snapshots(spark, sf)).select("path", "action")


@query("i03_reconcile_counts", f"WITH {SNAPSHOTS}, c AS (SELECT CASE WHEN n.sha256 IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'skipped' ELSE 'indexed' END AS action FROM old_ o FULL JOIN new_ n USING (path)) SELECT count(*) FILTER (action = 'indexed') AS files_indexed, count(*) FILTER (action = 'skipped') AS files_skipped, count(*) FILTER (action = 'deleted') AS files_deleted, count(*) FILTER (action = 'indexed') AS chunks_added FROM c")
def _(spark, sf):
    old, new = snapshots(spark, sf)
    return maintenance.index_counts(maintenance.changes(old, new), new)


@query("i04_error_isolation", f"WITH {PAGES} SELECT path, 'frontmatter line 1: unclosed list' AS error FROM pages_ WHERE doc_id % 7 = 3")
def _(spark, sf):
    """Every seventh page has broken frontmatter: those are reported, the others parse."""
    from ..sources.markdown import parse_pages

    block = F.when(F.col("doc_id") % 7 == 3, "tags: [a").otherwise("tags: [a]")
    raw = pages(spark, sf).select("path", F.concat(F.lit("---\n"), block, F.lit("\n---\n"), "text").alias("text"))
    return maintenance.split_errors(parse_pages(raw))[1]


@query("i05_manifest", f"WITH {MANIFEST} SELECT path, sha256, chunk_count FROM manifest_")
def _(spark, sf):
    return manifest(spark, sf).select("path", "sha256", "chunk_count")


@query("i08_sizes", f"WITH {PAGES} SELECT path, length(text) AS chars, strlen(text) AS bytes FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


@query("i09_i11_upsert", f"WITH {SNAPSHOTS} SELECT path, sha256 FROM new_ UNION ALL SELECT path, sha256 FROM old_ WHERE path NOT IN (SELECT path FROM new_)")
def _(spark, sf):
    old, new = snapshots(spark, sf)
    return maintenance.upsert(old, new)


@query("i10_i13_delete_by_path", f"WITH {CHUNKS} SELECT count(*) AS chunks_removed FROM chunks_ WHERE path IN (SELECT path FROM pages_ WHERE source = 'src3')")
def _(spark, sf):
    own, gone = chunks(spark, sf), pages(spark, sf).where("source = 'src3'")
    return own.join(maintenance.delete(own, gone).select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("chunks_removed"))


@query("i12_page_attrs", f"WITH {ATTRS} SELECT * FROM attrs_")
def _(spark, sf):
    return attrs(spark, sf)


@query("i14_embedder_change", "SELECT true AS changed, 'hash-' || max(len(embedding)) AS previous FROM embeddings")
def _(spark, sf):
    dim = table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).cast("string").alias("d"))
    rows = F.array(F.struct(F.lit("embedder_model").alias("key"), F.concat(F.lit("hash-"), "d").alias("value")), F.struct(F.lit("embedder_dim").alias("key"), F.col("d").alias("value")))
    meta = dim.select(F.explode(rows).alias("x")).select("x.*")
    return maintenance.embedder_state(meta, "hash-384", 384)


@query("i15_vector_dim", "SELECT max(len(embedding)) AS dim FROM embeddings")
def _(spark, sf):
    return maintenance.vector_dim(table(spark, sf, "embeddings"))


def history(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.sha2("props", 256).alias("sha256"), F.octet_length("props").alias("byte_size"), F.col("ts").alias("written_at"))


HISTORY_SQL = "history_ AS (SELECT event_id AS id, 'user-' || user_id AS path, sha256(props) AS sha256, strlen(props) AS byte_size, ts AS written_at FROM events)"


@query("i16_history_append", "SELECT row_number() OVER (ORDER BY n_chars, lang || '/' || source || '/doc-' || doc_id || '.md') AS id, lang || '/' || source || '/doc-' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS byte_size, json_object('lang', lang)::VARCHAR AS frontmatter FROM documents")
def _(spark, sf):
    own = pages(spark, sf).withColumn("frontmatter", F.to_json(F.struct("lang")))
    return maintenance.history_rows(own, F.col("n_chars")).select("id", "path", "sha256", "byte_size", "frontmatter")


@query("i17_history_newest", f"WITH {HISTORY_SQL} SELECT path, id FROM history_ WHERE path = (SELECT min(path) FROM history_) ORDER BY written_at DESC, id DESC LIMIT 10")
def _(spark, sf):
    h = history(spark, sf)
    return maintenance.history_of(h, h.agg(F.min("path")).first()[0]).select("path", "id")


@query("i18_history_lookup", f"WITH {HISTORY_SQL} SELECT id, path, sha256 FROM history_ WHERE id = (SELECT max(id) FROM history_)")
def _(spark, sf):
    h = history(spark, sf)
    return h.join(h.agg(F.max("id").alias("id")), "id", "left_semi").select("id", "path", "sha256")


@query("i19_w04_history_prune", f"WITH {HISTORY_SQL} SELECT id, path FROM history_ QUALIFY row_number() OVER (PARTITION BY path ORDER BY written_at DESC, id DESC) <= 5")
def _(spark, sf):
    return maintenance.newest(history(spark, sf), 5).select("id", "path")


@query("i20_stored_index", f"WITH {PAGES} SELECT path, sha256('---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text) AS sha256, regexp_matches(text, '\\S') AS has_chunks FROM pages_ WHERE source <> 'src1' UNION ALL SELECT path, sha256(text), regexp_matches(text, '\\S') FROM pages_ WHERE source = 'src1'")
def _(spark, sf):
    """All pages reconciled into a stored index, then those of one source saved anew with what they held as history."""
    store = IndexStore(spark, new_folder(spark, "index"), Settings())
    raw = pages(spark, sf).select("path", F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n"), "text").alias("text"), F.lit(None).cast("timestamp").alias("modified"), "source")
    raw = raw.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    store.reconcile(raw.drop("source"))
    edited = pages(spark, sf).where("source = 'src1'").select("path", "text")
    store.save(edited, raw.where("source = 'src1'").select("path", "text"))
    return store.read("manifest").select("path", "sha256", (F.col("chunk_count") > 0).alias("has_chunks"))


@query("i21_page_move", f"WITH {PAGES} SELECT doc_id, CASE WHEN path LIKE 'en/src1/%' THEN 'archive' || substr(path, 8) ELSE path END AS path FROM pages_")
def _(spark, sf):
    return maintenance.moved(pages(spark, sf).select("doc_id", "path"), "en/src1", "archive")


@query("i22_folder_members", f"WITH {PAGES} SELECT path FROM pages_ WHERE path LIKE 'en/src1/%'")
def _(spark, sf):
    return maintenance.under_folder(pages(spark, sf).select("path"), "en/src1")


@query("i23_json_artifact", f"WITH {ATTRS} SELECT json_object('path', path, 'title', title)::VARCHAR AS line FROM lab_")
def _(spark, sf):
    return labelled_pages(spark, sf).select(F.to_json(F.struct("path", "title")).alias("line"))


@query("p01_attribute_filter", f"WITH {ATTRS} SELECT path FROM pages_ WHERE path IN (SELECT path FROM attrs_ WHERE key = 'lang' AND value = 'de') AND path IN (SELECT path FROM attrs_ WHERE key = 'quality' AND value = '1')")
def _(spark, sf):
    return P.with_attrs(labelled_pages(spark, sf), attrs(spark, sf), {"lang": "de", "quality": "1"}).select("path")


@query("p02_contains", f"WITH {PAGES} SELECT path FROM pages_ WHERE lower(title) LIKE '%th_t%' OR lower(path) LIKE '%th_t%'")
def _(spark, sf):
    return P.containing(pages(spark, sf), "Th_t").select("path")


@query("p03_whitelist", f"WITH {PAGES} SELECT path, title, length(text) AS size FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", "title", F.length("text").alias("size"))


@query("p05_st4_log_tail", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(spark, sf):
    log = table(spark, sf, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("level"), "event_id")
    return changes.log_tail(log, "error").select("event_id")


@query("p06_access_filter", f"WITH {CHUNKS} SELECT chunk_id FROM chunks_ WHERE path IN (SELECT path FROM pages_ WHERE lang = 'fr')")
def _(spark, sf):
    return chunks(spark, sf).join(pages(spark, sf).where("lang = 'fr'").select("path"), "path", "left_semi").select("chunk_id")


@query("a01_page_count", f"WITH {ATTRS} SELECT count(*) AS total FROM pages_ WHERE path IN (SELECT path FROM attrs_ WHERE key = 'source' AND value = 'src5')")
def _(spark, sf):
    return P.with_attrs(labelled_pages(spark, sf), attrs(spark, sf), {"source": "src5"}).agg(F.count("*").alias("total"))


@query("a02_chunk_facts", f"WITH {CHUNKS} SELECT path, count(*) AS chunks, count(*) FILTER (chunk_idx > 0) AS with_headings FROM chunks_ GROUP BY path")
def _(spark, sf):
    heads = F.when(F.col("chunk_idx") > 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>"))
    return P.chunk_facts(chunks(spark, sf).withColumn("heading_path", heads))


@query("a03_attribute_keys", f"WITH {ATTRS} SELECT DISTINCT key FROM attrs_ ORDER BY key")
def _(spark, sf):
    return attrs(spark, sf).select("key").distinct().orderBy("key")


@query("a04_status", f"WITH {MANIFEST} SELECT count(*) AS pages, CAST(sum(chunk_count) AS BIGINT) AS chunks, max(sha256) AS last_indexed FROM manifest_")
def _(spark, sf):
    return P.status(manifest(spark, sf).withColumn("last_indexed", F.col("sha256")))


@query("o01_sort_pages", f"WITH {PAGES} SELECT path, title FROM pages_ ORDER BY title DESC NULLS LAST, path LIMIT 200")
def _(spark, sf):
    return P.list_pages(labelled_pages(spark, sf), attrs(spark, sf), sort="-title").select("path", "title")


@query("o02_sort_by_attribute", f"WITH {ATTRS} SELECT p.path FROM pages_ p LEFT JOIN (SELECT path, min(value) AS v FROM attrs_ WHERE key = 'quality' GROUP BY path) USING (path) ORDER BY v ASC NULLS FIRST, path LIMIT 500")
def _(spark, sf):
    return P.list_pages(labelled_pages(spark, sf), attrs(spark, sf), sort="quality", limit=9999).select("path")


@query("o03_page_of_pages", f"WITH {ATTRS} SELECT path, CASE WHEN t > 40 THEN to_base64(encode('40')) END AS cursor FROM (SELECT path FROM pages_ WHERE path IN (SELECT path FROM attrs_ WHERE key = 'lang' AND value = 'en') ORDER BY path LIMIT 20 OFFSET 20), (SELECT count(*) AS t FROM pages_ WHERE lang = 'en')")
def _(spark, sf):
    own, keys = labelled_pages(spark, sf), attrs(spark, sf)
    total = P.with_attrs(own, keys, {"lang": "en"}).agg(F.count("*").alias("t"))
    rows = P.list_pages(own, keys, {"lang": "en"}, limit=20, offset=20).select("path")
    return rows.crossJoin(total).select("path", P.next_cursor(F.col("t"), 20, 20).alias("cursor"))  # total: one row


@query("p04_query_string", f"WITH {ATTRS} SELECT path FROM pages_ WHERE path IN (SELECT path FROM attrs_ WHERE key = 'lang' AND value = 'de') AND path IN (SELECT path FROM attrs_ WHERE key = 'quality' AND value = '1') ORDER BY path LIMIT 30 OFFSET 2")
def _(spark, sf):
    """Filters, limit and offset as a query string names them."""
    params = {"filter[lang]": "de", "filter[quality]": "1", "limit": "30.9", "offset": " 2"}
    limit, offset = P.parse_int(params["limit"], P.DEFAULT_PAGE, 1, P.MAX_PAGE), P.parse_int(params["offset"], 0, 0, 1 << 31)
    return P.list_pages(labelled_pages(spark, sf), attrs(spark, sf), P.parse_filters(params), limit=limit, offset=offset).select("path")


FACTS = MANIFEST + """, facts_ AS (SELECT m.path, m.sha256, m.chunk_count, p.title, p.source = 'src5' AS frontmatter_empty, coalesce(total, 0) AS total_chunks, coalesce(heads, 0) AS heading_chunks, coalesce(f.text, '') AS first_chunk_text
  FROM manifest_ m JOIN pages_ p USING (path) LEFT JOIN (SELECT path, count(*) AS total, count(*) FILTER (chunk_idx % 4 = 3) AS heads FROM chunks_ GROUP BY path) USING (path) LEFT JOIN (SELECT path, text FROM chunks_ WHERE chunk_idx = 0) f USING (path) WHERE p.lang <> 'es'),
 disk_ AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' || title ELSE title || ' x' END AS h1 FROM pages_)"""
NORM = r"lower(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
DUP = "SELECT a.path, CASE WHEN a.path = lo THEN hi ELSE lo END || CASE WHEN n > 2 THEN ' and ' || (n - 2) || ' more' ELSE '' END AS other FROM {src} a JOIN (SELECT {key} AS k, count(*) AS n, min(path) AS lo, max(path) AS hi FROM {src} GROUP BY 1 HAVING n > 1) ON {key2} = k"
FINDINGS = {
    "d01_not_indexed": "SELECT 'not-indexed' AS \"check\", 'error' AS severity, path, CAST(NULL AS VARCHAR) AS detail FROM disk_ WHERE path NOT IN (SELECT path FROM facts_)",
    "d02_unfindable": "SELECT 'unfindable' AS \"check\", 'error' AS severity, path, '0 chunks' AS detail FROM facts_ WHERE chunk_count = 0",
    "d03_duplicate_body": "SELECT 'duplicate-body' AS \"check\", 'error' AS severity, path, 'identical to ' || other AS detail FROM (" + DUP.format(src="(SELECT * FROM facts_ WHERE chunk_count > 0)", key="sha256", key2="a.sha256") + ")",
    "d04_duplicate_title": "SELECT 'duplicate-title' AS \"check\", 'warn' AS severity, path, 'title shared with ' || other AS detail FROM (" + DUP.format(src="facts_", key=NORM.format("title"), key2=NORM.format("a.title")) + ")",
    "d05_structure": "SELECT CASE WHEN chunk_count >= 3 THEN 'wall-of-prose' ELSE 'no-structure' END AS \"check\", 'warn' AS severity, path, CASE WHEN chunk_count >= 3 THEN chunk_count || ' chunks, no headings' END AS detail FROM facts_ WHERE total_chunks > 0 AND heading_chunks = 0",
    "d06_thin_page": "SELECT 'thin-page' AS \"check\", 'info' AS severity, path, length(regexp_replace(first_chunk_text, '^\\s+|\\s+$', '', 'g')) || ' chars of body' AS detail FROM facts_ WHERE chunk_count = 1 AND length(regexp_replace(first_chunk_text, '^\\s+|\\s+$', '', 'g')) < 200",
    "d07_no_frontmatter": "SELECT 'no-frontmatter' AS \"check\", 'info' AS severity, path, CAST(NULL AS VARCHAR) AS detail FROM facts_ WHERE frontmatter_empty AND chunk_count > 0",
    "d08_h1": f"SELECT CASE WHEN h1 IS NULL THEN 'no-h1' ELSE 'title-mismatch' END AS \"check\", 'info' AS severity, path, CASE WHEN h1 IS NOT NULL THEN 'frontmatter \"' || title || '\" != H1 \"' || h1 || '\"' END AS detail FROM disk_ JOIN facts_ USING (path) WHERE h1 IS NULL OR {NORM.format('title')} <> {NORM.format('h1')}",
}
HINTS = "hints_ AS (" + " UNION ALL ".join(f"SELECT '{check}' AS \"check\", '{hint}' AS hint" for check, hint in health.HINTS.items()) + ")"
FOUND = FACTS + f", {HINTS}, found_ AS (SELECT * FROM (" + " UNION ALL ".join(FINDINGS.values()) + ") JOIN hints_ USING (\"check\"))"


def facts(spark, sf):
    """Facts of all pages but the Spanish ones, which are on disk only; every fourth chunk has a heading, one source no frontmatter."""
    own = pages(spark, sf)
    indexed = own.where("lang <> 'es'")
    heads = F.when(F.col("chunk_idx") % 4 == 3, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>"))
    made = frames.line_chunks(indexed).withColumn("heading_path", heads)
    info = indexed.select("path", "title", F.when(F.col("source") == "src5", "{}").otherwise('{"a": 1}').alias("frontmatter"))
    return health.page_facts(maintenance.manifest_of(indexed, made), info, made)


def disk(spark, sf):
    kind = F.col("doc_id") % 3
    return pages(spark, sf).select("path", F.when(kind == 1, F.concat(F.lit("  "), "title")).when(kind == 2, F.concat("title", F.lit(" x"))).alias("h1"))


@query("d00_page_facts", f"WITH {FACTS} SELECT path, title, frontmatter_empty, chunk_count, sha256, heading_chunks, total_chunks, first_chunk_text FROM facts_")
def _(spark, sf):
    return facts(spark, sf)


_CHECKS = {
    "d01_not_indexed": lambda f, d: health.not_indexed(d, f), "d02_unfindable": lambda f, d: health.unfindable(f), "d03_duplicate_body": lambda f, d: health.duplicate_bodies(f), "d04_duplicate_title": lambda f, d: health.duplicate_titles(f),
    "d05_structure": lambda f, d: health.unstructured(f), "d06_thin_page": lambda f, d: health.thin(f), "d07_no_frontmatter": lambda f, d: health.no_frontmatter(f), "d08_h1": lambda f, d: health.h1_checks(d, f),
}
for _name, _check in _CHECKS.items():
    query(_name, f"WITH {FACTS}, {HINTS} SELECT * FROM ({FINDINGS[_name]}) JOIN hints_ USING (\"check\")")(lambda spark, sf, check=_check: check(facts(spark, sf), disk(spark, sf)))


@query("d09_u02_findings", f"WITH {FOUND} SELECT \"check\", severity, path, detail, hint FROM found_")
def _(spark, sf):
    return health.findings(facts(spark, sf), disk(spark, sf)).drop("check_order")


@query("d09_a06_severity_counts", f"WITH {FOUND} SELECT s AS severity, count(path) AS n FROM (SELECT unnest(['error', 'warn', 'info']) AS s) LEFT JOIN found_ ON severity = s GROUP BY s")
def _(spark, sf):
    return health.severity_counts(health.findings(facts(spark, sf), disk(spark, sf)))


@query("d09_report", f"WITH {FOUND} SELECT severity, \"check\", path, detail, hint FROM found_ QUALIFY row_number() OVER (PARTITION BY \"check\" ORDER BY path) <= 20")
def _(spark, sf):
    return health.report(health.findings(facts(spark, sf), disk(spark, sf)))


@query("d09_strict_mode", f"WITH {FOUND} SELECT count(*) FILTER (severity = 'error') > 0 AS failed FROM found_")
def _(spark, sf):
    return health.failed(health.findings(facts(spark, sf), disk(spark, sf)))


@query("d03_d04_members", f"WITH {FACTS}, keyed_ AS (SELECT 'duplicate-body' AS \"check\", sha256 AS key, path FROM facts_ WHERE chunk_count > 0 UNION ALL SELECT 'duplicate-title', {NORM.format('title')}, path FROM facts_ WHERE title <> '') SELECT * FROM keyed_ QUALIFY count(*) OVER (PARTITION BY \"check\", key) > 1")
def _(spark, sf):
    return health.duplicate_members(facts(spark, sf))


@query("a05_group_members", f"WITH {PAGES} SELECT {NORM.format('title')} AS title, path FROM pages_ QUALIFY count(*) OVER (PARTITION BY {NORM.format('title')}) > 1")
def _(spark, sf):
    return health.members(pages(spark, sf), canonical(F.col("title"))).withColumnRenamed("key", "title")


@query("a05_duplicate_groups", f"WITH {PAGES} SELECT {NORM.format('title')} AS title, count(*) AS pages FROM pages_ GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return pages(spark, sf).groupBy(canonical(F.col("title")).alias("title")).agg(F.count("*").alias("pages")).where("pages > 1")


# Evaluation: a query is a vector, its relevant sources are all other vectors of its label, in three grades.
def cases_sql(skip: int = 0) -> str:
    """Results of the evaluation run that leaves out the first ``skip`` hits of every case."""
    return CASES.replace("{skip}", str(skip))


CASES = """base_ AS (SELECT vec_id, label, vec_id % 50 = 0 AS asked, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 cases_ AS (SELECT vec_id AS case_id, (['exact', 'semantic', 'ambiguous', 'multi_document', 'unanswerable'])[CAST(1 + (vec_id // 50) % 5 AS INT)] AS query_class, (vec_id // 50) % 5 <> 4 AS answerable, label, e FROM base_ WHERE asked),
 judged_ AS (SELECT case_id, 'v' || vec_id AS path, 1 + vec_id % 3 AS relevance FROM cases_ c JOIN base_ b USING (label) WHERE answerable AND vec_id <> case_id),
 near_ AS (SELECT case_id, 'v' || vec_id AS path, row_number() OVER (PARTITION BY case_id ORDER BY round(list_distance(c.e, b.e), 9), vec_id) AS rank FROM cases_ c, base_ b),
 cand_ AS (SELECT case_id, path, rank - {skip} AS rank FROM near_ WHERE rank > {skip} AND rank <= 20), ranked_ AS (SELECT * FROM cand_ WHERE rank <= 10),
 j_ AS (SELECT j.*, r.rank, c.rank AS candidate, row_number() OVER (PARTITION BY j.case_id ORDER BY relevance DESC, path) AS ideal FROM judged_ j LEFT JOIN ranked_ r USING (case_id, path) LEFT JOIN cand_ c USING (case_id, path)),
 per_ AS (SELECT case_id, count(*) FILTER (rank <= 1) / count(*) AS recall_1, count(*) FILTER (rank <= 5) / count(*) AS recall_5, count(*) FILTER (rank <= 10) / count(*) AS recall_10, count(candidate) / count(*) AS candidate_recall, coalesce(1 / min(rank), 0) AS mrr, coalesce(bool_or(rank = 1), false) AS top,
   coalesce(sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= 5) / sum((pow(2, relevance) - 1) / log2(ideal + 1)) FILTER (ideal <= 5), 0) AS ndcg_5, coalesce(sum((pow(2, relevance) - 1) / log2(rank + 1)) FILTER (rank <= 10) / sum((pow(2, relevance) - 1) / log2(ideal + 1)) FILTER (ideal <= 10), 0) AS ndcg_10 FROM j_ GROUP BY case_id),
 shown_ AS (SELECT case_id, count(*) AS n FROM ranked_ GROUP BY case_id),
 results_ AS (SELECT case_id, query_class, answerable, """ + ", ".join(f"CASE WHEN answerable THEN round(coalesce({m}, 0), 6) END AS {m}" for m in ("recall_1", "recall_5", "recall_10", "candidate_recall", "mrr", "ndcg_5", "ndcg_10")) + """,
   coalesce(n, 0) = 0 AS empty, CASE WHEN answerable THEN coalesce(n, 0) > 0 AND NOT coalesce(top, false) ELSE coalesce(n, 0) > 0 END AS wrong_source FROM cases_ LEFT JOIN per_ USING (case_id) LEFT JOIN shown_ USING (case_id))"""
SUMMARY = "count(case_id) AS cases, " + ", ".join(f"round(sum(CAST(round({m} * 1e6) AS BIGINT)) / count({m}) / 1e6, 6) AS {m}" for m in ("recall_1", "recall_5", "recall_10", "candidate_recall", "mrr", "ndcg_5", "ndcg_10")) + ", round(avg(CAST(empty AS DOUBLE)), 6) AS empty_rate, round(avg(CAST(wrong_source AS DOUBLE)), 6) AS wrong_source_rate"


def case_results(spark, sf, skip=0):
    from ..operators.retrieval import nearest, vector_index

    base = table(spark, sf, "embeddings")
    names = F.array(*map(F.lit, ("exact", "semantic", "ambiguous", "multi_document", "unanswerable")))
    nth, grade = F.floor(F.col("vec_id") / 50) % 5, 1 + F.col("vec_id") % 3
    cases = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.element_at(names, (1 + nth).cast("int")).alias("query_class"), (nth != 4).alias("answerable"), "label", "embedding")
    # A label's sources are counted by grade, not listed by case; the case itself isn't one of its sources.
    grades = base.groupBy("label", grade.alias("relevance")).agg(F.count("*").alias("held"))
    own = (F.col("relevance") == 1 + F.col("case_id") % 3).cast("long")
    graded = cases.where("answerable").select("case_id", "label").join(grades, "label").select("case_id", "relevance", (F.col("held") - own).alias("sources"))
    vectors = base.select(F.col("vec_id").alias("chunk_id"), "embedding")
    found = nearest(cases.select(F.col("case_id").alias("query_id"), "embedding"), vectors, 20, vector_index(vectors))
    shown = found.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("vec_id"), F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("path"), (F.col("rank") - skip).alias("rank")).where("rank > 0")
    hits = shown.join(base.select("vec_id", "label", grade.alias("relevance")), "vec_id").join(cases.where("answerable").select("case_id", "label"), ["case_id", "label"]).where("vec_id <> case_id")
    ranked = evaluation.distinct_paths(shown.drop("vec_id"), 10)
    return evaluation.graded_results(cases.select("case_id", "query_class", "answerable"), graded, hits.select("case_id", "path", "relevance", "rank"), ranked)


@query("v01_v05_case_metrics", f"WITH {cases_sql()} SELECT * FROM results_")
def _(spark, sf):
    return case_results(spark, sf)


@query("v06_a07_summary", f"WITH {cases_sql()} SELECT {SUMMARY} FROM results_")
def _(spark, sf):
    return evaluation.summary(case_results(spark, sf))


@query("v06_a08_class_summary", f"WITH {cases_sql()} SELECT c AS query_class, {SUMMARY} FROM (SELECT unnest(['exact', 'semantic', 'ambiguous', 'multi_document', 'contradictory', 'unanswerable']) AS c) LEFT JOIN results_ ON query_class = c GROUP BY c")
def _(spark, sf):
    return evaluation.class_summary(case_results(spark, sf))


DELTA = ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}" for m in evaluation.METRICS)
LATENCY = "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events"


@query("v07_run_comparison", f"WITH b AS (WITH {cases_sql()} SELECT {SUMMARY} FROM results_), a AS (WITH {cases_sql(2)} SELECT {SUMMARY} FROM results_), lb AS ({LATENCY} WHERE event_type <> 'purchase'), la AS ({LATENCY} WHERE event_type = 'purchase') SELECT {DELTA}, round(la.p50 - lb.p50, 6) AS p50, round(la.p95 - lb.p95, 6) AS p95, round(la.max - lb.max, 6) AS max FROM a, b, la, lb")
def _(spark, sf):
    """A run against one that loses the first two hits of every case; the latencies are those of two kinds of events."""
    events = table(spark, sf, "events")
    run = lambda skip, own: evaluation.summary(case_results(spark, sf, skip)).crossJoin(evaluation.latency(own, "value"))  # one row each
    return evaluation.compare(run(0, events.where("event_type <> 'purchase'")), run(2, events.where("event_type = 'purchase'")), [])


@query("v08_distinct_paths", f"WITH {LISTS}, p AS (SELECT query_id AS case_id, path, min(rank) AS rank FROM lex_ JOIN chunks_ USING (chunk_id) GROUP BY ALL) SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY rank, path) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rank, path) <= 10")
def _(spark, sf):
    index = line_index(spark, sf)
    hits = small(stored(retrieval.bm25(queries(spark, sf), index.chunks), "bm25")).join(index.chunks.select("chunk_id", "path"), "chunk_id").select(F.col("query_id").alias("case_id"), "path", "rank")
    return evaluation.distinct_paths(hits, 10)


@query("v09_regression_gate", f"WITH b AS (WITH {cases_sql()}, r AS (SELECT * FROM results_ UNION ALL SELECT * REPLACE ('overall' AS query_class) FROM results_) SELECT query_class, {SUMMARY} FROM r GROUP BY 1), a AS (WITH {cases_sql(2)}, r AS (SELECT * FROM results_ UNION ALL SELECT * REPLACE ('overall' AS query_class) FROM results_) SELECT query_class, {SUMMARY} FROM r GROUP BY 1) SELECT query_class, round(a.recall_5 - b.recall_5, 6) AS recall_5 FROM a JOIN b USING (query_class) WHERE round(a.recall_5 - b.recall_5, 6) < -0.02")
def _(spark, sf):
    return evaluation.regressions(case_results(spark, sf), case_results(spark, sf, 2))


@query("v09_comparable_runs", f"WITH {PAGES} SELECT unnest(['another corpus', 'other questions']) AS problem WHERE (SELECT count(*) FROM pages_ WHERE source = 'src1') > 0 AND (SELECT count(*) FROM benchmark) > 0")
def _(spark, sf):
    """A run over all pages and questions against one without the pages of a source, which asks in capitals."""
    own = pages(spark, sf).select("path", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.sha2(F.upper("text"), 256).alias("loud"))
    run = lambda files_, questions: files.corpus_hash(files_).crossJoin(files.corpus_hash(questions).withColumnRenamed("corpus_hash", "questions_hash"))  # one row each
    before = run(own.where("source <> 'src1'").select("path", "sha256"), asked.select("path", F.col("loud").alias("sha256")))
    return evaluation.comparable(before, run(own.select("path", "sha256"), asked.select("path", "sha256")))


@query("v10_rounding", "SELECT event_id, round(value, 6) AS value FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", evaluation.rounded(F.col("value")).alias("value"))


@query("a07_latency_percentiles", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events")
def _(spark, sf):
    return evaluation.latency(table(spark, sf, "events"), "value")


@query("s17_s18_question_checks", "SELECT vec_id AS case_id, 'answerable without sources' AS problem FROM embeddings WHERE vec_id % 4 = 1 UNION ALL SELECT vec_id, 'invalid class' FROM embeddings WHERE vec_id % 4 = 2 UNION ALL SELECT vec_id, 'repeated path' FROM embeddings WHERE vec_id % 4 = 3 UNION ALL SELECT vec_id, 'invalid relevance' FROM embeddings WHERE vec_id % 4 = 3")
def _(spark, sf):
    """Questions made from embeddings, three kinds of them broken."""
    kind = F.col("vec_id") % 4
    good = F.array(F.struct(F.concat(F.lit("v"), F.col("label").cast("string")).alias("path"), F.lit(2).alias("relevance")))
    relevant = F.when(kind == 1, F.slice(good, 1, 0)).when(kind == 3, F.concat(good, F.transform(good, lambda r: F.struct(r["path"].alias("path"), F.lit(7).alias("relevance"))))).otherwise(good)
    cases = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.lit("a query").alias("query"), F.when(kind == 2, "other").otherwise("exact").alias("query_class"), F.lit(True).alias("answerable"), relevant.alias("relevant"))
    return evaluation.violations(cases)


EVIDENCE = LISTS + r""", shown_ AS (SELECT query_id, chunk_id, path, score, retrievers, fused_rank AS rank, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM cand_ JOIN chunks_ USING (chunk_id) WHERE path NOT LIKE 'fr/%'),
 n_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM shown_ QUALIFY n <= 20), need_ AS (SELECT *, CAST(ceil(length(t) / 4) AS BIGINT) AS need FROM n_),
 used_ AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM need_),
 fit_ AS (SELECT query_id, 'S' || n AS citation_id, chunk_id, rank, path, score::DOUBLE AS score, retrievers, split_part(path, '/', 2) AS heading_path, CASE WHEN need <= 300 - used THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, CAST((300 - used) * 4 - 1 AS BIGINT)), '\s+$', ''), '[.…]+$', '') || '…' END AS text FROM used_ WHERE used < 300),
 evidence_ AS (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM fit_)"""


def passages(spark, sf, hits=None):
    """A page's source stands for its heading."""
    shown = line_index(spark, sf).chunks.select("chunk_id", "path", F.array(F.split("path", "/")[1]).alias("heading_path"), F.col("text").alias("snippet"))
    rows = stored(small(fusion.fuse(hits or lists(spark, sf))).join(shown, "chunk_id").withColumn("rank", F.col("fused_rank")), "passages")
    return evidence.selected(rows, 300, allowed=line_index(spark, sf).chunks.where("path not like 'fr/%'"))


@query("e01_e03_a10_evidence", f"WITH {EVIDENCE} SELECT query_id, citation_id, chunk_id, rank, text, tokens, path, heading_path, score, retrievers FROM evidence_")
def _(spark, sf):
    return passages(spark, sf).withColumn("heading_path", F.array_join("heading_path", " > ")).withColumn("retrievers", F.array_join("retrievers", ","))


@query("e04_conflicts", f"WITH {EVIDENCE}, claims_ AS (SELECT query_id, chunk_id, 'c' || (rank % 3) AS conflict_id FROM all_) SELECT query_id, conflict_id, string_agg(DISTINCT citation_id, ' ' ORDER BY citation_id) AS passage_ids FROM claims_ JOIN evidence_ USING (query_id, chunk_id) GROUP BY ALL HAVING count(DISTINCT citation_id) > 1")
def _(spark, sf):
    hits = lists(spark, sf)
    claims = hits.select("query_id", "chunk_id", F.concat(F.lit("c"), (F.col("rank") % 3).cast("string")).alias("conflict_id"))
    return evidence.conflicts(claims, passages(spark, sf, hits)).withColumn("passage_ids", F.array_join("passage_ids", " "))


@query("e05_gaps", r"SELECT DISTINCT conv_id AS query_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS gap FROM conversations WHERE regexp_matches(text, '\S')")
def _(spark, sf):
    return evidence.gaps(table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("gap")))


@query("e05_totals", f"WITH {EVIDENCE} SELECT query_id, count(*) AS passages, CAST(sum(tokens) AS BIGINT) AS tokens FROM evidence_ GROUP BY query_id")
def _(spark, sf):
    return evidence.totals(passages(spark, sf))


STREAM = "last_ops_ AS (SELECT 'user-' || user_id AS path, max_by(event_type, (ts, event_id)) AS op, max(ts) AS ts FROM events GROUP BY user_id)"


def change_log(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").alias("seq"))


@query("st2_coalesced_changes", f"WITH {STREAM} SELECT path, op, ts FROM last_ops_")
def _(spark, sf):
    return changes.last_operation(change_log(spark, sf))


@query("st2_debounced", """WITH e AS (SELECT 'user-' || user_id AS path, event_type AS op, ts, event_id AS seq FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
 b AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, seq) AS burst FROM g)
 SELECT path, first(op ORDER BY ts DESC, seq DESC) AS op, min(ts) AS started, count(*) AS changes FROM b GROUP BY path, burst""")
def _(spark, sf):
    """The event log as changes, each path's operations held until it has been quiet for six hours."""
    from ..streaming.watch import debounced

    return debounced(change_log(spark, sf), "6 hours")


@query("st1_change_stream", f"WITH {STREAM} SELECT path, op, ts FROM last_ops_")
def _(spark, sf):
    """The change log as a stream: each micro-batch is coalesced and appended, and the newest per path stands."""
    from ..streaming.changes import apply_batches, read_changes

    run = new_folder(spark, "change-stream")
    log = change_log(spark, sf)
    events = table(spark, sf, "events")
    stream = read_changes(spark, f"{sf}/events.parque[t]", events.schema).select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").alias("seq"))
    apply_batches(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{run}/state/batch={n}"), f"{run}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"{run}/state")
    return changes.last_operation(done.withColumn("seq", F.col("batch"))).select(*log.drop("seq").columns)


@query("st3_event_feed", "SELECT ts AS at, 'page.' || CASE event_type WHEN 'click' THEN 'changed' ELSE 'saved' END AS type, 'user-' || user_id AS path FROM events WHERE event_type IN ('click', 'purchase')")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "click", "page.changed").when(F.col("event_type") == "purchase", "page.saved").otherwise("other")
    return changes.feed(table(spark, sf, "events").select(F.col("ts").alias("at"), kind.alias("type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path")))
