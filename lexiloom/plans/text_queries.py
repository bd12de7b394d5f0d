"""Queries of scans, text functions, chunking and embedding over documents, benchmark passages and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import chunk_size_for, hash_embedding
from ..functions.snippet import around_terms, head, snippet
from ..operators import chunking
from ..sources import files, markdown, questions
from ..storage import hadoop_path, new_folder
from .frames import CHUNKS, PAGES, chunks, chunks_sql, pages, table
from .registry import query
from .snippet_sql import STOP, around_sql, head_sql, plain_pattern, snippet_sql, squash_ends

TERMS = ("thing", "tion", "rean", "und", "los", "eau")
QUESTION = "How many things happened in what year?"
SQUASH = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def terms_array():
    return F.array(*map(F.lit, TERMS))


def squash_sql(x: str) -> str:
    return SQUASH.format(x)


@query("s02_extension", f"WITH {PAGES} SELECT path, lower(regexp_extract(path, '[^/]+(\\.[^.]*)$', 1)) AS extension FROM pages_")
def _(spark, sf):
    p = pages(spark, sf)
    return p.select("path", T.extension(F.col("path")).alias("extension"))


@query("s03_size_cap", f"WITH {PAGES} SELECT path, strlen(text) AS bytes FROM pages_ WHERE strlen(text) <= 5242880")
def _(spark, sf):
    return pages(spark, sf).select("path", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= files.MAX_FILE_BYTES)


def content_folder(spark, sf) -> str:
    """The pages as Markdown files in the shared folder: one a language and source, a page after the other."""
    root = new_folder(spark, "content")
    rows = pages(spark, sf).select("lang", "source", "doc_id", F.col("text").alias("value")).repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    rows.drop("doc_id").write.partitionBy("lang", "source").text(root)
    path, store = hadoop_path(spark, root)
    for lang in store.listStatus(path):
        for source in store.listStatus(lang.getPath()) if lang.isDirectory() else ():
            part = next(f.getPath() for f in store.listStatus(source.getPath()) if f.getPath().getName().startswith("part-"))
            store.rename(part, hadoop_path(spark, f"{source.getPath()}/page.md")[0])
    return root


CONTENT = PAGES + ", files_ AS (SELECT 'lang=' || lang || '/source=' || source || '/page.md' AS path, string_agg(text || chr(10), '' ORDER BY doc_id) AS text FROM pages_ GROUP BY lang, source), small_ AS (SELECT * FROM files_ WHERE strlen(text) <= 5242880)"


@query("s01_folder_walk", f"WITH {CONTENT} SELECT path, sha256(text) AS sha256, length(text) AS chars FROM small_")
def _(spark, sf):
    return files.walk(spark, content_folder(spark, sf)).select("path", "sha256", F.length("text").alias("chars"))


@query("s05_binary_files", f"WITH {CONTENT} SELECT path, sha256(text) AS sha256, strlen(text) AS bytes, true AS no_text FROM small_")
def _(spark, sf):
    rows = files.walk(spark, content_folder(spark, sf), extensions=(), binary=(".MD",))
    return rows.select("path", "sha256", F.length("bytes").alias("bytes"), F.col("text").isNull().alias("no_text"))


@query("s06_one_file", f"WITH {CONTENT} SELECT path, sha256(text) AS sha256 FROM small_ WHERE path LIKE 'lang=en/source=src1/%'")
def _(spark, sf):
    return files.read_one(spark, content_folder(spark, sf), "lang=en/../lang=en/source=src1//page.md").select(F.lit("lang=en/source=src1/page.md").alias("path"), "sha256")


@query("s21_disk_scan", f"WITH {CONTENT} SELECT path, length(text) AS chars FROM files_")
def _(spark, sf):
    return files.scan_disk(spark, content_folder(spark, sf)).select("path", F.length("text").alias("chars"))


@query("s10_csv_pages", "SELECT c_custkey || ' | ' || c_name || ' | ' || c_nationkey AS line FROM customer")
def _(spark, sf):
    """Customers written as CSV, and the lines of the pages that its files make."""
    folder = new_folder(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").write.csv(folder)
    return markdown.csv_pages(spark, folder).select(F.explode(F.split("plain", "\n")).alias("line"))


@query("s17_question_file", "SELECT CAST(vec_id AS VARCHAR) AS case_id, 'exact' AS query_class, 1 AS sources FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT NULL, 'not JSON', 0 FROM embeddings WHERE vec_id % 10 = 3")
def _(spark, sf):
    """Questions made from embeddings as JSON lines, every tenth broken, with blank lines between."""
    folder = new_folder(spark, "questions")
    relevant = F.array(F.struct(F.concat(F.lit("v"), F.col("label").cast("string")).alias("path"), F.lit(2).alias("relevance")))
    line = F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"), F.lit("a query").alias("query"), F.lit("exact").alias("queryClass"), F.lit(True).alias("answerable"), relevant.alias("relevant")))
    table(spark, sf, "embeddings").select(F.concat(F.when(F.col("vec_id") % 10 == 3, F.lit("{")).otherwise(F.lit("")), line, F.lit("\n \n"))).write.text(folder)
    cases, bad = questions.read_questions(spark, folder)
    return cases.select("case_id", "query_class", F.size("relevant").alias("sources")).unionByName(bad.select(F.lit(None).cast("string").alias("case_id"), F.lit("not JSON").alias("query_class"), F.lit(0).alias("sources")))


@query("s04_ignore_rules", f"WITH {PAGES} SELECT path FROM pages_ WHERE NOT (regexp_matches(path, '^de/src1[0-9]*(/.+)?$') OR (regexp_matches(path, '(^|.*/)[^/]*7\\.md(/.+)?$') AND NOT regexp_matches(path, '^en/src7/.*')))")
def _(spark, sf):
    rules = ["# a comment", "", "*7.md", "!/en/src7/**", "/de/src1*"]
    return pages(spark, sf).where(~files.ignored(F.col("path"), rules)).select("path")


@query("s09_format_router", f"WITH {PAGES} SELECT path, 'md' AS format FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", markdown.format_of(F.col("path"), ["csv", "md"]).alias("format"))


def escaped(text):
    """Text as Markdown that means just that: marks escaped."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def lines_of(text):
    """Lines that aren't blank, without the white space around them."""
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("s07_frontmatter", f"WITH {PAGES}, l_ AS (SELECT path, {squash_sql('title')} AS title, lang, source, {LINES} AS l FROM pages_) SELECT path, '{{\"title\": ' || to_json(title) || ', \"tags\": [\"a\", ' || to_json(lang) || '], \"at\": {{\"source\": ' || to_json(source) || '}}, \"note\": ' || to_json(title || chr(10) || '  x' || chr(10)) || '}}' AS frontmatter, length('# ' || title) + CAST(coalesce(list_sum(list_transform(l, lambda x: 2 + length(x))), 0) AS BIGINT) AS chars, CAST(NULL AS VARCHAR) AS error FROM l_")
def _(spark, sf):
    """Pages written as Markdown with frontmatter, a paragraph a line, and parsed again."""
    p = pages(spark, sf).withColumn("title", T.squash(F.col("title")))
    quoted = F.concat(F.lit("'"), F.replace("title", F.lit("'"), F.lit("''")), F.lit("'"))
    block = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\ntags: [a, "), "lang", F.lit("]\nat:\n  source: "), "source", F.lit("\nnote: |\n    "), "title", F.lit("\n      x\n---\n# "))
    raw = F.concat(block, escaped(F.col("title")), F.lit("\n\n"), F.array_join(F.transform(lines_of(F.col("text")), escaped), "\n\n"))
    return markdown.parse_pages(p.select("path", raw.alias("text"))).select("path", "frontmatter", F.length("plain").alias("chars"), "error")


@query("s08_flatten_blocks", f"WITH {PAGES}, l_ AS (SELECT path, {LINES} AS l FROM pages_), t_ AS (SELECT path, coalesce(array_to_string(l, chr(10)), '') AS t FROM l_) SELECT path, sha256('# Top' || chr(10) || chr(10) || CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END || '    # code' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END) AS plain_sha256 FROM t_")
def _(spark, sf):
    """Pages as a quote and as a list around code, flattened to plain text."""
    lines = F.transform(lines_of(F.col("text")), escaped)
    raw = F.concat(F.lit("# Top\n\n> "), F.array_join(lines, "\n> "), F.lit("\n\n```\n# code\n```\n\n- "), F.array_join(lines, "\n- "))
    return markdown.parse_pages(pages(spark, sf).select("path", raw.alias("text"))).select("path", F.sha2(F.col("plain").cast("binary"), 256).alias("plain_sha256"))


@query("s11_normalise_markdown", f"""WITH {PAGES} SELECT path, regexp_replace(regexp_replace(list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda l: 'x' || regexp_replace(l, '^\\s+|\\s+$', '', 'g') || ' | ' || 'y'), lambda l: l <> ''), 'string_agg', chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS plain FROM pages_""")
def _(spark, sf):
    """Each line as a row of a table below a rule and a list mark, normalised back to plain lines."""
    # a pipe inside the text is escaped, as a converter would
    cell = F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit("| x"), F.replace(T.strip(line), F.lit("|"), F.lit("\\|")), F.lit(" | y |")))
    md = F.concat(F.lit("| --- | --- |\n"), F.array_join(cell, "\n"))
    return pages(spark, sf).select("path", markdown.normal_markdown(md).alias("plain"))


@query("s12_table_cells", f"WITH {CHUNKS} SELECT chunk_id, len(string_split(text, ' | ')) AS cells, regexp_replace(string_split(text, ' | ')[1], '^\\s+|\\s+$', '', 'g') AS first_cell FROM chunks_")
def _(spark, sf):
    row = F.concat(F.lit("|"), F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit(" \\| "), F.lit(" | ")), F.lit("|"))
    cells = markdown.table_cells(row)
    return chunks(spark, sf).select("chunk_id", F.size(cells).alias("cells"), F.element_at(cells, 1).alias("first_cell"))


@query("s13_neutral_heading", f"WITH {CHUNKS} SELECT chunk_id, '\\## ' || text AS neutral FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", markdown.neutral(F.concat(F.lit("## "), "text")).alias("neutral"))


@query("s14_repeated_headings", f"WITH {PAGES} SELECT path, '# ' || title || chr(10) || chr(10) || 'end' AS plain FROM pages_")
def _(spark, sf):
    twice = F.concat(F.lit("# "), "title", F.lit("\n\n# "), "title", F.lit("\n\nend"))
    return pages(spark, sf).select("path", F.regexp_replace(markdown.drop_repeated_headings(twice), r"\n{3,}", "\n\n").alias("plain"))


@query("s15_heading_title", f"WITH {CHUNKS} SELECT chunk_id, substr({squash_sql('text')}, 1, 300) AS title FROM chunks_")
def _(spark, sf):
    heading = T.any_heading(F.concat(F.lit("intro\n### "), T.strip(F.col("text")), F.lit("\nrest")))
    return chunks(spark, sf).select("chunk_id", T.clean_title(heading).alias("title"))


@query("s19_corpus_hash", f"WITH {PAGES}, h AS (SELECT sha256(path || chr(10) || sha256(text)) AS h FROM pages_), g AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY substr(h, 1, 4)) SELECT sha256(string_agg(h, '' ORDER BY h)) AS corpus_hash FROM g")
def _(spark, sf):
    return files.corpus_hash(pages(spark, sf).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))


@query("f19_content_hash", f"WITH {PAGES} SELECT path, sha256(text) AS sha256, strlen(text) AS bytes FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("bytes"))


@query("f01_query_terms", f"SELECT item_id, list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))), 'string_agg', ' ') AS terms FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_terms(F.col("text"))), " ").alias("terms"))


@query("f02_sentences", f"WITH {PAGES} SELECT path, len(s) AS sentences, s[1] AS first_sentence, s[len(s)] AS last_sentence FROM (SELECT path, {SENTENCES.format('text')} AS s FROM pages_)")
def _(spark, sf):
    s = pages(spark, sf).select("path", T.sentences(F.col("text")).alias("s"))
    return s.select("path", F.size("s").alias("sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"), F.try_element_at("s", F.lit(-1)).alias("last_sentence"))


SCORE_SQL = " + ".join(f"CAST(regexp_matches(lower(text), '\\b{t}') AS BIGINT)" for t in TERMS)


@query("f03_sentence_score", f"WITH {CHUNKS} SELECT chunk_id, {SCORE_SQL} AS score FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.sentence_score(F.col("text"), terms_array()).alias("score"))


INTENT_SQL = r"""CASE WHEN w[1] = 'when' THEN 'when' WHEN w[1] = 'where' THEN 'where' WHEN w[1] IN ('who', 'whom') THEN 'who'
 WHEN w[1] = 'how' AND w[2] IN ('many', 'much') THEN 'count' WHEN list_contains(w, 'year') AND w[1] IN ('what', 'which') THEN 'when' ELSE 'none' END"""


@query("f04_intent", rf"WITH {CHUNKS}, q AS (SELECT chunk_id, string_split_regex(lower((['When', 'Where is', 'Whom', 'How many', 'How', 'What year', 'Which'])[1 + chunk_idx % 7] || ' ' || text), '\s+') AS w FROM chunks_) SELECT chunk_id, {INTENT_SQL} AS intent FROM q")
def _(spark, sf):
    openings = F.array(*map(F.lit, ("When", "Where is", "Whom", "How many", "How", "What year", "Which")))
    return chunks(spark, sf).select("chunk_id", T.intent(F.concat_ws(" ", F.element_at(openings, 1 + F.col("chunk_idx") % 7), "text")).alias("intent"))


@query(
    "f05_intent_bonus",
    f"WITH {CHUNKS} SELECT chunk_id, " + ", ".join(f"CASE WHEN regexp_matches(text, '{plain_pattern(p)}') THEN 2 ELSE 0 END AS {n}" for n, p in (("year", T.YEAR), ("place", T.PLACE), ("person", T.PERSON), ("number", T.NUMBER))) + " FROM chunks_",
)
def _(spark, sf):
    kinds = {"year": "when", "place": "where", "person": "who", "number": "count"}
    return chunks(spark, sf).select("chunk_id", *[T.intent_bonus(F.col("text"), F.lit(k)).alias(n) for n, k in kinds.items()])


@query("f06_snippet", f"WITH RECURSIVE {PAGES}, asked_ AS (SELECT path AS id, text, 'when did thing tion rean happen' AS query FROM pages_), {snippet_sql()} SELECT id AS path, snippet FROM snippets_")
def _(spark, sf):
    p = pages(spark, sf)
    return p.select("path", snippet(F.col("text"), F.lit("when did thing tion rean happen")).alias("snippet"))


@query("f07_window_around_terms", f"WITH {PAGES}, windows_in_ AS (SELECT path AS id, replace(text, chr(10), ' ') AS t, [{', '.join(repr(t) for t in TERMS)}] AS terms, false AS inside FROM pages_), {around_sql(120)} SELECT id AS path, shown AS window FROM around_")
def _(spark, sf):
    terms = F.array(*[F.lit(t) for t in TERMS])
    return pages(spark, sf).select("path", around_terms(F.replace("text", F.lit("\n"), F.lit(" ")), terms, 120, F.lit(False)).alias("window"))


@query("f08_snippet_fallback", f"WITH {PAGES} SELECT path, {head_sql(squash_ends('text'), 280)} AS head FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", head(T.strip(F.col("text")), 280).alias("head"))


ANSWER_SQL = " + ".join(f"CAST(regexp_matches(lower(s), '\\b{t}') AS INT)" for t in ("things", "happened", "year"))


@query("f09_answer", rf"""WITH {PAGES}, s AS (SELECT path, unnest(range(len(l))) AS i, unnest(l) AS s FROM (SELECT path, {SENTENCES.format('text')} AS l FROM pages_)),
 g AS (SELECT path, i, s, {ANSWER_SQL} + CASE WHEN regexp_matches(s, '{plain_pattern(T.NUMBER)}') THEN 2 ELSE 0 END AS score FROM s),
 b AS (SELECT path, max_by(s, (score, -i)) AS answer, max(score) AS best FROM g GROUP BY path) SELECT p.path, CASE WHEN best >= 1 THEN answer END AS answer FROM pages_ p LEFT JOIN b USING (path)""")
def _(spark, sf):
    return pages(spark, sf).select("path", T.best_answer(F.col("text"), F.lit(QUESTION)).alias("answer"))


@query("f11_clamp", rf"WITH {CHUNKS} SELECT chunk_id, CASE WHEN length(text) <= 240 THEN text ELSE regexp_replace(CASE WHEN strpos(substr(text, 1, 240), ' ') > 1 THEN regexp_extract(substr(text, 1, 240), '(?s)^(.+) ', 1) ELSE substr(text, 1, 240) END, '^\s+|\s+$', '', 'g') || '…' END AS card FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.clamp(F.col("text")).alias("card"))


@query("f12_highlight", rf"WITH {CHUNKS} SELECT chunk_id, regexp_replace(text, '(?i)\b((?:{'|'.join(TERMS)})[a-z0-9_]*)', '**\1**', 'g') AS marked FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.highlight(F.col("text"), list(TERMS)).alias("marked"))


@query("f13_token_estimate", f"WITH {PAGES} SELECT path, CAST(ceil(length({squash_sql('text')}) / 4) AS BIGINT) AS tokens FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("f14_fit_text", rf"WITH {PAGES}, s AS (SELECT path, {squash_sql('text')} AS t FROM pages_) SELECT path, CASE WHEN ceil(length(t) / 4) <= 25 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 99), '\s+$', ''), '[.…]+$', '') || '…' END AS fitted FROM s")
def _(spark, sf):
    return pages(spark, sf).select("path", T.fit_text(F.col("text"), F.lit(25)).alias("fitted"))


@query("f15_canonical_text", f"WITH {CHUNKS} SELECT chunk_id, lower({squash_sql('text')}) AS canonical FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", T.canonical(F.col("text")).alias("canonical"))


@query("f16_first_heading", f"WITH {PAGES} SELECT path, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS h1 FROM pages_")
def _(spark, sf):
    raw = F.concat(F.lit("---\nx: 1\n---\n## second\n\n# "), "title", F.lit("\n\n# other"))
    return pages(spark, sf).select("path", T.first_heading(raw).alias("h1"))


@query("f17_path_tokens", f"WITH {PAGES} SELECT path, 'doc-' || doc_id || '.md' AS basename, lang || ' ' || source || ' doc ' || doc_id AS tokens FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", T.basename(F.col("path")).alias("basename"), F.array_join(T.path_tokens(F.col("path")), " ").alias("tokens"))


@query("f20_cursor", "SELECT doc_id, to_base64(encode(CAST(doc_id AS VARCHAR))) AS cursor, doc_id AS back FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.encode_cursor(F.col("doc_id")).alias("cursor"), T.decode_cursor(T.encode_cursor(F.col("doc_id"))).alias("back"))


@query("i07_page_title", f"WITH {PAGES} SELECT path, title FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", "title")


@query("q25_result_title", f"WITH {PAGES} SELECT path, coalesce(nullif(regexp_replace(given, '^\\s+|\\s+$', '', 'g'), ''), 'doc-' || doc_id) AS title FROM pages_")
def _(spark, sf):
    return pages(spark, sf).select("path", T.result_title(F.col("given"), F.col("path")).alias("title"))


@query(
    "t01_sections",
    rf"""WITH {PAGES}, lines AS (SELECT path, i, CASE WHEN i % 3 = 0 THEN repeat('#', CAST(1 + (i // 3) % 3 AS INT)) || ' h' || i || chr(10) || line ELSE line END AS line, CAST(i % 3 = 0 AS INT) AS head, 1 + (i // 3) % 3 AS depth
   FROM (SELECT path, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT path, string_split(text, chr(10)) AS l FROM pages_))),
 secs AS (SELECT path, i // 3 AS s, 1 + (i // 3) % 3 AS depth, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY ALL)
 SELECT path, s + 1 AS section, CASE depth WHEN 1 THEN 'h' || s * 3 WHEN 2 THEN 'h' || (s - 1) * 3 || ' > h' || s * 3 ELSE 'h' || (s - 2) * 3 || ' > h' || (s - 1) * 3 || ' > h' || s * 3 END AS heading_path, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars FROM secs""",
)
def _(spark, sf):
    """Every third line gets a heading before it, one level deeper each time over three levels."""
    line = lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 3) % 3).cast("int")), F.lit(" h"), i.cast("string"), F.lit("\n"), x)).otherwise(x)
    plain = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    out = chunking.sections(pages(spark, sf).select("path", plain.alias("plain")))
    return out.select("path", "section", F.array_join("heading_path", " > ").alias("heading_path"), F.length("text").alias("chars"))


@query("t02_t03_chunks", f"WITH RECURSIVE {PAGES}, {chunks_sql(100)} SELECT chunk_id, path, chunk_idx, text FROM chunks_")
def _(spark, sf):
    """Chunks of 100 tokens of all documents: sections, recursive split, packing and overlap."""
    return chunking.chunk(pages(spark, sf).select("path", F.col("text").alias("plain")), size=100).select("chunk_id", "path", "chunk_idx", "text")


@query("t02_fixed_width", f"WITH {PAGES} SELECT path, i AS piece, substr(t, i * 500 + 1, 500) AS text FROM (SELECT path, t, unnest(range(CAST(ceil(length(t) / 500) AS BIGINT))) AS i FROM (SELECT path, regexp_replace(text, '[.!?\\s]', '', 'g') AS t FROM pages_))")
def _(spark, sf):
    """Texts without sentences or paragraphs are cut at a fixed width."""
    flat = F.regexp_replace("text", r"[.!?\s]", "")
    return pages(spark, sf).select("path", F.posexplode(chunking.pieces_of(flat, 500)).alias("piece", "text"))


@query("t06_model_window", f"WITH {PAGES} SELECT path, CAST(ceil(length(t) / 340) AS BIGINT) AS pieces FROM (SELECT path, regexp_replace(text, '[.!?\\s]', '', 'g') AS t FROM pages_)")
def _(spark, sf):
    """Pieces for a model that takes 100 tokens: 85 of them are filled, with four characters each."""
    flat = F.regexp_replace("text", r"[.!?\s]", "")
    return pages(spark, sf).select("path", F.size(chunking.pieces_of(flat, 4 * chunk_size_for(100))).alias("pieces"))


@query("t04_overlap", rf"WITH {CHUNKS} SELECT chunk_id, CASE WHEN chunk_idx > 0 THEN right(lag(text) OVER (PARTITION BY path ORDER BY chunk_idx), 30) || chr(10) || chr(10) || text ELSE text END AS text FROM chunks_")
def _(spark, sf):
    return chunking.overlapped(chunks(spark, sf), 30).select("chunk_id", "text")


@query("t05_i06_chunk_ids", f"WITH {CHUNKS} SELECT chunk_id, path, chunk_idx, length(text) AS chars FROM chunks_")
def _(spark, sf):
    return chunks(spark, sf).select("chunk_id", "path", "chunk_idx", F.length("text").alias("chars"))


@query(
    "t07_hash_embedding",
    """WITH h AS (SELECT item_id, i, j, (CAST('0x' || substr(sha256(i || '|' || text), CAST(j * 4 + 1 AS BIGINT), 4) AS INT)) / 65535.0 * 2 - 1 AS x FROM benchmark, (SELECT unnest([0, 16, 32, 48]) AS i), (SELECT unnest(range(16)) AS j)),
 n AS (SELECT item_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS norm FROM h GROUP BY item_id) SELECT item_id, i + j AS dim, round(CAST(x AS DOUBLE) / norm, 6) AS value FROM h JOIN n USING (item_id)""",
)
def _(spark, sf):
    e = table(spark, sf, "benchmark").select("item_id", F.posexplode(hash_embedding(F.col("text"), 64)).alias("dim", "x"))
    return e.select("item_id", "dim", F.round("x", 6).alias("value"))
