"""Snippets in SQL, to hold the Python of ``functions.snippet`` against."""

from __future__ import annotations

from ..functions.snippet import CAP
from ..functions.text import NUMBER, PERSON, PLACE, QUESTION_WORDS, STOPWORDS, YEAR

STOP = ", ".join(f"'{w}'" for w in dict.fromkeys((*STOPWORDS, *QUESTION_WORDS)))


def squash_ends(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def plain_pattern(pattern: str) -> str:
    """The answer patterns without look-around: their ends are word boundaries."""
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")


def terms_sql(query: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({query}), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))"


def head_sql(t: str, cap: int) -> str:
    w = f"substr({t}, 1, {cap})"
    end = rf"regexp_extract({w}, '(?s)^(.*[.!?])(?:\s|$)', 1)"
    space = f"regexp_extract({w}, '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({t}) <= {cap} THEN {t} WHEN length({end}) > {cap} / 2 THEN {squash_ends(end)} || ' …' WHEN {space} <> '' THEN {squash_ends(space)} || ' …' ELSE {squash_ends(w)} || ' …' END"


def around_sql(cap: int) -> str:
    """``around_`` (id, shown) of ``windows_in_`` (id, t, terms, inside): the part of a text with the most term starts."""
    line = "' ' || regexp_replace(lower(t), '[^a-z0-9_]', ' ', 'g')"
    return rf"""lines_ AS (SELECT *, {line} AS line FROM windows_in_),
 found_ AS (SELECT id, x, unnest(range(len(cut))) AS k, unnest(list_transform(cut, lambda c: length(c))) AS n FROM (SELECT id, x, string_split(line, ' ' || x) AS cut FROM (SELECT id, line, unnest(terms) AS x FROM lines_))),
 starts_ AS (SELECT id, p FROM (SELECT id, x, k, CAST(sum(n) OVER (PARTITION BY id, x ORDER BY k) + k * (length(x) + 1) AS BIGINT) AS p, count(*) OVER (PARTITION BY id, x) AS cuts FROM found_) WHERE k < cuts - 1),
 reach_ AS (SELECT id, p, count(*) OVER (PARTITION BY id ORDER BY p RANGE BETWEEN CURRENT ROW AND {cap - 1} FOLLOWING) AS n FROM starts_),
 best_ AS (SELECT id, arg_min(p, (-n, p)) AS p FROM reach_ GROUP BY id),
 from_ AS (SELECT l.*, greatest(0, p - 30) AS s0, least(length(t), greatest(0, p - 30) + {cap}) AS e0 FROM lines_ l JOIN best_ USING (id)),
 spaces_ AS (SELECT *, instr(substr(t, s0 + 1), ' ') AS first_space, length(regexp_extract(substr(t, 1, e0 + 1), '(?s)^(.*) ', 1)) AS last_space, instr(substr(t, 1, e0 + 1), ' ') > 0 AS has_space FROM from_),
 begin_ AS (SELECT *, CASE WHEN s0 > 0 AND first_space > 0 AND first_space - 1 < 40 THEN s0 + first_space ELSE s0 END AS s1 FROM spaces_),
 end_ AS (SELECT *, CASE WHEN e0 < length(t) AND has_space AND last_space > s1 THEN last_space ELSE e0 END AS e1 FROM begin_),
 around_ AS (SELECT w.id, CASE WHEN e.id IS NULL THEN {head_sql('w.t', cap)} ELSE CASE WHEN s1 > 0 OR w.inside THEN '… ' ELSE '' END || {squash_ends('substr(w.t, s1 + 1, e1 - s1)')} || CASE WHEN e1 < length(w.t) THEN ' …' ELSE '' END END AS shown FROM windows_in_ w LEFT JOIN end_ e USING (id))"""


def snippet_sql(cap: int = CAP) -> str:
    """``snippets_`` (id, snippet) of ``asked_`` (id, text, query); the window grows by a sentence a step."""
    broken = r"regexp_replace(regexp_replace(t, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n{2,}', chr(1), 'g')"
    words = r"string_split_regex(lower(query), '\s+')"
    kind = f"CASE WHEN {words}[1] IN ('when', 'where', 'who') THEN {words}[1] WHEN {words}[1] = 'whom' THEN 'who' WHEN {words}[1] = 'how' AND {words}[2] IN ('many', 'much') THEN 'count' WHEN list_contains({words}, 'year') AND {words}[1] IN ('what', 'which') THEN 'when' ELSE 'none' END"
    hit = " ".join(f"WHEN kind = '{k}' THEN regexp_matches(x, '{plain_pattern(p)}')" for k, p in (("when", YEAR), ("where", PLACE), ("who", PERSON), ("count", NUMBER)))
    after, before = "plain[l + 1]", "CASE WHEN f > 1 THEN plain[f - 1] END"
    forward = f"({after} IS NOT NULL AND ({before} IS NULL OR {after} >= {before}))"
    fits_after, fits_before = f"coalesce(n + length(parts[l + 1]) + 1 <= {cap}, false)", f"(f > 1 AND coalesce(n + length(parts[f - 1]) + 1 <= {cap}, false))"
    grows = f"CASE WHEN {forward} THEN CASE WHEN {fits_after} THEN 1 WHEN {fits_before} THEN -1 ELSE 0 END ELSE CASE WHEN {fits_before} THEN -1 WHEN {fits_after} THEN 1 ELSE 0 END END"
    return rf"""split_ AS (SELECT id, query, t, {terms_sql('query')} AS terms, {kind} AS kind, list_filter(list_transform(string_split({broken}, chr(1)), lambda s: {squash_ends('s')}), lambda s: s <> '') AS parts FROM (SELECT id, query, {squash_ends('text')} AS t FROM asked_)),
 scored_ AS MATERIALIZED (SELECT *, list_transform(parts, lambda s: len(list_filter(terms, lambda x: contains(' ' || regexp_replace(lower(s), '[^a-z0-9_]', ' ', 'g'), ' ' || x)))) AS plain FROM split_),
 peaks_ AS (SELECT id, i, list_extract(plain, i) + CASE WHEN hit THEN 2 ELSE 0 END AS score FROM (SELECT id, plain, i, CASE {hit} ELSE false END AS hit FROM (SELECT id, plain, kind, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM scored_ WHERE length(t) > {cap} AND (len(terms) > 0 OR kind <> 'none')))),
 peak_ AS (SELECT id, arg_min(i, (-score, i)) AS i, max(score) AS score FROM peaks_ GROUP BY id),
 grown_ AS (SELECT s.id, i AS f, i AS l, length(parts[i]) AS n, 1 AS move FROM scored_ s JOIN peak_ USING (id) WHERE score > 0
  UNION ALL SELECT id, CASE WHEN m = -1 THEN f - 1 ELSE f END, CASE WHEN m = 1 THEN l + 1 ELSE l END, n + 1 + CASE WHEN m = 1 THEN length(parts[l + 1]) WHEN m = -1 THEN length(parts[f - 1]) ELSE 0 END, m FROM (SELECT g.*, parts, {grows} AS m FROM grown_ g JOIN scored_ USING (id) WHERE move <> 0)),
 window_ AS (SELECT g.id, f, l, len(parts) AS k, terms, {squash_ends("array_to_string(parts[f:l], ' ')")} AS w FROM grown_ g JOIN scored_ USING (id) WHERE move = 0),
 windows_in_ AS (SELECT id, w AS t, terms, f > 1 AS inside FROM window_ WHERE length(w) > {cap}),
 {around_sql(cap)},
 snippets_ AS (SELECT s.id, CASE WHEN length(s.t) <= {cap} THEN s.t WHEN x.id IS NULL THEN {head_sql('s.t', cap)} WHEN a.id IS NOT NULL THEN a.shown ELSE CASE WHEN f > 1 THEN '… ' ELSE '' END || w || CASE WHEN l < k THEN ' …' ELSE '' END END AS snippet
  FROM scored_ s LEFT JOIN window_ x USING (id) LEFT JOIN around_ a USING (id))"""
