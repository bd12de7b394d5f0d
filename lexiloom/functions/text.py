"""Text functions of queries, sentences, titles and paths as Spark column expressions.

White space is what Java's ``\\s`` matches; a word starts where no ASCII letter, digit or underscore
stands before. Null inputs give null unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as query terms.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "do", "for", "from",
    "i", "if", "in", "is", "it", "its", "me", "my", "no", "not", "of",
    "on", "or", "so", "the", "this", "to", "was", "we",
    "which", "will", "with", "you", "your",
)
QUESTION_WORDS = ("when", "where", "who", "whom", "how", "what", "why", "which")
# What answers each kind of question.
YEAR = r"(?i)(?<![A-Za-z0-9_])\d{1,4}\s*(?:BCE?|CE|AD|A\.D\.|B\.C\.|century|centuries)(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])\d{3,4}(?![A-Za-z0-9_])"
PLACE = r"(?<![A-Za-z0-9_])(?:in|at|near|from|of)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
PERSON = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])"
NUMBER = r"(?<![A-Za-z0-9_])\d+(?:,\d{3})*(?:\.\d+)?(?![A-Za-z0-9_])"

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])|\n{2,}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def squash(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def canonical(text: Column) -> Column:
    return F.lower(squash(text))


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of at least three characters, in order, without stop and question words."""
    words = F.split(F.lower(query), r"[^a-z0-9_]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS, *QUESTION_WORDS)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != "")


def word_line(text: Column) -> Column:
    """Lower-case ``text`` with a space before each word, so that ``" " + term`` finds words that start with it."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9_]", " "))


def sentence_score(sentence: Column, terms: Column) -> Column:
    """How many of the terms start a word of the sentence."""
    # an array of one, so that the line is made once and not for each term
    return F.transform(F.array(word_line(sentence)), lambda line: F.size(F.filter(terms, lambda t: F.contains(line, F.concat(F.lit(" "), t)))))[0]


def intent(query: Column) -> Column:
    """What a question asks for: when, where, who, count or none."""
    words = F.split(F.lower(query), r"\s+")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return (
        F.when(first == "when", "when").when(first == "where", "where").when(first.isin("who", "whom"), "who")
        .when((first == "how") & second.isin("many", "much"), "count")
        .when(F.array_contains(words, "year") & first.isin("what", "which"), "when").otherwise("none")
    )


def intent_bonus(sentence: Column, kind: Column) -> Column:
    hit = F.when(kind == "when", sentence.rlike(YEAR)).when(kind == "where", sentence.rlike(PLACE)).when(kind == "who", sentence.rlike(PERSON)).when(kind == "count", sentence.rlike(NUMBER))
    return F.when(F.coalesce(hit, F.lit(False)), 2).otherwise(0)


def best_answer(text: Column, query: Column) -> Column:
    """The sentence with the highest score, the first of equals; null below one point or for a blank query."""
    terms, kind = query_terms(query), intent(query)
    scored = F.transform(sentences(text), lambda s, i: F.struct((sentence_score(s, terms) + intent_bonus(s, kind)).alias("score"), (-i).alias("order"), s.alias("text")))
    best = F.array_max(scored)
    asked = (strip(query) != "") & ((F.size(terms) > 0) | (kind != "none"))
    return F.when(asked & (best["score"] >= 1), best["text"])


def clamp(text: Column, limit: int = 240) -> Column:
    """At most ``limit`` characters, cut at the last space and marked."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, r"(?s)\A(.+) ", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(strip(F.when(cut != "", cut).otherwise(head)), F.lit("…")))


def highlight(text: Column, terms: list[str], before: str = "**", after: str = "**") -> Column:
    """Words that start with one of the terms, marked, their case kept."""
    if not terms:
        return text
    return F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, terms))})[a-z0-9_]*", f"{before}$0{after}")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(squash(text)) / 4)


def fit_text(text: Column, budget: Column) -> Column:
    """``text`` cut to a token budget: four characters a token, trailing dots replaced by one mark."""
    whole = squash(text)
    cut = F.regexp_replace(F.substr(whole, F.lit(1), F.greatest(budget * 4 - 1, F.lit(0)).cast("int")), r"\s+\z", "")
    return F.when(estimate_tokens(text) <= budget, whole).when(budget <= 0, F.lit("")).otherwise(F.concat(F.regexp_replace(cut, r"[.…]+\z", ""), F.lit("…")))


def first_heading(text: Column) -> Column:
    """The first level-one heading after a frontmatter block; null without one."""
    body = F.regexp_replace(text, r"\A---\n(?s:.*?)\n---\n?", "")
    found = F.regexp_extract(body, r"(?m)^#[^\S\n]+(\S[^\n]*)$", 1)
    return F.when(found != "", strip(found))


def any_heading(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^#{1,6}[^\S\n]+(\S[^\n]*)$", 1)
    return F.when(found != "", found)


def clean_title(title: Column) -> Column:
    """One line of at most 300 characters."""
    return F.substring(squash(title), 1, 300)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot; empty for none or a name that only starts with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def path_tokens(path: Column) -> Column:
    """Lower-case words of a path without its extension."""
    return F.filter(F.split(F.lower(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")), r"[/_\-.]+"), lambda t: t != "")


def heading_tokens(headings: Column) -> Column:
    return F.filter(F.flatten(F.transform(headings, lambda h: F.split(F.lower(h), r"[\s_\-.,;:!?]+"))), lambda t: t != "")


def page_title(given: Column, path: Column) -> Column:
    """The given title if it isn't blank, else the file's name in words."""
    stem = F.regexp_replace(basename(path), r"\.md$", "")
    words = F.regexp_replace(stem, r"[-_]+", " ")
    return F.coalesce(F.when(strip(given) != "", given), F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20)))


def result_title(given: Column, path: Column) -> Column:
    """Title in results: the given one trimmed, else the file's name."""
    return F.coalesce(F.when(strip(given) != "", strip(given)), F.regexp_replace(basename(path), r"(?i)\.md$", ""))


def encode_cursor(offset: Column) -> Column:
    return F.base64(F.encode(offset.cast("string"), "UTF-8"))


def decode_cursor(cursor: Column) -> Column:
    return F.decode(F.unbase64(cursor), "UTF-8").cast("int")


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def index_tokens(text: Column) -> Column:
    """Tokens of the inverted index: runs of letters and digits in lower case, accents dropped."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(F.lower(text), ACCENTED, PLAIN)).otherwise(F.lower(text))
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def match_phrases(query: Column) -> Column:
    """A query's phrases: white-space tokens with an ASCII letter or digit, each as its index tokens."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w.rlike("[A-Za-z0-9]"))
    return F.filter(F.transform(words, index_tokens), lambda p: F.size(p) > 0)
