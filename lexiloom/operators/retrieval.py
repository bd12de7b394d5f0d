"""Retrieval for batches of queries: the lexical arm over an index of postings, the vector arm by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexical, scan
from .lexical import Lexicon, top, units
from .nearest import VectorIndex, nearest, vector_index

__all__ = ["Lexicon", "VectorIndex", "bm25", "lexical_score", "nearest", "parse_heading_path", "phrase_hits", "postings", "safe_json", "top", "units", "vector_index", "vector_score", "with_frontmatter"]


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl) of (chunk_id, text). ``dl``: tokens of the chunk."""
    return lexical.occurrences(chunks).where("term <> ''").drop("positions")


def _lexicon(queries: DataFrame, chunks: DataFrame) -> Lexicon:
    """An index of what a batch of queries asks for, where none is stored."""
    return lexical.lexicon(chunks, lexical.asked_terms(units(queries)))


def phrase_hits(queries: DataFrame, chunks: DataFrame | None = None, index: Lexicon | None = None) -> DataFrame:
    """(query_id, phrase, chunk_id, tf) of (query_id, query): how often each word of a query occurs."""
    asked = None if index else scan.asked_units(queries)
    return scan.phrase_hits(asked, chunks) if asked else lexical.phrase_hits(queries, index or _lexicon(queries, chunks))


def bm25(queries: DataFrame, chunks: DataFrame | None = None, k: int = 30, index: Lexicon | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` best chunks of each query; equal scores by chunk_id.

    From a stored ``index``, or from the ``chunks`` themselves: by a scan, or where the batch has too many words for one, an
    index that holds what it asks for.
    """
    asked = None if index else scan.asked_units(queries)
    return scan.bm25(asked, chunks, k) if asked else lexical.bm25(queries, index or _lexicon(queries, chunks), k)


def lexical_score(score: Column) -> Column:
    """Score shown for a lexical hit. It falls as relevance grows; only the rank is used to order."""
    return 1 / (1 + F.abs(score))


def vector_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def with_frontmatter(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with their page's frontmatter, an empty object where there is none."""
    return hits.join(pages.select("path", "frontmatter"), "path", "left").withColumn("frontmatter", F.coalesce("frontmatter", F.lit("{}")))


def parse_heading_path(raw: Column) -> Column:
    """JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def safe_json(raw: Column) -> Column:
    return F.coalesce(F.to_json(F.try_parse_json(raw)), F.lit("{}"))
