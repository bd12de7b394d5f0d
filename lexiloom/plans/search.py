"""The two end-to-end plans: build an index from pages, and answer a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.embed import hash_embedding
from ..functions.snippet import snippet
from ..functions.text import result_title
from ..operators import fusion, retrieval
from ..operators.chunking import chunk
from ..operators.lexical import Lexicon, lexicon, small
from ..storage import stored


@dataclass(frozen=True)
class Index:
    """The tables a search reads: pages (path, title, frontmatter), chunks, vectors, stored postings and blocks of vectors.

    Without a lexicon a search scans the chunks for the terms of its queries, without blocks it compares all vectors as they come.
    """

    pages: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    lexicon: Lexicon | None = None
    blocks: retrieval.VectorIndex | None = None


def build_index(pages: DataFrame, settings: Settings | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """Index of (path, title, frontmatter, plain). Chunks, vectors and postings are made once and stored."""
    settings = settings or Settings()
    chunks = stored(chunk(pages.select("path", "plain"), settings.chunk_size, settings.chunk_overlap), "index-chunks")
    index = index_of(pages, chunks, settings, embed)
    return replace(index, blocks=retrieval.vector_index(index.vectors), lexicon=lexicon(chunks))


def index_of(pages: DataFrame, chunks: DataFrame, settings: Settings, embed: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    vectors = embed(chunks) if embed else chunks.withColumn("embedding", hash_embedding(F.col("text"), settings.embedding_dims))
    return Index(pages, chunks, vectors.select("chunk_id", "embedding"))


def retrieve(queries: DataFrame, index: Index, settings: Settings, planner=None, embed=None) -> DataFrame:
    """Hits of both arms (query_id, list_idx, retriever, weight, chunk_id, rank), each arm cut to its limit."""
    variations, _ = fusion.planned(queries, planner)
    lists = variations.select("query_id", "arm", "ord", "text", "weight", F.concat_ws("|", "query_id", "arm", "ord").alias("list_id"))
    hits = []
    if settings.bm25_weight > 0:
        lexical = lists.where("arm = 'lexical'")
        found = retrieval.bm25(lexical.select(F.col("list_id").alias("query_id"), F.col("text").alias("query")), index.chunks, settings.per_retriever, index.lexicon)
        hits.append((found, lexical, "bm25", settings.bm25_weight, 0))
    if settings.vector_weight > 0:
        semantic = lists.where("arm = 'semantic'")
        asked = embed(semantic) if embed else semantic.withColumn("embedding", hash_embedding(F.col("text"), settings.embedding_dims))
        found = retrieval.nearest(asked.select(F.col("list_id").alias("query_id"), "embedding"), index.vectors, settings.per_retriever, index.blocks)
        hits.append((found, semantic, "vector", settings.vector_weight, 1000))
    out = None
    for found, arm, name, weight, first in hits:
        part = found.select(F.col("query_id").alias("list_id"), "chunk_id", "rank").join(arm, "list_id").select("query_id", (F.lit(first) + F.col("ord")).alias("list_idx"), F.lit(name).alias("retriever"), (F.col("weight") * weight).alias("weight"), "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("both retrievers have weight zero")
    return out


def rank_hits(hits: DataFrame, queries: DataFrame, index: Index, settings: Settings, rerank=None) -> DataFrame:
    """Fused, boosted, deduplicated and cut results with everything needed to show them."""
    fused = fusion.fuse(hits, settings.rrf_k, settings.candidates)
    # At most ``candidates`` rows a query: these few go to the tables, which stay where they are.
    rows = stored(small(stored(fused, "search-fused")).join(index.chunks.select("chunk_id", "path", "chunk_idx", "text", "heading_path"), "chunk_id"), "search-rows")
    named = index.pages.select("path", "title", "frontmatter").join(small(rows.select("path").distinct()), "path", "left_semi")
    rows = rows.join(named, "path", "left").join(queries.select("query_id", "query"), "query_id")
    if settings.lexical_tie_break:
        shown = snippet(F.col("text"), F.col("query"))
        rows = fusion.lexical_tie_break(rows.withColumn("haystack", fusion.haystack(shown, F.col("heading_path"), F.col("title"), F.col("path"))))
    rows = fusion.first_of(fusion.boosted(rows, settings.path_boost, settings.heading_boost), "chunk_id")
    rows, _ = fusion.reranked(rows, rerank)
    if settings.dedup_by_page:
        rows = fusion.first_of(rows, "path")
    return fusion.final_top(rows, settings.final)


def search(queries: DataFrame, index: Index, settings: Settings | None = None, planner=None, embed=None, rerank=None) -> DataFrame:
    """Results of (query_id, query): query_id, rank, path, title, snippet, score, frontmatter, heading_path, retrievers, chunk_id."""
    settings = settings or Settings()
    queries = fusion.normal_queries(queries)
    return shown(rank_hits(retrieve(queries, index, settings, planner, embed), queries, index, settings, rerank))


def shown(top: DataFrame) -> DataFrame:
    """What users see of ranked rows."""
    return top.select(
        "query_id", "rank", "path", result_title(F.col("title"), F.col("path")).alias("title"), snippet(F.col("text"), F.col("query")).alias("snippet"), F.round("final_score", 6).alias("score"),
        F.coalesce("frontmatter", F.lit("{}")).alias("frontmatter"), "heading_path", "retrievers", "chunk_id",
    )
