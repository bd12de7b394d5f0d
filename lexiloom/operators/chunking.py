"""Heading-aware overlapping chunks.

A page is split at its headings, in column expressions within its row, so its text is shuffled for
neither sections, numbers nor overlaps. A section that is too long is split and packed greedily by an
aggregate over its pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import give_back
from ..functions.text import strip

#: The end of a line before a heading line.
HEADING = r"\n(?=#{1,6}[^\S\n]+\S)"
#: A sentence begins where the last one ended or after a mark, so a long run that is none is looked at once.
PARAGRAPH_BREAK, SENTENCE = r"\n\s*\n", r"(?:\G|(?<=[.!?]))(?:[^.!?]++[.!?]++(?:\s+|\z)|[^.!?]++\z)"


def fixed_width(text: Column, limit: int) -> Column:
    """Pieces of ``limit`` characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / limit).cast("int")), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))


def packed(pieces: Column, limit: int, joiner: str, split: Callable[[Column], Column]) -> Column:
    """Neighbouring pieces joined greedily; each costs its length and a joiner; longer ones are ``split`` on their own."""
    none = F.array().cast("array<string>")
    joined = lambda held: F.array(strip(F.array_join(held, joiner)))

    def step(a: Column, piece: Column) -> Column:
        own, long_ = F.length(piece) + len(joiner), F.length(piece) > limit
        flush = (F.size(a["held"]) > 0) & ((a["cost"] + own > limit) | long_)
        out = F.concat(a["out"], F.when(flush, joined(a["held"])).otherwise(none), F.when(long_, split(piece)).otherwise(none))
        held = F.when(flush, none).otherwise(a["held"])
        cost = F.when(flush, 0).otherwise(a["cost"])
        return F.struct(out.alias("out"), F.when(long_, held).otherwise(F.concat(held, F.array(piece))).alias("held"), (cost + F.when(long_, 0).otherwise(own)).alias("cost"))

    start = F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("cost"))
    done = F.aggregate(pieces, start, step, lambda a: F.concat(a["out"], F.when(F.size(a["held"]) > 0, joined(a["held"])).otherwise(none)))
    return F.filter(done, lambda x: x != "")


def _by_sentences(text: Column, limit: int) -> Column:
    sentences = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip)
    split = lambda own: F.when(F.size(own) > 1, packed(own, limit, " ", lambda x: fixed_width(x, limit))).otherwise(fixed_width(text, limit))
    return F.transform(F.array(sentences), split)[0]


def pieces_of(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters: by paragraphs, else sentences, else fixed width."""
    paragraphs = F.array(F.split(text, PARAGRAPH_BREAK, -1))
    split = lambda own: F.when(F.size(own) > 1, packed(own, limit, "\n\n", lambda x: _by_sentences(x, limit))).otherwise(_by_sentences(text, limit))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(F.transform(paragraphs, split)[0])


def _headings(heads: pa.Array) -> pa.Array:
    """Of each part of a page (depth, title) the titles above it and its own; it sees no text, and pages without headings are null."""
    out: list[list[list[str]] | None] = []
    for row in heads.to_pylist():
        stack: list[dict] = []
        paths = []
        for own in row or ():
            if own["depth"]:
                while stack and stack[-1]["depth"] >= own["depth"]:
                    stack.pop()
                stack.append(own)
            paths.append([h["title"] for h in stack])
        out.append(None if row is None else paths)
    give_back()
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def _sections(pages: DataFrame) -> DataFrame:
    """(path, sections) of (path, plain): an array of (section, heading_path, text), blank ones left out."""

    def headed(part: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        return F.struct(part.alias("text"), F.length(F.regexp_extract(line, r"\A(#{1,6})\s+\S", 1)).alias("depth"), strip(F.regexp_extract(line, r"\A#{1,6}\s+(.+)\z", 1)).alias("title"))

    held = pages.select("path", F.transform(F.split("plain", HEADING, -1), headed).alias("parts"))
    heads = F.when(F.exists("parts", lambda x: x["depth"] > 0), F.transform("parts", lambda x: F.struct(x["depth"].alias("depth"), x["title"].alias("title"))))
    held = held.select("path", "parts", F.arrow_udf(_headings, "array<array<string>>")(heads).alias("above"))
    first = F.when(F.get("parts", F.lit(0))["depth"] > 0, 1).otherwise(0)  # what stands before the first heading has the number 0
    above = lambda i: F.coalesce(F.get("above", i), F.array().cast("array<string>"))
    named = F.transform("parts", lambda x, i: F.struct((i + first).alias("section"), above(i).alias("heading_path"), strip(x["text"]).alias("text")))
    return held.select("path", F.filter(named, lambda x: x["text"] != "").alias("sections"))


def sections(pages: DataFrame) -> DataFrame:
    """(path, section, heading_path, text) of (path, plain): parts between headings, with the headings above them."""
    return _sections(pages).select("path", F.explode("sections").alias("s")).select("path", "s.*")


def chunk(pages: DataFrame, size: int = 512, overlap: float = 0.15, chars_per_token: int = 4, spread: bool = True) -> DataFrame:
    """(chunk_id, path, chunk_idx, text, heading_path) of (path, plain).

    A page is chunked within its row. ``spread`` deals the pages out first, by one shuffle; pages that lie spread need none.
    """
    limit = size * chars_per_token
    tail = int(limit * overlap)

    def cut(s: Column) -> Column:
        pieces = F.when(F.length(s["text"]) <= limit, F.array(s["text"])).otherwise(pieces_of(s["text"], limit))
        return F.transform(pieces, lambda x: F.struct(x.alias("text"), s["heading_path"].alias("heading_path")))

    def overlapping(own: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last = F.get(own, i - 1)
            same = F.array_join(last["heading_path"], "|") == F.array_join(x["heading_path"], "|")
            return F.struct(_after(F.right(last["text"], F.lit(tail)), same, x["text"]).alias("text"), x["heading_path"].alias("heading_path"))

        return F.transform(own, one)

    pieces = F.flatten(F.transform("sections", cut))
    rows = _sections(pages.repartition("path") if spread else pages).select("path", F.posexplode(F.transform(F.array(pieces), overlapping)[0]).alias("chunk_idx", "c"))
    return rows.select(chunk_id(F.col("path"), F.col("chunk_idx")).alias("chunk_id"), "path", "chunk_idx", "c.text", "c.heading_path")


def _after(before: Column, same: Column, text: Column) -> Column:
    return F.when(same & (before != ""), F.concat(before, F.lit("\n\n"), text)).otherwise(text)


def overlapped(pieces: DataFrame, tail: int) -> DataFrame:
    """Each piece with the last ``tail`` characters of the one before, where both are under the same headings."""
    order = Window.partitionBy("path").orderBy("chunk_idx")
    same = F.array_join(F.lag("heading_path").over(order), "|") == F.array_join("heading_path", "|")
    before = F.lag(F.right("text", F.lit(tail))).over(order)
    return pieces.withColumn("text", _after(before, same, F.col("text")))


def chunk_id(path: Column, idx: Column) -> Column:
    return F.concat_ws("#", path, idx.cast("string"))


def line_chunks(pages: DataFrame) -> DataFrame:
    """(chunk_id, path, chunk_idx, text, heading_path): each line that isn't blank as a chunk, numbered over them."""
    lines = pages.select("path", F.posexplode(F.filter(F.split("text", "\n"), lambda x: strip(x) != "")).alias("chunk_idx", "text"))
    return lines.select(chunk_id(F.col("path"), F.col("chunk_idx")).alias("chunk_id"), "path", "chunk_idx", "text", F.array().cast("array<string>").alias("heading_path"))
