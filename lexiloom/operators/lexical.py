"""The inverted index as blocks of postings, and lexical top-k that skips what can't be among the best.

A block holds up to ``BLOCK`` postings of one term and of like impact, with the
positions of each occurrence. Beside its lists a block states its largest count and its shortest
chunk, which bound what any of its postings can score, whatever the collection grows to.

A batch of queries is answered in three looks at the lists of its terms. Chunks from the best block of each term are
scored in full, which gives each query a score that its k-th best chunk reaches at least. Terms that together can't reach it, the
commonest ones, bring no candidates, nor do blocks that can't reach it with the help of all other terms; a chunk stays a candidate only
if what it scores in the opened blocks and could score in the others reaches it. These are scored in full, so the
result is exactly that of scoring every chunk. Phrases are found by intersecting positions; no text is read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.embed import give_back
from ..functions.text import index_tokens, match_phrases
from ..storage import stored

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: Postings of a block, and the chunk length at which impacts are compared when postings are ordered.
BLOCK, USUAL_LENGTH = 128, 64
#: Chunks counted at once, postings that a task deals out at once, and chunks (or as many postings) for which there is one group of terms.
AT_ONCE, HELD, GROUP_CHUNKS, GROUP_POSTINGS = 2048, 1 << 21, 8192, 1 << 20
#: A term with more than this part of a group's postings is dealt out to several groups.
PARTS = 16
#: Blocks of a batch that a task returns.
BATCH = 2048
#: Rows of a batch's terms or candidates up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Chunks that give a query its first bound, as a multiple of the chunks that it asks for.
FIRST = 4
#: Terms that together add at most this share of what is reached aren't opened to find candidates; a greater share opens fewer postings and leaves more candidates.
SHARE = 0.15
#: Scores are compared with this much room, for they are rounded to 9 digits and added in any order.
ROOM = 1e-8

OCCURRENCES = "term string, chunk_id string, tf int, dl int, positions array<int>"
BLOCKS = "term string, n int, max_tf int, min_dl int, chunk_ids array<string>, tfs array<int>, dls array<int>, positions array<array<int>>"
TERMS, TOTALS = "term string, df long", "chunks long, tokens long"


@dataclass(frozen=True)
class Lexicon:
    """Blocks, document counts of terms, and (chunks, tokens). ``gone``: (path, until); a block's postings of a path written before are dead."""

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    gone: DataFrame | None = None


def small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


# building


@dataclass(frozen=True)
class _Coded:
    """Postings by chunk: places of their terms in ``terms`` and of their chunks in ``ids``, which have ``dls`` tokens; positions of all after one another."""

    terms: pa.Array
    ids: pa.Array
    dls: np.ndarray
    term: np.ndarray
    chunk: np.ndarray
    tf: np.ndarray
    positions: np.ndarray

    @staticmethod
    def joined(parts: list[_Coded]) -> _Coded:
        coded = pa.concat_arrays([p.terms for p in parts]).dictionary_encode()
        place, first_term, first_id = coded.indices.to_numpy(), 0, 0
        term, chunk = [], []
        for p in parts:
            term.append(place[p.term + first_term])
            chunk.append(p.chunk + np.int32(first_id))
            first_term, first_id = first_term + len(p.terms), first_id + len(p.ids)
        dls, tf, positions = (np.concatenate([getattr(p, c) for p in parts]) for c in ("dls", "tf", "positions"))
        return _Coded(coded.dictionary, pa.concat_arrays([p.ids for p in parts]), dls, np.concatenate(term), np.concatenate(chunk), tf, positions)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[_Coded]:
    """Postings of chunks (chunk_id, w)."""
    for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
        ids, words = batch.column("chunk_id"), batch.column("w")
        length = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), length)
        at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        order = np.argsort(row * (len(coded.dictionary) + 1) + code, kind="stable")
        row, code, at = row[order], code[order], at[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        yield _Coded(coded.dictionary, ids, length.astype(np.int32), *[x.astype(np.int32) for x in (code[first], row[first], np.diff(np.append(first, len(row))), at)])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _tokens(batches):
        ids, none = found.ids, len(found.ids)
        ends = np.append(0, np.cumsum(found.tf)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([found.terms.take(pa.array(found.term)), pa.array([""] * none, pa.string())]),
                pa.concat_arrays([ids.take(pa.array(found.chunk)), ids]),
                pa.array(np.concatenate([found.tf, np.zeros(none, np.int32)])),
                pa.array(np.concatenate([found.dls[found.chunk], found.dls])),
                pa.ListArray.from_arrays(pa.array(np.concatenate([ends, np.full(none, ends[-1], np.int32)])), pa.array(found.positions)),
            ],
            names=["term", "chunk_id", "tf", "dl", "positions"],
        )


def occurrences(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl, positions) of (chunk_id, text): how often and where; ``dl``: tokens of the chunk.

    A row with the empty term stands for each chunk itself. Counted within each chunk, so nothing is shuffled.
    """
    return _words(chunks).mapInArrow(_occurrences, OCCURRENCES)


def _words(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("string"), F.coalesce(index_tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))


def counted(found: DataFrame) -> DataFrame:
    """(term, df, tokens) of ``occurrences``: the row of the empty term has the number of all chunks and of their tokens."""
    return found.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("tokens"))


_DEALT = "bucket int, size long, postings binary"


def _strength(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / USUAL_LENGTH))


def _narrow(values: np.ndarray) -> pa.ListArray:
    """Whole numbers as one list, in as few bytes each as they need."""
    return _listed(pa.array(values.astype(np.min_scalar_type(int(values.max())))))


def _listed(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _deal(found: _Coded, groups: int) -> pa.RecordBatch:
    """(bucket, size, postings): the postings of each group, compressed: each term, chunk and length once, the rest as numbers.

    A term goes to one group; a common one, by the share of all postings that it has here, to several, by impact.
    """
    term, n = found.term, len(found.term)
    count = np.bincount(term, minlength=len(found.terms))
    # A power of two of parts, for those of other tasks to be alike; chance is no share.
    sure = np.maximum(count - 2 * np.sqrt(count), 0)
    parts = 2 ** np.ceil(np.log2(np.maximum(np.minimum(PARTS * groups * sure / n, groups), 1))).astype(np.int64)
    name = np.array([zlib.crc32(t.encode()) for t in found.terms.to_pylist()], dtype=np.int64)
    bucket = name[term] % groups
    common = np.flatnonzero(parts[term] > 1)
    if len(common):
        own = term[common]
        order = np.lexsort((-_strength(found.tf[common], found.dls[found.chunk[common]]), own))
        common, own = common[order], own[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        bucket[common] = ((name[own] + rank * parts[own] // count[own] * 2654435761) & 0xFFFFFFFF) % groups
    place, ids = _ranked(found.ids)
    dls = np.empty(len(ids), dtype=np.int32)
    dls[place] = found.dls
    chunk = place.astype(np.int32)[found.chunk]
    by = np.lexsort((chunk, bucket * len(found.terms) + term))
    ends = np.append(0, np.cumsum(found.tf))
    places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.positions)).take(pa.array(by)).flatten().to_numpy()
    term, chunk, bucket, tf = term[by], chunk[by], bucket[by], found.tf[by]
    ends = np.append(0, np.cumsum(tf))
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes, out = [], []
    for x, y in zip(start, np.append(start[1:], n), strict=True):
        new = x + np.flatnonzero(np.diff(term[x:y], prepend=-1))
        some, at = np.unique(chunk[x:y], return_inverse=True)
        numbers = [np.diff(np.append(new, y)), at, dls[some], tf[x:y], places[ends[x] : ends[y]]]
        own = pa.RecordBatch.from_arrays([_listed(found.terms.take(pa.array(term[new]))), _listed(ids.take(pa.array(some))), *[_narrow(z) for z in numbers]], names=["terms", "ids", "counts", "chunks", "dls", "tfs", "positions"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as stream:
            stream.write_batch(own)
        raw = sink.getvalue()
        sizes.append(raw.size)
        out.append(pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "size", "postings"])


def _dealt(found: Iterator[_Coded], groups: int) -> Iterator[pa.RecordBatch]:
    """Postings go through the shuffle by group and compressed; as rows of their own they take many times the room."""
    held: list[_Coded] = []
    n = 0
    for part in found:
        if not len(part.term):
            continue
        held, n = [*held, part], n + len(part.term)
        if n >= HELD:
            yield _deal(_Coded.joined(held), groups)
            held, n = [], 0
    if n:
        yield _deal(_Coded.joined(held), groups)
    del held
    give_back()


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[_Coded]:
    """Postings of ``occurrences``."""
    for batch in batches:
        batch = batch.filter(pc.not_equal(batch.column("term"), ""))
        if not batch.num_rows:
            continue
        term, chunk = (batch.column(c).dictionary_encode() for c in ("term", "chunk_id"))
        at = chunk.indices.to_numpy()
        once = np.unique(at, return_index=True)[1]
        yield _Coded(term.dictionary, chunk.dictionary, batch.column("dl").to_numpy()[once], term.indices.to_numpy(), at, batch.column("tf").to_numpy(), batch.column("positions").flatten().to_numpy())


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the sorted different ones, and these."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _pack(group: pa.Table) -> pa.Table:
    """Blocks of a group's postings, by term and descending impact; those of one block by chunk."""
    found = [pa.ipc.open_stream(pa.decompress(raw, size, "zstd")).read_next_batch() for raw, size in zip(group.column("postings").to_pylist(), group.column("size").to_pylist(), strict=True)]
    words = lambda c: _ranked(pa.concat_arrays([p.column(c).flatten() for p in found]))
    numbers = lambda c: np.concatenate([p.column(c).flatten().to_numpy().astype(np.int32) for p in found])
    (term, terms), (chunk, ids) = words("terms"), words("ids")
    code, n = np.repeat(term, numbers("counts")), sum(len(p.column("tfs").flatten()) for p in found)
    first_id = np.cumsum([0, *[len(p.column("ids").flatten()) for p in found[:-1]]])
    at = numbers("chunks") + np.repeat(first_id, [len(p.column("chunks").flatten()) for p in found])
    tf, dl, chunk = numbers("tfs"), numbers("dls")[at], chunk[at]
    places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(numbers("positions")))

    order = np.lexsort((chunk, -_strength(tf, dl), code))
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    within = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    first = np.flatnonzero(within % BLOCK == 0)
    sizes = np.diff(np.append(first, n))
    order = order[np.lexsort((chunk[order], np.repeat(np.arange(len(first)), sizes)))]
    ends = np.append(first, n).astype(np.int32)
    code, chunk, tf, dl = code[order], chunk[order], tf[order], dl[order]
    most, least = np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)
    batches = []
    for b in range(0, len(first), BATCH):
        own, bounds = slice(b, b + BATCH), ends[b : b + BATCH + 1]
        x = slice(bounds[0], bounds[-1])
        lists = [pa.ListArray.from_arrays(pa.array(bounds - bounds[0]), y) for y in (ids.take(pa.array(chunk[x])), pa.array(tf[x]), pa.array(dl[x]), places.take(pa.array(order[x])))]
        batches.append(pa.RecordBatch.from_arrays([terms.take(pa.array(code[first[own]])), pa.array(sizes[own].astype(np.int32)), pa.array(most[own]), pa.array(least[own]), *lists], names=["term", "n", "max_tf", "min_dl", "chunk_ids", "tfs", "dls", "positions"]))
    give_back()
    return pa.Table.from_batches(batches)


def impact(tf: Column, dl: Column, average: Column) -> Column:
    """What an occurrence scores beside its term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def _grouped(dealt: DataFrame, groups: int) -> DataFrame:
    return dealt.repartitionById(groups, F.col("bucket")).groupBy("bucket").applyInArrow(_pack, BLOCKS)


def blocks(found: DataFrame, postings: int) -> DataFrame:
    """Blocks of ``occurrences``, of which there are about ``postings``. Groups of terms are dealt out, and a common term's list spans several."""
    groups = max(1, math.ceil(postings / GROUP_POSTINGS))
    return _grouped(found.mapInArrow(lambda batches: _dealt(_coded(batches), groups), _DEALT), groups)


def chunk_blocks(chunks: DataFrame, n: int) -> DataFrame:
    """Blocks of ``n`` chunks (chunk_id, text), whose occurrences are counted and dealt out in one task."""
    groups = max(1, math.ceil(n / GROUP_CHUNKS))
    return _grouped(_words(chunks).mapInArrow(lambda batches: _dealt(_tokens(batches), groups), _DEALT), groups)


def block_counts(found: DataFrame) -> DataFrame:
    """Document counts (term, df) of blocks."""
    return found.groupBy("term").agg(F.sum("n").alias("df"))


def block_totals(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (chunks, tokens) of chunks and their blocks."""
    tokens = F.coalesce(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(found.agg(tokens.alias("tokens")))  # one row each


def lexicon(chunks: DataFrame, only: DataFrame | None = None) -> Lexicon:
    """The index of (chunk_id, text); ``only``: (term), for queries that ask for no other."""
    if only is None:
        found = stored(chunk_blocks(chunks, chunks.count()), "lexicon-blocks")
        return Lexicon(found, stored(block_counts(found), "lexicon-terms"), stored(block_totals(found, chunks), "lexicon-totals"))
    terms = small(only.select("term").union(only.sparkSession.sql("SELECT '' AS term")).distinct())
    found = stored(occurrences(chunks).join(terms, "term", "left_semi"), "lexicon-occurrences")
    counts = stored(counted(found), "lexicon-counts")
    return Lexicon(stored(blocks(found, found.count()), "lexicon-blocks"), counts.where("term <> ''").select("term", "df"), stored(counts.where("term = ''").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("df", "chunks"), ("tokens", "tokens"))]), "lexicon-totals"))


# asking


def units(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, unit, tokens) of (query_id, query): each white-space word of a query; ``unit`` names its tokens."""
    phrases = queries.select("query_id", F.posexplode(match_phrases(F.col("query"))).alias("phrase", "tokens"))
    return phrases.select("query_id", "phrase", F.array_join("tokens", " ").alias("unit"), "tokens")


def asked_terms(asked: DataFrame) -> DataFrame:
    return asked.select(F.explode("tokens").alias("term")).distinct()


def opened(rows: DataFrame, gone: DataFrame | None, *keep: str, positions: bool = False) -> DataFrame:
    """Live postings (chunk_id, tf, dl, positions?) of blocks, with the columns ``keep``."""
    lists = ["chunk_ids", "tfs", "dls", *(["positions"] if positions else [])]
    names = {"chunk_ids": "chunk_id", "tfs": "tf", "dls": "dl", "positions": "positions"}
    more = ["commit"] if gone is not None else []
    each = rows.select(*keep, *more, F.explode(F.arrays_zip(*lists)).alias("p")).select(*keep, *more, *[F.col(f"p.{c}").alias(names[c]) for c in lists])
    if gone is None:
        return each
    path = F.regexp_replace("chunk_id", "#[^#]*$", "")
    return each.withColumn("path", path).join(gone, "path", "left").where("until is null or commit >= until").drop("path", "until", "commit")


def run_hits(asked: DataFrame, index: Lexicon) -> DataFrame:
    """(unit, chunk_id, tf, dl) of units of several tokens: where each token stands as many places on as the unit says."""
    runs = asked.where(F.size("tokens") > 1).select("unit", "tokens").distinct()
    wanted = runs.select("unit", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "term"))
    held = opened(index.blocks.join(small(wanted), "term"), index.gone, "unit", "size", "at", positions=True)
    each = held.select("unit", "size", "chunk_id", "dl", F.transform("positions", lambda x: x - F.col("at")).alias("starts"))
    # a start that every token of the unit names
    met = each.groupBy("unit", "size", "chunk_id", "dl").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("size"))
    starts = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda a, x: F.array_intersect(a, x))
    return met.select("unit", "chunk_id", F.size(starts).alias("tf"), "dl").where("tf > 0")


def unit_hits(asked: DataFrame, index: Lexicon) -> DataFrame:
    """(unit, chunk_id, tf, dl): how often each of the ``asked`` units (unit, tokens) occurs in the chunks that hold it."""
    single = asked.where(F.size("tokens") == 1).select(F.col("unit").alias("term")).distinct()
    hits = opened(index.blocks.drop("positions").join(small(single), "term"), index.gone, "term").withColumnRenamed("term", "unit")
    return hits.unionByName(run_hits(asked, index))


def phrase_hits(queries: DataFrame, index: Lexicon) -> DataFrame:
    """(query_id, phrase, chunk_id, tf) of (query_id, query): how often each word of a query occurs."""
    asked = units(queries)
    return unit_hits(asked, index).join(small(asked.select("query_id", "phrase", "unit")), "unit").select("query_id", "phrase", "chunk_id", "tf")


def _weights(asked: DataFrame, df: DataFrame, index: Lexicon) -> DataFrame:
    """(query_id, unit, weight, average): a unit that a query names twice weighs twice."""
    per = asked.groupBy("query_id", "unit").agg(F.count("*").alias("times"))
    raw = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = per.join(df, "unit").crossJoin(F.broadcast(index.totals))  # totals: one row
    return rows.select("query_id", "unit", (F.col("times") * F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))).alias("weight"), _average().alias("average"))


def _average() -> Column:
    return F.when(F.col("tokens") > 0, F.col("tokens") / F.col("chunks")).otherwise(1.0)


def _part() -> Column:
    return F.col("weight") * impact(F.col("tf"), F.col("dl"), F.col("average"))


def scores(queries: DataFrame, index: Lexicon) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that holds a word of a query; ``bm25`` gives the best of them without all this work."""
    asked = units(queries)
    hits = stored(unit_hits(asked, index), "bm25-hits")
    weights = _weights(asked, hits.groupBy("unit").agg(F.count("*").alias("df")), index)
    return hits.join(weights, "unit").groupBy("query_id", "chunk_id").agg(F.round(F.sum(_part()), 9).alias("score"))


def candidates(queries: DataFrame, index: Lexicon, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lists, run hits, weights, candidates) of a batch: candidates (query_id, chunk_id) hold the ``k`` best of each query and few others."""
    asked = stored(units(queries), "bm25-asked")
    single = asked.where(F.size("tokens") == 1).select(F.col("unit").alias("term")).distinct()
    at_most = impact(F.col("max_tf"), F.col("min_dl"), _average()).alias("peak")
    held = index.blocks.drop("positions").join(small(single), "term").crossJoin(F.broadcast(index.totals))  # totals: one row
    lists = stored(held.select(F.col("term").alias("unit"), at_most, *[c for c in index.blocks.columns if c not in ("term", "positions")]), "bm25-lists")
    runs = stored(run_hits(asked, index), "bm25-runs")
    df = index.terms.where("df > 0").join(small(single), "term", "left_semi").withColumnRenamed("term", "unit")
    plain = stored(_weights(asked, df.unionByName(runs.groupBy("unit").agg(F.count("*").alias("df"))), index), "bm25-weights")

    # The best block of each term: its chunks tell what a query's k-th best chunk scores at least.
    best = lists.groupBy("unit").agg(F.max_by(F.struct(*[c for c in lists.columns if c != "unit"]), "peak").alias("b")).select("unit", "b.*")
    seen = opened(best, index.gone, "unit").join(small(plain), "unit").groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("score"))
    first = stored(top(seen, FIRST * k).select("query_id", "chunk_id"), "bm25-first")
    kth = top(_full(first, lists, runs, plain, index), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("reached")).where(F.col("n") == k).drop("n")

    # What a term adds at most; the least terms whose sum stays below a share of what is reached bring no candidates.
    peaks = lists.groupBy("unit").agg(F.max("peak").alias("most"), F.min("peak").alias("last"))
    most = F.col("weight") * F.coalesce("most", F.lit(K1 + 1))
    ranked = plain.join(peaks, "unit", "left").join(kth, "query_id", "left").withColumn("most", most).withColumn("reached", F.coalesce("reached", F.lit(0.0)) - ROOM)
    by = Window.partitionBy("query_id")
    upto = F.sum("most").over(by.orderBy("most", "unit").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("cut", F.col("reached") - F.sum("most").over(by) + F.col("most")).withColumn("leads", upto >= SHARE * F.col("reached"))
    # What a chunk that a term's opened blocks don't hold could still get from it.
    rest = F.when(~F.col("leads"), F.col("most")).when(F.coalesce(F.col("weight") * F.col("last") >= F.col("cut"), F.lit(True)), 0.0).otherwise(F.least("most", "cut"))
    weights = stored(ranked.withColumn("rest", rest).select("query_id", "unit", "weight", "average", "reached", "cut", "leads", "rest", F.sum("rest").over(by).alias("rests")), "bm25-leads")
    leads = small(weights.where("leads"))
    columns = ("query_id", "weight", "average", "rest", "rests", "reached")
    met = opened(lists.join(leads, "unit").where(F.col("weight") * F.col("peak") >= F.col("cut")), index.gone, *columns)
    met = met.unionByName(runs.join(leads, "unit").select(*columns, "chunk_id", "tf", "dl"))
    summed = met.groupBy("query_id", "chunk_id").agg(F.sum(_part()).alias("score"), F.sum("rest").alias("met"), F.first("rests").alias("rests"), F.first("reached").alias("reached"))
    hopes = summed.where(F.col("score") + F.col("rests") - F.col("met") >= F.col("reached"))
    return lists, runs, weights, stored(hopes.select("query_id", "chunk_id"), "bm25-candidates")


def _full(pairs: DataFrame, lists: DataFrame, runs: DataFrame, weights: DataFrame, index: Lexicon) -> DataFrame:
    """(query_id, chunk_id, score) of pairs (query_id, chunk_id), from the postings of these chunks."""
    wanted = small(pairs.select("chunk_id").distinct())
    hits = opened(lists, index.gone, "unit").unionByName(runs).join(wanted, "chunk_id", "left_semi")
    scored = hits.join(small(pairs), "chunk_id").join(small(weights.select("query_id", "unit", "weight", "average")), ["query_id", "unit"])
    return scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum(_part()), 9).alias("score"))


def bm25(queries: DataFrame, index: Lexicon, k: int = 30) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` best chunks of each query; equal scores by chunk_id. ``score`` is rounded to 9 digits."""
    lists, runs, weights, found = candidates(queries, index, k)
    return top(_full(found, lists, runs, weights, index), k)


def scored_share(queries: DataFrame, index: Lexicon, k: int = 30) -> DataFrame:
    """(query_id, postings, candidates): the postings in the lists of a query's words, and the chunks that are scored for its ``k`` best."""
    lists, runs, weights, found = candidates(queries, index, k)
    held = lists.select("unit", "n").unionByName(runs.groupBy("unit").agg(F.count("*").cast("int").alias("n"))).groupBy("unit").agg(F.sum("n").alias("n"))
    asked = weights.join(held, "unit").groupBy("query_id").agg(F.sum("n").alias("postings"))
    return asked.join(found.groupBy("query_id").agg(F.count("*").alias("candidates")), "query_id", "left")


def top(scored: DataFrame, k: int, order: Column | None = None) -> DataFrame:
    """The ``k`` first rows of each query, numbered; Spark prunes map-side."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score") if order is None else order, "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
