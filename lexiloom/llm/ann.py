"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every distinct vector is indexed:
its list and the codes of its residual. Lists are laid into blocks of bounded size (a large list
into several), and each query goes to the blocks that hold one of its probed lists. A block goes to as
many tasks as the queries routed to it need, so what is shuffled grows with the rows and with the
queries' routes. There asymmetric
distance tables score the codes, the best are reranked exactly, in double precision on the original
vectors, and so is every vector whose score plus its quantisation error could reach the k-th nearest
found so far; the nearest of each block go on. So nothing in a probed list is missed, and recall rests on
the lists alone: how many are probed is set on the sample, for a recall beyond the stated one.

Equal vectors are indexed once, with their smallest ids, as many as any answer can hold; equal
query vectors are searched once. So a vector that a third of the rows share is one entry.

Components may be of any numeric type; lists and codes are made in single precision, scores in double.

Defined cases: vectors that are null, zero, or hold null or non-finite components (or such as single precision can't hold) take no part, and
rows without an id neither; only vectors of one length are compared; a query is not its own candidate, a
repeated row of it is; ties go to the smaller id; fewer candidates than asked are all returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of smallest hash on which centroids and codebooks are fitted.
SAMPLE = 20_000
#: Vectors a list, lists at most, vectors and queries a block.
LIST_ROWS, MAX_LISTS, BLOCK_ROWS, BLOCK_QUERIES = 400, 8192, 20_000, 16_384
#: Candidates of a query that are reranked first, for each neighbour asked; vectors compared exactly at once.
RERANK, RERANK_ROWS = 10, 4_096
#: What rounding in single precision may add to a score's error, as a share of the two vectors' norms.
ROUNDING = 1e-5
RECALL = 0.97


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        count = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers[count > 0] = total[count > 0] / count[count > 0, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centers.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


@dataclass
class Index:
    """Coarse centroids (lists, dim), codebooks (parts, codes, width) and how many lists a query probes."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and codes of each vector."""
        own = _nearest(x, self.centroids)
        residual = self._parts(x - self.centroids[own])
        return own, np.stack([_nearest(residual[:, j], self.codebooks[j]) for j in range(len(self.codebooks))], axis=1).astype(np.uint8)

    def errors(self, x: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a vector's table score may be wrong by, for a query of norm one."""
        lost = self._parts(x - self.centroids[own]) - self.codebooks[np.arange(codes.shape[1]), codes]
        return np.sqrt((lost.astype(np.float64) ** 2).sum((1, 2))) + ROUNDING * np.sqrt((x.astype(np.float64) ** 2).sum(1))

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.codebooks.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """The lists that each query probes, (queries, probes): those of largest inner product."""
        score = queries @ self.centroids.T
        return np.argpartition(-score, self.probes - 1, axis=1)[:, : self.probes]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: inner product of each code with each query's part, (parts, codes, queries)."""
        return self.codebooks @ self._parts(queries).transpose(1, 2, 0)


def fit_index(sample: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 11) -> Index:
    """``rows``: how many vectors will be indexed; ``k``: how many neighbours a query asks for."""
    rng = np.random.default_rng(seed)
    lists = int(np.clip(rows // LIST_ROWS, 8, MAX_LISTS))
    centroids = _kmeans(sample, lists, rng, 10)
    residual = sample - centroids[_nearest(sample, centroids)]
    parts = min(32, sample.shape[1])
    width = -(-sample.shape[1] // parts)
    padded = np.pad(residual, ((0, 0), (0, parts * width - sample.shape[1]))).reshape(len(sample), parts, width)
    fit = padded[rng.permutation(len(padded))[:4096]]
    index = Index(centroids, np.stack([_pad_codes(_kmeans(fit[:, j], 256, rng, 6)) for j in range(parts)]), len(centroids))
    # The rank of the list in which a sample's true neighbours lie tells how many lists must be probed.
    queries = sample[rng.permutation(len(sample))[:256]]
    near = np.argpartition(-(queries @ sample.T), min(k, len(sample) - 1), axis=1)[:, : k + 1]
    order = np.argsort(np.argsort(-(queries @ centroids.T), axis=1), axis=1)
    ranks = np.take_along_axis(order, _nearest(sample, centroids)[near], axis=1)
    index.probes = int(np.clip(np.quantile(ranks, recall) + 1, 1, len(centroids)))
    return index


def _pad_codes(centers: np.ndarray) -> np.ndarray:
    return np.concatenate([centers, np.repeat(centers[:1], 256 - len(centers), axis=0)])


def _valid(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("float")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _lists(index: Index, dim: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest(_matrix(batch.column("vector"), dim), index.centroids)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32))], names=["list"])

    return lists


def _encode(index: Index, dim: int, blocks: dict[int, list[int]], slices: dict[int, int]):
    """A vector goes once to each slice of its block."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            own, codes = index.assign(x)
            block = np.array([blocks[w][n % len(blocks[w])] for w, n in zip(own.tolist(), batch.column("node").to_pylist(), strict=True)], dtype=np.int32)
            times = np.array([slices.get(b, 0) for b in block.tolist()], dtype=np.int64)
            at = np.repeat(np.arange(len(block)), times)
            columns = [*batch.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(index.errors(x, own, codes)), pa.array(block)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in columns), pa.array((np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32))], names=[*batch.schema.names, "list", "codes", "error", "block", "slice"])

    return encode


def _routes(index: Index, dim: int, blocks: dict[int, list[int]], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, block): a query goes once to each block that holds one of its lists."""
    to = [sorted({b for w in own for b in blocks.get(w, ())}) for own in index.probed(_matrix(batch.column("vector"), dim)).tolist()]
    return np.repeat(np.arange(len(to)), [len(x) for x in to]), np.array([b for x in to for b in x], dtype=np.int32)


def _load(index: Index, dim: int, blocks: dict[int, list[int]]):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, n = np.unique(_routes(index, dim, blocks, batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(n.astype(np.int64))], names=["block", "n"])

    return load


def _route(index: Index, dim: int, blocks: dict[int, list[int]], slices: dict[int, int]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, block = _routes(index, dim, blocks, batch)
            node = batch.column("node").to_numpy()[at]
            part = node % np.array([slices[b] for b in block.tolist()], dtype=np.int64) if len(at) else node
            yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("vector").take(pa.array(at)), pa.array(block), pa.array(part.astype(np.int32))], names=["query", "vector", "block", "slice"])

    return route


def _score(index: Index, dim: int, keep: int, k: int):
    """The ``k`` nearest of a block's vectors for each of its queries.

    Tables over the codes of the lists that a query probes choose ``keep`` vectors; these are
    compared exactly, then all others that could be nearer than the ``k``-th of them, likeliest first.
    """

    def exactly(x, node, q, own, best):
        exact = (x[own] * q).sum(axis=1)
        ids, scores = np.concatenate([best[0], node[own]]), np.concatenate([best[1], exact])
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]

    def score(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]
        if nodes.num_rows and queries.num_rows:
            nodes = nodes.sort_by("list")
            lists = nodes.column("list").to_numpy()
            code = np.frombuffer(b"".join(nodes.column("codes").to_pylist()), np.uint8).reshape(len(lists), -1)
            node, query = nodes.column("node").to_numpy(), queries.column("query").to_numpy()
            x, error = _matrix(nodes.column("vector"), dim, np.float64), nodes.column("error").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            found = []
            for at in range(0, len(query), 256):
                exact_q = _matrix(queries.column("vector").slice(at, 256), dim, np.float64)
                q = exact_q.astype(np.float32)
                total = np.full((len(lists), len(q)), -np.inf, dtype=np.float32)
                tables, coarse, probed = index.tables(q), q @ index.centroids.T, index.probed(q)
                for start, stop in zip(starts, [*starts[1:], len(lists)], strict=True):
                    w = lists[start]
                    asks = (probed == w).any(axis=1)
                    # Where most queries probe a list, all are scored, for a code's entries then lie side by side.
                    own = slice(None) if 2 * asks.sum() > len(q) else np.flatnonzero(asks)
                    part = np.repeat(coarse[own, w][None], stop - start, axis=0)
                    if part.size:
                        for j in range(code.shape[1]):
                            part += tables[j][:, own].take(code[start:stop, j], axis=0)
                        total[start:stop, own] = part
                    total[start:stop, ~asks] = -np.inf
                total = np.ascontiguousarray(total.T)
                top = np.argpartition(-total, min(keep, total.shape[1]) - 1, axis=1)[:, :keep]
                for i, own in enumerate(top):
                    own = own[total[i, own] > -np.inf]
                    ask = exact_q[i]
                    best = exactly(x, node, ask, own, (np.zeros(0, np.int64), np.zeros(0, np.float64)))
                    # All but these whose score could still reach the k-th; fewer than k means that no other is left.
                    reach = total[i] + np.sqrt(ask @ ask) * error
                    reach[own] = -np.inf
                    rest = np.flatnonzero(reach >= best[1][-1]) if len(best[1]) == k else np.flatnonzero(reach > -np.inf)
                    rest = rest[np.argsort(-reach[rest])]
                    for start in range(0, len(rest), RERANK_ROWS):
                        own = rest[start : start + RERANK_ROWS]
                        if len(best[1]) == k and reach[own[0]] < best[1][-1]:
                            break
                        best = exactly(x, node, ask, own, best)
                    found.append((np.full(len(best[0]), query[at + i]), *best))
            out = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"query": pa.array(out[0].astype(np.int64)), "node": pa.array(out[1].astype(np.int64)), "score": pa.array(out[2].astype(np.float64))})

    return score


def _lay_out(counts: dict[int, int]) -> dict[int, list[int]]:
    """Blocks of each list: small lists share one, a large one is dealt over several."""
    blocks, block, room = {}, 0, BLOCK_ROWS
    for own, n in sorted(counts.items()):
        parts = -(-n // BLOCK_ROWS)
        if parts > 1 or n > room:
            block, room = block + 1, BLOCK_ROWS
        blocks[own] = list(range(block, block + parts))
        block, room = (block + parts, BLOCK_ROWS) if parts > 1 else (block, room - n)
    return blocks


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for every row where ``is_query`` holds."""
    kind = "float" if rows.schema[vector].dataType.elementType.typeName() == "float" else "double"
    plain = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"), is_query.alias("asks")).where("vec_id is not null")
    lengths = plain.where("size(vector) > 0 and asks").select(F.size("vector").alias("dim")).distinct().collect()  # as many rows as there are lengths
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for found in filter(None, (_nearest_of(plain, r.dim, kind, k, sample, rerank) for r in lengths)):
        out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _nearest_of(plain: DataFrame, dim: int, kind: str, k: int, sample: int, rerank: int) -> DataFrame | None:
    """``nearest`` among (vec_id, vector, asks) of one length; none without vectors."""
    valid = stored(plain.where(_valid(F.col("vector"), dim)).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    # The first k+1 rows of each distinct vector, so that a query can leave itself out.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row"))
    firsts = valid.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    nodes = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "ann-nodes")
    n = nodes.count()
    if not n:
        return None
    drawn = nodes.select("vector").orderBy(F.xxhash64("vector")).limit(sample).toArrow()
    index = fit_index(_matrix(drawn.column("vector"), dim), n, k)
    counts = nodes.select("vector").mapInArrow(_lists(index, dim), "list int").groupBy("list").count()
    blocks = _lay_out({r.list: r["count"] for r in counts.collect()})  # at most MAX_LISTS rows
    asked = stored(valid.where("asks").select("vec_id", "row", "vector").join(nodes.select("vector", "node"), "vector").select("vec_id", "row", "node"), "ann-queries")
    questions = nodes.select("node", "vector").join(asked.select("node").distinct(), "node")
    load = questions.mapInArrow(_load(index, dim, blocks), "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))
    slices = {r.block: -(-r.n // BLOCK_QUERIES) for r in load.collect()}  # a row per block
    codes = nodes.select("node", "vector").mapInArrow(_encode(index, dim, blocks, slices), f"node long, vector array<{kind}>, list int, codes binary, error double, block int, slice int")
    routed = questions.mapInArrow(_route(index, dim, blocks, slices), f"query long, vector array<{kind}>, block int, slice int")
    score = _score(index, dim, rerank * k, k + 1)
    found = codes.groupBy("block", "slice").cogroup(routed.groupBy("block", "slice")).applyInArrow(score, "query long, node long, score double")
    scored = found.join(nodes.select("node", "ids"), "node")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id.vec_id", "id.row")
    top = scored.select("query", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "score", "id"))).alias("found"))
    answers = asked.join(lists.withColumnRenamed("query", "node"), "node").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"]["row"] != F.col("row")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def brute_force(vectors: pd.DataFrame, queries: pd.Series, k: int = 20) -> pd.DataFrame:
    """The exact answer on a small frame (vec_id, embedding), to measure recall against."""
    x = np.array(vectors["embedding"].tolist(), dtype=np.float64)
    ids = vectors["vec_id"].to_numpy()
    out = []
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        score = x @ x[at]
        order = [i for i in np.lexsort((ids, -score)) if i != at][:k]
        out += [(q, r + 1, ids[i], score[i]) for r, i in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
