"""Bound-certified best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised once, cut only where they are longer than a sequence (the remainder comes
first, full pieces follow), and reduced to one small row a piece. A full piece is a sequence of its
own. The others are dealt over partitions of bounded size; each packs its pieces best-fit
decreasing, and lower bounds from dual feasible functions certify its number of sequences. The
partitions that stay above their bound give up their sequences that aren't full, the others their
emptiest one; these pieces are exchanged, dealt anew over as few partitions as they need and packed again, until one partition is
left or a round gains nothing.

Defined cases: a null text is the empty text, one piece of the end token alone; repeated rows are
packed once each; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_or_empty

LENGTH = 1024
END = 2
#: Pieces that one task packs.
PARTITION_PIECES = 50_000
#: Beyond these characters, or with a special token in the text, the slower library decides alone.
_PLAIN = re.compile("[^\x00-ɏ]|<\\|endoftext\\|>")


@functools.cache
def _whole(vocabulary: str) -> Callable[[str], list[int]]:
    """The tokenizer of ``vocabulary``, loaded by a worker that meets a text which needs it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@functools.cache
def _plain(vocabulary: str) -> Callable[[str], list[int]]:
    """A faster encoder with the same merges, where their rank file lies beside the vocabulary."""
    import public_tokenizers
    import tiktoken

    try:
        with open(re.sub(r"\.json$", ".tiktoken", vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except FileNotFoundError:
        return _whole(vocabulary)
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode(text: str, vocabulary: str) -> np.ndarray:
    """The ids of a text and the end token, as little-endian unsigned 32-bit integers."""
    ids = (_whole if _PLAIN.search(text) else _plain)(vocabulary)(text)
    ids.append(END)
    return np.array(ids, dtype="<u4")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: the first may be shorter."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def _pieces(vocabulary: str, length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py(), vocabulary)
                rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), length))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, length), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) for each size; among bins with room the fullest is taken.

    Open bins are kept by the room they have left; the bits of one integer tell which rooms occur.
    """
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            own, room = opened, capacity
            opened += 1
        bins[at], offsets[at] = own, capacity - room
        left = room - size
        if left:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, opened


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest of several dual feasible functions' sums, rounded up.

    Each function u maps sizes so that whatever fits into one bin sums to at most one bin, so the sum
    over all sizes bounds the number of bins. Tried are the identity; for every threshold t up to half
    the capacity the one that rounds sizes over capacity - t up to a bin and sizes under t down to
    nothing; and rounding to the multiples of a bin's k-th part.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    s = np.arange(capacity + 1)
    best = -(-int((count * s).sum()) // capacity)
    # thresholds: sums of a suffix (rounded up) and of a middle stretch
    number, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * s)])
    t = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 101):
        scaled = (k + 1) * s
        u = np.where(scaled % capacity == 0, k * s, scaled // capacity * capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


_PACKED = "row long, length long, part long, bin long, offset long, open boolean"


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True])
        sizes = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, sizes, n)
        gives = filled < capacity
        if n <= lower_bound(sizes, capacity):  # certified: only its emptiest sequence may still merge with others'
            gives &= np.arange(n) == filled.argmin()
        return pd.DataFrame({"row": group["row"].to_numpy(), "length": sizes, "part": group["part"].to_numpy(), "bin": bins, "offset": offsets, "open": gives[bins]})

    return pack


def pack_pieces(items: DataFrame, capacity: int = LENGTH, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``items``: (row, length) with unique ``row``. Gives (row, sequence_id, offset).

    A round deals what is left by hash over parts of ``partition_pieces``. Full sequences are final,
    and so is a part that meets its lower bound, but for its emptiest sequence. The pieces of the
    other sequences are dealt anew. If that takes no sequence less, their packing before stands.
    """
    parts, turn, todo, before, stands = max(1, -(-items.count() // partition_pieces)), 0, items, None, None
    open_ = F.col("open")
    done: list[DataFrame] = []
    while True:
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInPandas(_pack(capacity), _PACKED), "packing-round").withColumn("sequence_id", F.lit(turn) * (1 << 52) + F.col("part") * (1 << 20) + F.col("bin"))
        first = F.col("offset") == 0
        n, n_open, left = packed.agg(F.count_if(first), F.count_if(first & open_), F.count_if(open_)).first()
        if before is not None and n >= before:
            done.append(stands)
            break
        if parts == 1 or not left:
            done.append(packed)
            break
        done.append(packed.where(~open_))
        stands, before, todo = packed.where(open_), n_open, packed.where(open_).select("row", "length")
        parts, turn = min(parts, max(1, -(-left // partition_pieces))), turn + 1
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out.select("row", "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, key: str = "doc_id", text: str = "text", partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, vocabulary, length, key, text).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < length)
    packed = rest.join(pack_pieces(rest.select("row", "length"), length, partition_pieces), "row")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*out).unionByName(packed.select(*out))
