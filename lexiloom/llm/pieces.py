"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) model, by exact backtracking.

The encoding of a text is the only sequence of pieces in which every two neighbours, merged again from
their characters, come out as these two (and the first comes out as itself). So no merge queue over the text is needed:
an Aho-Corasick automaton gives the longest piece at each position, the sequence grows by it if it is
compatible with the piece before, else by the next shorter piece there; where none is left, the
last piece is taken back and its end marked in a bitfield of failed positions, which is never entered again. The time is
linear in the text, whatever it holds.

Pieces never join certain characters (in the usual models nothing but a space stands before a space),
so a text is cut there without changing its encoding; segments that come again are looked up.

Defined cases: a null text is the empty text: no ids, the hash of no bytes; repeated rows each get
their row; null ids are kept; characters without a piece become the pieces of their bytes; an empty table
gives no rows; other columns are ignored. Models with user-defined or unused pieces, of another type, or without byte
pieces are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Segments and pairs that a worker keeps, which changes no result. When segments are full, those not met since the last time go.
SEGMENTS, PAIRS = 400_000, 400_000
_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Numbers of the model format (fixed values): message fields, kinds of piece, the merge type.
_PIECES, _TRAINER, _KIND, _MODEL_TYPE = 1, 2, 3, 3
_NORMAL, _USER_DEFINED, _UNUSED, _MERGES = 1, 4, 5, 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """A merge-type model: ``encode`` and ``decode``."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        kinds = [dict(_fields(value)).get(_KIND, _NORMAL) for field, value in _fields(data) if field == _PIECES]
        trainer = next((dict(_fields(value)) for field, value in _fields(data) if field == _TRAINER), {})
        if trainer.get(_MODEL_TYPE) != _MERGES:
            raise ValueError("not a merge-type model")
        if {_USER_DEFINED, _UNUSED} & set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(self.library.is_byte, self.bytes)):
            raise ValueError("the model has no byte pieces")
        self.ids = {self.library.id_to_piece(i): i for i, kind in enumerate(kinds) if kind == _NORMAL}
        #: what merges: the piece with the highest score first, the leftmost of equals
        self.cost = {p: -self.library.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.cost:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.cost), p[0]) for p in self.cost}
        self.names = [str(i) for i in range(len(kinds))]
        self.segments: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cut = self._cuts()

    def _cuts(self):
        """Where texts are cut: no piece joins what two segments meet with."""
        joined = set("".join(self.cost))
        before_space = any(a != "▁" == b for p in self.cost for a, b in zip(p, p[1:]))
        if before_space:
            return re.compile(f"[{re.escape(''.join(sorted(joined)))}]+|.", re.DOTALL)
        own = re.escape("".join(sorted(joined - {"▁"})))
        return re.compile(f"▁+[{own}]*|[{own}]+|.", re.DOTALL)

    def remerge(self, text: str) -> list[str]:
        """The pieces of a short text by its merges, one after another."""
        parts = list(text)
        while True:
            costs = [self.cost.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((c for c in costs if c is not None), default=None)
            if least is None:
                return parts
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether the two stay as they are when merged from their characters; ``before`` is empty at the start."""
        found = self.pairs.get((before, piece))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[before, piece] = self.remerge(before + piece) == ([before, piece] if before else [piece])
        return found

    def pieces(self, text: str) -> list[str]:
        """The encoding of a normalised text as strings, by backtracking."""
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # matches that end later are longer
        stop, shorter, pairs = len(text), self.shorter, self.pairs
        failed = bytearray(stop // 8 + 1)
        out: list[str] = []
        at, piece, before = 0, longest[0] if text else None, ""
        while at < stop:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get((before, piece))
                    if fits or fits is None and self.compatible(before, piece):
                        break
                piece = shorter.get(piece)
            else:  # nothing goes on from here: the last piece goes, and what is shorter there is tried
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at, before, piece = at - len(last), out[-1] if out else "", shorter.get(last)
                continue
            out.append(piece)
            at, before = end, piece
            piece = longest[at] if at < stop else None
        return out

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of a segment that isn't among the newer ones."""
        if len(self.segments) >= SEGMENTS:
            self.segments, self.older = {}, self.segments
        found = self.older.get(text)
        if found is None:
            ids: list[int] = []
            for piece in self.pieces(text) if len(text) > 1 else [text]:
                own = self.ids.get(piece)
                ids += [own] if own is not None else [self.bytes[b] for b in piece.encode()]
            found = tuple(ids)
        self.segments[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        own = self.cut.findall(self.library.normalize(text))
        found = list(map(self.segments.get, own))
        if None in found:
            found = [ids or self.segment(s) for ids, s in zip(found, own, strict=True)]
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def model(path: str) -> PieceModel:
    """The model of a file, loaded once a worker."""
    return PieceModel(path)


def _digests(path: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches):
            n, coded, back = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join([own.names[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _ids(path: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))], names=[batch.schema.names[0], "ids"])

    return encoded


def _texts(path: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(ids.as_py() or []) for ids in batch.column("ids")], pa.string())], names=[batch.schema.names[0], "text"])

    return decoded


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    return _rows(docs, key, text).mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(path), "doc_id long, text string")


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    return _rows(docs, key, text).mapInArrow(_digests(path), f"doc_id long, {_DIGEST}")
