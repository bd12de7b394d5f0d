"""Splitting and packing once more, a text at a time, to hold the column expressions against."""

from __future__ import annotations

import re

_SENTENCE = re.compile(r"[^.!?]+[.!?]+(?:\s+|\Z)|[^.!?]+\Z")


def split_text(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters: by paragraphs, else sentences, else fixed width."""
    if len(text) <= limit:
        return [text]
    for pieces, joiner in ((re.split(r"\n\s*\n", text), "\n\n"), ([s.strip() for s in _SENTENCE.findall(text)], " ")):
        if len(pieces) > 1:
            return pack(pieces, limit, joiner)
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def pack(pieces: list[str], limit: int, joiner: str) -> list[str]:
    """Neighbouring pieces joined greedily; each costs its length and a joiner; longer ones are split on their own."""
    out: list[str] = []
    held: list[str] = []
    cost = 0
    for piece in pieces:
        own = len(piece) + len(joiner)
        if held and (cost + own > limit or len(piece) > limit):
            out.append(joiner.join(held).strip())
            held, cost = [], 0
        if len(piece) > limit:
            out += split_text(piece, limit)
        else:
            held.append(piece)
            cost += own
    if held:
        out.append(joiner.join(held).strip())
    return [x for x in out if x]
