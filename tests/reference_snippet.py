"""Snippets once more, a row at a time, to hold the column expressions against."""

from __future__ import annotations

import re

from lexiloom.functions.text import NUMBER, PERSON, PLACE, QUESTION_WORDS, STOPWORDS, YEAR

# The length of a snippet, and how far before a term it starts and looks for a space.
CAP, LEAD, LOOK = 280, 30, 40
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|\n{2,}")
_NOT_WORD = re.compile("[^a-z0-9_]")
_SIGNS = {"when": re.compile(YEAR), "where": re.compile(PLACE), "who": re.compile(PERSON), "count": re.compile(NUMBER)}
_IGNORED = frozenset((*STOPWORDS, *QUESTION_WORDS))


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9_]+", query.lower()) if len(t) >= 3 and t not in _IGNORED))


def intent_of(query: str) -> str:
    words = re.split(r"\s+", query.lower())
    first = words[0]
    if first in ("when", "where", "who"):
        return first
    if first == "whom":
        return "who"
    if first == "how" and words[1:2] in (["many"], ["much"]):
        return "count"
    return "when" if "year" in words and first in ("what", "which") else "none"


def _starts(text: str, terms: list[str]) -> list[int]:
    low = text.lower()
    return sorted(m.start() for t in terms for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(t)}", low))


def _score(sentence: str, terms: list[str]) -> int:
    line = " " + _NOT_WORD.sub(" ", sentence.lower())
    return sum(" " + t in line for t in terms)


def head(text: str, cap: int) -> str:
    """The start of a text: up to its last sentence end beyond half of the cap, else the last space."""
    if len(text) <= cap:
        return text
    window = text[:cap]
    ends = [m.start() + 1 for m in re.finditer(r"[.!?](?=\s|\Z)", window)]
    if ends and ends[-1] > cap / 2:
        return window[: ends[-1]].strip() + " …"
    space = window.rfind(" ")
    return (window[:space] if space > 0 else window).strip() + " …"


def around_terms(text: str, terms: list[str], cap: int, inside: bool) -> str:
    """The part of a long sentence with the most term starts, cut at spaces."""
    at = _starts(text, terms)
    if not at:
        return head(text, cap)
    # Starts within reach of each start, by two pointers: the first with the most wins.
    best, most, last = at[0], 0, 0
    for i, p in enumerate(at):
        while last < len(at) and at[last] < p + cap:
            last += 1
        if last - at.index(p, 0, i + 1) > most:
            best, most = p, last - at.index(p, 0, i + 1)
    start = max(0, best - LEAD)
    end = min(len(text), start + cap)
    if start and (space := text.find(" ", start)) != -1 and space < start + LOOK:
        start = space + 1
    if end < len(text) and (space := text.rfind(" ", 0, end + 1)) > start:
        end = space
    return ("… " if start or inside else "") + text[start:end].strip() + (" …" if end < len(text) else "")


def make_snippet(text: str, query: str, cap: int = CAP) -> str:
    """A passage of about ``cap`` characters around the sentence that answers best."""
    text = text.strip()
    if len(text) <= cap:
        return text
    terms, kind = terms_of(query), intent_of(query)
    parts = [s for s in (x.strip() for x in _BREAK.split(text)) if s]
    if not parts or (not terms and kind == "none"):
        return head(text, cap)
    plain = [_score(s, terms) for s in parts]
    scores = [p + (2 if kind in _SIGNS and _SIGNS[kind].search(s) else 0) for p, s in zip(plain, parts, strict=True)]
    best = max(range(len(parts)), key=lambda i: (scores[i], -i))
    if not scores[best]:
        return head(text, cap)
    first = last = best
    length = len(parts[best])
    while True:
        after = plain[last + 1] if last + 1 < len(parts) else None
        before = plain[first - 1] if first else None
        forward_first = after is not None and (before is None or after >= before)
        for forward in (forward_first, not forward_first):
            own = parts[last + 1] if forward and after is not None else parts[first - 1] if not forward and before is not None else None
            if own is not None and length + len(own) + 1 <= cap:
                length += len(own) + 1
                first, last = (first, last + 1) if forward else (first - 1, last)
                break
        else:
            break
    window = " ".join(parts[first : last + 1]).strip()
    if len(window) > cap:
        return around_terms(window, terms, cap, first > 0)
    return ("… " if first else "") + window + (" …" if last < len(parts) - 1 else "")
