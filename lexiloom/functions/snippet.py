"""Query-aware snippets as column expressions: the sentence that answers best, widened by its neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import intent, intent_bonus, query_terms, sentence_score, sentences, strip, word_line

# The length of a snippet, and how far before a term it starts and looks for a space.
CAP, LEAD, LOOK = 280, 30, 40


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _before_last_space(text: Column) -> Column:
    """Length of what stands before the last space; -1 without one."""
    return F.length(text) - F.length(F.substring_index(text, " ", -1)) - 1


def head(text: Column, cap: int) -> Column:
    """The start of a text: up to its last sentence end beyond half of the cap, else the last space."""
    window = F.substring(text, 1, cap)
    end = F.regexp_extract(window, r"(?s)\A(.*[.!?])(?=\s|\z)", 1)
    space = _before_last_space(window)
    cut = F.when(F.length(end) > cap / 2, end).when(space > 0, F.substring(window, F.lit(1), space)).otherwise(window)
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(strip(cut), F.lit(" …")))


def _starts(text: Column, terms: Column) -> Column:
    """Where terms start a word, in order; twice where two do."""

    def of(term: Column, line: Column) -> Column:
        # what stands between the occurrences adds up to where they are
        between = F.transform(F.split(line, F.concat(F.lit(" "), term), -1), F.length)
        added = F.aggregate(
            F.slice(between, 1, F.size(between) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda a, n: F.struct((a["at"] + n + F.length(term) + 1).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")),
        )
        return added["all"]

    return _with(word_line(text), lambda line: F.array_sort(F.flatten(F.transform(terms, lambda term: of(term, line)))))


def around_terms(text: Column, terms: Column, cap: int, inside: Column) -> Column:
    """The part of a long sentence with the most term starts, cut at spaces."""

    def cut(at: Column) -> Column:
        # the first of those with the most starts within reach
        best = F.array_max(F.transform(at, lambda p: F.struct(F.size(F.filter(at, lambda q: (q >= p) & (q < p + cap))).alias("n"), (-p).alias("back"))))
        begin = F.greatest(F.lit(0), -best["back"] - LEAD)
        return _with(F.struct(begin.alias("begin"), F.least(F.length(text), begin + cap).alias("end")), placed)

    def placed(w: Column) -> Column:
        space = F.instr(F.substring(text, w["begin"] + 1, F.lit(LOOK)), F.lit(" "))
        begin = F.when((w["begin"] > 0) & (space > 0), w["begin"] + space).otherwise(w["begin"])
        last = _before_last_space(F.substring(text, F.lit(1), w["end"] + 1))
        return _with(F.struct(begin.alias("begin"), w["end"].alias("end"), last.alias("last")), shown)

    def shown(w: Column) -> Column:
        end = F.when((w["end"] < F.length(text)) & (w["last"] > w["begin"]), w["last"]).otherwise(w["end"])
        dots = lambda when, dots: F.when(when, dots).otherwise("")
        return F.concat(dots((w["begin"] > 0) | inside, "… "), strip(F.substring(text, w["begin"] + 1, end - w["begin"])), dots(end < F.length(text), " …"))

    return _with(_starts(text, terms), lambda at: F.when(F.size(at) == 0, head(text, cap)).otherwise(cut(at)))


def _grown(parts: Column, plain: Column, best: Column, cap: int) -> Column:
    """(first, last) of the sentences around the best that fit: each step takes the neighbour that scores more, the next one of equals, or the other if it doesn't fit."""
    size = lambda i: F.length(F.get(parts, i)) + 1

    def step(w: Column, _: Column) -> Column:
        after, before = F.get(plain, w["last"] + 1), F.when(w["first"] > 0, F.get(plain, w["first"] - 1))
        fits_after = F.coalesce(w["length"] + size(w["last"] + 1) <= cap, F.lit(False))
        fits_before = F.coalesce((w["first"] > 0) & (w["length"] + size(w["first"] - 1) <= cap), F.lit(False))
        forward = after.isNotNull() & (before.isNull() | (after >= before))
        move = F.when(forward, F.when(fits_after, 1).when(fits_before, -1)).otherwise(F.when(fits_before, -1).when(fits_after, 1))
        return _with(F.coalesce(move, F.lit(0)), lambda m: F.struct(
            (w["first"] - F.when(m < 0, 1).otherwise(0)).alias("first"), (w["last"] + F.when(m > 0, 1).otherwise(0)).alias("last"),
            (w["length"] + F.when(m > 0, size(w["last"] + 1)).when(m < 0, size(w["first"] - 1)).otherwise(0)).alias("length"),
        ))

    start = F.struct(best.alias("first"), best.alias("last"), F.length(F.get(parts, best)).alias("length"))
    # a step adds two characters at least
    return F.aggregate(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(cap // 2))), start, step)


def snippet(text: Column, query: Column, cap: int = CAP) -> Column:
    """A passage of about ``cap`` characters around the sentence that answers best."""
    own = F.struct(strip(text).alias("t"), query_terms(F.coalesce(query, F.lit(""))).alias("terms"), intent(F.coalesce(query, F.lit(""))).alias("kind"))

    def chosen(a: Column) -> Column:
        def scored(parts: Column) -> Column:
            return _with(F.transform(parts, lambda s: sentence_score(s, a["terms"])), lambda plain: peak(parts, plain))

        def peak(parts: Column, plain: Column) -> Column:
            best = F.array_max(F.transform(parts, lambda s, i: F.struct((F.get(plain, i) + intent_bonus(s, a["kind"])).alias("score"), (-i).alias("back"))))
            return _with(best, lambda b: F.when(F.coalesce(b["score"], F.lit(0)) == 0, head(a["t"], cap)).otherwise(_with(_grown(parts, plain, -b["back"], cap), lambda w: window(parts, w))))

        def window(parts: Column, w: Column) -> Column:
            joined = strip(F.array_join(F.slice(parts, w["first"] + 1, w["last"] - w["first"] + 1), " "))
            short = lambda x: F.concat(F.when(w["first"] > 0, "… ").otherwise(""), x, F.when(w["last"] < F.size(parts) - 1, " …").otherwise(""))
            return _with(joined, lambda x: F.when(F.length(x) > cap, around_terms(x, a["terms"], cap, w["first"] > 0)).otherwise(short(x)))

        asked = (F.size(a["terms"]) > 0) | (a["kind"] != "none")
        return F.when(F.length(a["t"]) <= cap, a["t"]).when(~asked, head(a["t"], cap)).otherwise(_with(sentences(a["t"]), scored))

    return F.when(text.isNotNull(), _with(own, chosen))
