"""Spelling variants: words that differ by one letter, and the frequent form that a rare one stands for.

One inserted, deleted or replaced letter adds at most one letter to one group and takes at most one from another, so words
one edit apart have letter-group counts with a surplus and a deficit of at most one each. Words are
arranged in a trie by these counts, group after group. Its top, the counts of a few ranges of groups, is laid out over tasks: a
word lives in the bucket of its own counts and asks in every bucket that the budget reaches. In a task, the trie of
all groups is walked depth-first for each distinct vector of counts; branches that overspend, or that pass the range in which a bucket
says that the surplus or the deficit lies, are never entered. Words at the leaves it reaches are compared letter by letter.

A pair is found once: the first range, or within a bucket the first group, in which the two differ must be a surplus. How
many ranges make up the top follows the words: as few as keep every bucket within ``BUCKET_WORDS``. Should the
longest top leave larger ones, buckets are dealt over slices that are all asked, so a task's memory
stays bounded whatever the words.

Defined cases: null texts hold no words; a null key is the empty string where a key is written out; repeated rows count
again; ties of n go to the smaller word; words of any length are compared; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Letters by cell; each is a group of its own, and all other letters are one more, in the last cell. Cells hold about as many letters of a text.
CELLS = ("e", "n", "t", "im", "hy", "abw", "oc", "r", "lu", "sdg", "fzxqvpkj", "")
LETTERS = "".join(CELLS)
GROUPS = len(LETTERS) + 1
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How many times as often as the word itself its form occurs at least.
FORM_TIMES = 10
#: One in so many (document, word) pairs loses a letter.
SLIPS = 31
#: Words of a bucket, and the numbers of ranges that are tried for the trie's top; a range joins as many cells as any other.
BUCKET_WORDS = 40_000
TOPS = (1, 2, 3, 4, 6, 12)
#: Letters of words that are compared in a matrix; longer ones are compared one by one.
MATRIX_LETTERS = 64
#: Words that ask at once, and pairs that are compared at once.
ASKING, PAIRS = 50_000, 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP_OF = np.full(256, len(LETTERS), dtype=np.int64)
_GROUP_OF[[ord(c) for c in LETTERS]] = range(len(LETTERS))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", slips: int = SLIPS) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, one in ``slips`` (document, run) pairs without one of its letters."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text_or_empty(text), F.lit(RUN), F.lit(0))).alias("w")).where(F.length("w") >= LEAST_LENGTH)
    low = runs.select("d", F.when(F.lower("w") == F.col("w"), F.col("w")).otherwise(F.translate("w", _UPPER, _LOWER)).alias("w"))
    hashed = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % slips == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def ranges(top: int) -> list[tuple[int, int]]:
    """(first group, one past the last) of each range of the top."""
    ends = np.cumsum([len(c) for c in CELLS])
    ends[-1] += 1  # the other letters
    stops = [int(ends[len(CELLS) // top * (i + 1) - 1]) for i in range(top)]
    return list(zip([0, *stops[:-1]], stops, strict=True))


def _counts(word: Column, top: int) -> Column:
    """How many letters of a word lie in each range."""
    size = len(CELLS) // top
    held = [F.length(word) - F.length(F.translate(word, "".join(CELLS[at : at + size]), "")) for at in range(0, len(CELLS) - size, size)]
    return F.array(*held, F.length(word) - sum(held, F.lit(0)))


def _top(words: DataFrame, limit: int) -> tuple[int, int]:
    """(ranges of the trie's top, slices of a bucket) that keep what a task holds within ``limit`` words."""
    cells = words.select(_counts(F.col("word"), len(CELLS)).alias("c"))
    joined = lambda t: F.array(*[sum((F.col("c")[i] for i in range(at, at + len(CELLS) // t)), F.lit(0)) for at in range(0, len(CELLS), len(CELLS) // t)])
    each = cells.select(F.explode(F.array(*[F.struct(F.lit(t).alias("top"), joined(t).alias("bucket")) for t in TOPS])).alias("x"))
    most = {r.top: r.n for r in each.groupBy("x.top", "x.bucket").count().groupBy("top").agg(F.max("count").alias("n")).collect()}  # a row for each number tried
    fitting = [t for t in TOPS if most.get(t, 0) <= limit]
    return (fitting[0], 1) if fitting else (TOPS[-1], -(-most[TOPS[-1]] // limit))


def _dealt(words: DataFrame, top: int, slices: int) -> DataFrame:
    """(bucket, home, word, n): a word at home in its bucket, and wherever it asks. ``bucket``: counts by range and a slice, joined."""
    c, i32 = F.col("c"), lambda x: F.lit(x).cast("int")
    moved = lambda plus, minus: F.array(*[c[g] + i32((g == plus) - (g == minus)) for g in range(top)])
    reach = [F.when(c[j] > 0, moved(i, j)) if j is not None else moved(i, j) for i in range(top) for j in (None, *range(i + 1, top))]
    rows = words.select("word", "n", _counts(F.col("word"), top).alias("c"), F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("own"))
    all_slices = F.sequence(i32(0), i32(slices - 1))
    place = lambda bucket, at, home: F.struct(F.array_join(F.concat(bucket, F.array(at)).cast("array<string>"), ",").alias("bucket"), F.lit(home).alias("home"))
    asked = F.filter(F.array(*reach), lambda b: b.isNotNull())
    places = [F.array(place(c, F.col("own"), True)), F.flatten(F.transform(asked, lambda b: F.transform(all_slices, lambda s: place(b, s, False))))]
    if slices > 1:
        places.append(F.transform(F.filter(all_slices, lambda s: s != F.col("own")), lambda s: place(c, s, False)))
    return rows.select("word", "n", F.explode(F.concat(*places)).alias("p")).select("p.bucket", "p.home", "word", "n")


class Trie:
    """Vectors of letter-group counts; a branch with one vector is its leaf."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors, self.root = vectors, {}
        for at, vector in enumerate(vectors):
            self._add(at, vector)

    def _add(self, at: int, vector: list[int]) -> None:
        node, level = self.root, 0
        while True:
            below = node.get(vector[level])
            if below is None:
                node[vector[level]] = at
                return
            if type(below) is int:
                below = node[vector[level]] = {self.vectors[below][level + 1]: below}
            node, level = below, level + 1

    def within(self, vector: list[int]) -> list[int]:
        """Vectors that may have one more in one group and, after that, one less in another: the surplus comes first."""
        out, stack = [], [(self.root, 0, 1, 1)]
        while stack:
            node, level, plus, minus = stack.pop()
            if type(node) is int:
                out.append(node)
                continue
            c = vector[level]
            if (below := node.get(c)) is not None:
                stack.append((below, level + 1, plus, minus))
            if plus:
                if (below := node.get(c + 1)) is not None:
                    stack.append((below, level + 1, 0, minus))
            elif minus and (below := node.get(c - 1)) is not None:
                stack.append((below, level + 1, 0, 0))
        return out

    def moved(self, vector: list[int], plus: tuple[int, int], minus: tuple[int, int] | None) -> list[int]:
        """Vectors that may have one more in a group of the range ``plus`` and one less in one of ``minus``, if that is given."""
        up, up_end = plus
        down, down_end = minus or (-1, -1)
        out, stack = [], [(self.root, 0, True, minus is not None)]
        while stack:
            node, level, gain, lose = stack.pop()
            if type(node) is int:
                out.append(node)
                continue
            if gain and level >= up_end or lose and level >= down_end:
                continue  # its group has passed
            c = vector[level]
            if (below := node.get(c)) is not None:
                stack.append((below, level + 1, gain, lose))
            if gain and level >= up and (below := node.get(c + 1)) is not None:
                stack.append((below, level + 1, False, lose))
            if lose and level >= down and (below := node.get(c - 1)) is not None:
                stack.append((below, level + 1, gain, False))
        return out


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class _Words:
    """Words by letters, lengths and classes of equal counts."""

    def __init__(self, words: list[str]):
        self.raw = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in self.raw], dtype=np.int64)
        width = min(MATRIX_LETTERS, int(self.length.max(initial=1))) + 1
        self.letters = np.array([w[:width] for w in self.raw], dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
        at = np.repeat(np.arange(len(words)), self.length)
        held = np.bincount(at * GROUPS + _GROUP_OF[np.frombuffer(b"".join(self.raw), np.uint8)], minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
        narrow = np.ascontiguousarray(held.astype(np.uint8) if held.max(initial=0) < 256 else held)
        _, first, own = np.unique(narrow.view(f"S{GROUPS * narrow.itemsize}").ravel(), return_index=True, return_inverse=True)
        self.vectors = held[first]
        self.order = np.argsort(own.ravel(), kind="stable")
        self.size = np.bincount(own.ravel(), minlength=len(self.vectors))
        self.start = np.cumsum(self.size) - self.size


def _edits(a: _Words, b: _Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (word i of a, word j of b) differ by one edit."""
    longest = np.maximum(a.length[i], b.length[j])
    out = np.zeros(len(i), dtype=bool)
    for k in np.flatnonzero(longest > MATRIX_LETTERS):
        out[k] = one_edit(a.raw[i[k]], b.raw[j[k]])
    short = longest <= MATRIX_LETTERS
    width = min(MATRIX_LETTERS + 1, max(a.letters.shape[1], b.letters.shape[1]))
    wide = lambda w, rows: np.pad(w.letters[rows], ((0, 0), (0, width - w.letters.shape[1])))
    for n in (-1, 0, 1):  # b's word is shorter, as long or longer
        some = np.flatnonzero(short & (b.length[j] - a.length[i] == n))
        x, y = wide(a, i[some]), wide(b, j[some])
        if n == 0:
            out[some] = (x != y).sum(axis=1) == 1
            continue
        x, y = (x, y) if n > 0 else (y, x)  # x is the shorter
        first = (x != y).argmax(axis=1)  # they differ somewhere, for one goes on
        after = x[:, :-1] != y[:, 1:]
        last = np.where(after.any(axis=1), width - 2 - after[:, ::-1].argmax(axis=1), -1)
        out[some] = last < first
    return out


def _compared(a: _Words, b: _Words, ca: list[int], cb: list[int], same: bool, directed: np.ndarray):
    """Pairs (i, j) of words one edit apart, of pairs of classes; ``same``: both are the same words; ``directed``: where a surplus must come first."""
    ca, cb = np.array(ca, dtype=np.int64), np.array(cb, dtype=np.int64)
    apart = b.vectors[cb] - a.vectors[ca]
    first = apart[np.arange(len(apart)), (apart != 0).argmax(axis=1)]
    fits = ((first >= 0) | ~directed[ca]) & (np.maximum(apart, 0).sum(axis=1) <= 1) & (np.maximum(-apart, 0).sum(axis=1) <= 1)  # a leaf may stand high in the trie
    ca, cb, alike = ca[fits], cb[fits], ~apart[fits].any(axis=1)
    n = a.size[ca] * b.size[cb]
    for part in np.split(np.arange(len(ca)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
        for row in range(0, int(n[part].max(initial=0)), PAIRS):  # a pair of very large classes goes in pieces
            m = np.clip(n[part] - row, 0, PAIRS)
            own = np.repeat(part, m)
            at = row + np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
            i, j = a.order[a.start[ca[own]] + at // b.size[cb[own]]], b.order[b.start[cb[own]] + at % b.size[cb[own]]]
            hit = _edits(a, b, i, j)
            i, j, both = i[hit], j[hit], alike[own][hit]
            # words of equal counts meet from both sides: one of them counts
            once = ~both | (i < j if same else np.array([a.raw[x] < b.raw[y] for x, y in zip(i, j, strict=True)], dtype=bool))
            yield i[once], j[once]


_NEAR = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def _asked(trie: Trie, words: _Words, counts: np.ndarray, top: list[tuple[int, int]]) -> tuple[list[list[int]], np.ndarray]:
    """(vectors of the trie that may be one edit from each vector of ``words``, where both have the counts of one bucket)."""
    starts = [a for a, _ in top]
    apart = counts - np.add.reduceat(words.vectors, starts, axis=1)
    directed = ~apart.any(axis=1)
    found = []
    for vector, own, inside in zip(words.vectors.tolist(), apart.tolist(), directed.tolist(), strict=True):
        found.append(trie.within(vector) if inside else trie.moved(vector, top[own.index(1)], top[own.index(-1)] if -1 in own else None))
    return found, directed


def _near(top: int):
    """The pairs of a bucket: its own words with each other, and with the words that ask."""

    def near(rows: pa.Table) -> pa.Table:
        home = rows.column("home")
        own, asking, out = rows.filter(home), rows.filter(pc.invert(home)), []
        if not own.num_rows:
            return _NEAR.empty_table()
        counts = np.array([int(c) for c in rows.column("bucket")[0].as_py().split(",")[:-1]], dtype=np.int64)
        words = _Words(own.column("word").to_pylist())
        trie = Trie(words.vectors.tolist())
        for table in (own, *(asking.slice(at, ASKING) for at in range(0, asking.num_rows, ASKING))):
            other = words if table is own else _Words(table.column("word").to_pylist())
            found, directed = _asked(trie, other, counts, ranges(top))
            ca = [at for at, some in enumerate(found) for _ in some]
            for i, j in _compared(other, words, ca, [b for some in found for b in some], table is own, directed):
                a, b = table.take(pa.array(i)), own.take(pa.array(j))
                out.append(pa.table({"a": a.column("word"), "a_n": a.column("n"), "b": b.column("word"), "b_n": b.column("n")}))
        return pa.concat_tables(out).cast(_NEAR) if out else _NEAR.empty_table()

    return near


def near_words(words: DataFrame, limit: int = BUCKET_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of (word, n) that is one edit apart, once. ``words`` is read more than once."""
    top, slices = _top(words, limit)
    return _dealt(words, top, slices).groupBy("bucket").applyInArrow(_near(top), "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms lead from word to word. Each round doubles the steps taken, and forms grow tenfold in n."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = at.drop("moved").join(further, "root", "left")
        at = stored(moved.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots", instead=at)
    return at.drop("moved")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = FORM_TIMES, slips: int = SLIPS, limit: int = BUCKET_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = stored(count_words(docs, key, text, slips), "spelling-words")
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))
    sides = near_words(words, limit).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    with_near = words.join(near, "word", "left")
    stands = -F.col("best.less") >= times * F.col("n")
    found = stored(with_near.select("word", F.when(stands, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, -F.col("best.less")).alias("form_n")), "spelling-forms")
    leads = roots(found.where("form is not null").select("word", "form"))
    return found.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
