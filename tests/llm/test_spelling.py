"""Spelling variants against a brute-force version: all pairs, edits tried one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import spelling


def counted(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    form, out = {}, {}
    beside = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(beside[w], key=lambda x: (-words[x], x.encode()), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(beside[w]), words.get(form.get(w)))
    return out


def test_one_edit():
    words = ["abc", "abd", "ab", "abcd", "bc", "acb", "", "a", "xabc", "abxc", "é", "è"]
    for a in words:
        for b in words:
            assert spelling.one_edit(a.encode("latin-1"), b.encode("latin-1")) == near(a, b)


def dealt(words, top):
    """The buckets of the words, as Spark deals them."""
    out = {}
    for n, w in enumerate(words):
        groups = np.bincount(spelling._GROUP_OF[list(w.encode("latin-1"))], minlength=spelling.GROUPS)
        c = [int(groups[a:b].sum()) for a, b in spelling.ranges(top)]
        places = [(c, True)]
        for i in range(top):
            up = [x + (g == i) for g, x in enumerate(c)]
            places += [(up, False)] + [([x - (g == j) for g, x in enumerate(up)], False) for j in range(i + 1, top) if c[j]]
        for place, home in places:
            out.setdefault(tuple(place), []).append({"bucket": ",".join(map(str, [*place, 0])), "home": home, "word": w, "n": n})
    return [pa.Table.from_pylist(rows) for rows in out.values()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aeñÉxh", max_size=9), unique=True, min_size=1, max_size=40), st.integers(0, 70), st.sampled_from(spelling.TOPS))
def test_trie_and_matrix_find_every_pair_once(words, pad, top):
    words = [w + "q" * pad for w in words]  # beyond 64 letters they are compared one by one
    got = [tuple(sorted((r["a"], r["b"]))) for rows in dealt([w for w in words if w], top) for r in spelling._near(top)(rows).to_pylist()]
    assert sorted(got) == sorted((a, b) for i, a in enumerate(sorted(words)) for b in sorted(words)[i + 1 :] if a and near(a, b))


def test_ranges():
    for top in spelling.TOPS:
        own = spelling.ranges(top)
        assert len(own) == top and own[0][0] == 0 and own[-1][1] == spelling.GROUPS
        assert all(a < b for a, b in own) and all(x[1] == y[0] for x, y in zip(own, own[1:]))


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(3)
    stems = ["organise", "coloured", "naïveté", "straßenbahn", "theatrical", "x" * 70 + "yz"]

    def slip(w):
        i, c = rng.randrange(len(w)), rng.choice("aeizé")
        return rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]))

    rows = [(i, " ".join(rng.choice((w, w, w, w, w, slip(w), slip(slip(w)))) for w in rng.choices(stems, k=60))) for i in range(60)]
    rows += [(1, None), (None, "Organise ORGANISE organise É×÷Éstrange"), (None, ""), (7, "anagrams ananagms agnarams " * 5), (8, "colour" * 3000 + " " + "colour" * 3000)]
    return rows


@pytest.mark.parametrize("limit", [spelling.BUCKET_WORDS, 25, 3])
def test_brute_force(spark, misspelt, limit):
    """Small buckets need longer tops, and slices where no top is long enough."""
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in misspelt], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs, limit=limit).collect()}
    want = grouped(counted(misspelt))
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 20


def test_chain_of_forms_and_ties(spark):
    words = spark.createDataFrame([("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10_000), ("zzzzzzz", 1)], "word string, n long")
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == dict.fromkeys("abcdx", "e")
    assert len(spelling.near_words(words).collect()) == 4
    docs = spark.createDataFrame([(1, "abcdefg " * 2 + "abcdefh abcdefi " * 30)], "doc_id long, text string")
    got = {r.word: r.form for r in spelling.group_variants(docs, slips=10**9).collect()}
    assert got == {"abcdefg": "abcdefh", "abcdefh": None, "abcdefi": None}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).collect() == []
