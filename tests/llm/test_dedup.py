import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
OTHERS = ["bucket", "salt", "fp", "_text", "_fp", "_first", "_null_text", "rest", "row", "f", "f0", "owner", "n", "key", "a.b"]


def docs(spark, rows):
    """Documents with columns named like the ones that operators use."""
    names = ", ".join(f"`{x}` string" for x in OTHERS)
    return spark.createDataFrame([(i, t, *OTHERS) for i, t in rows], f"doc_id long, text string, {names}")


def brute_exact(rows):
    norm = [(i, (t or "").translate(ASCII)) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "X" * 300_000), (9, " abc"), *((100 + i, "Same") for i in range(300))]


@pytest.mark.parametrize("capacity", [1 << 24, 2_000])
def test_exact_dedup_equals_brute_force(spark, capacity):
    found = exact_dedup.exact_dedup(docs(spark, ROWS).repartition(3), capacity=capacity).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_exact(ROWS)
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept})


@pytest.mark.parametrize("capacity", [1 << 24, 2_000])
def test_drop_exact_copies_keeps_whole_rows(spark, capacity):
    kept = exact_dedup.drop_exact_copies(docs(spark, ROWS), capacity=capacity)
    assert kept.schema.simpleString() == docs(spark, []).schema.simpleString()
    rows = kept.collect()
    assert all(tuple(r)[2:] == tuple(OTHERS) for r in rows)
    got = sorted((r.doc_id, r.text) for r in rows)
    assert got == sorted([(2, "aBC"), (4, ""), (5, "É"), (6, "é"), (8, "X" * 300_000), (9, " abc"), (399, "Same")])


def test_colliding_keys_are_told_apart_by_bytes():
    assert exact_dedup._chains([7, 7, 7, 8], [b"a", b"b", b"a", b"a"]) == [0, 1, 0, 2]


def test_directory_splits_until_buckets_fit_and_deals_what_cannot_split():
    sizes = np.array([10, 0, 0, 0, 1, 1, 1, 100])
    directory = exact_dedup.Directory(sizes, 12)
    held = np.bincount(directory.bucket[np.arange(8) >> (3 - directory.depth)], sizes)
    assert all(h <= 12 * o for h, o in zip(held, directory.owners, strict=True)) and directory.owners.max() == 9
    assert directory.first.tolist() == [sum(directory.owners[:i]) for i in range(len(directory.owners))]


def test_tasks_hold_a_bucket_at_any_size(spark):
    rows = docs(spark, [(i, f"text {i} " * 20) for i in range(600)] + [(1000 + i, "hot " * 40) for i in range(300)])
    inputs = exact_dedup._inputs(rows, "doc_id", "text")
    for times in (1, 4):
        many = inputs
        for k in range(1, times):
            many = many.unionByName(inputs.withColumn("text", F.concat("text", F.lit(f" {k}"))))
        directory = exact_dedup.build_directory(many.select("text"), 20_000)
        sizes = exact_dedup._owned(many, directory).groupBy(F.spark_partition_id()).agg(F.sum(F.length("text") + 64).alias("held"), F.count_distinct("owner").alias("owners")).collect()
        assert max(r.held for r in sizes) < 40_000 and {r.owners for r in sizes} == {1}


def test_dedup_of_an_empty_table(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0
    assert simhash.near_components(none).count() == 0
    assert simhash.drop_near_copies(none).count() == 0


def slow_fingerprint(text):
    words, word = [], ""
    for c in text.translate(ASCII) + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of (id, fp). Smallest id reachable, by plain search over all pairs."""
    label = {fp: fp for _, fp in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    own = list(label)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    first = {}
    for i, fp in prints:
        first[root(fp)] = min(first.get(root(fp), i), i)
    return sorted((i, f"{fp:016x}", first[root(fp)]) for i, fp in prints)


@pytest.mark.parametrize("text", ["", " \t", "a", "A b", "a b c", "a\xa0b c d", "É È é x y", "to be or not to be " * 50, "x" * 100_000, "w " * 200_000])
def test_fingerprint_equals_the_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(1, None), (2, ""), (3, "a"), (4, "b c")]
    for k in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for c in range(20):
            own = list(base)
            own[rng.randrange(400)] = "changed"
            rows.append((1000 * k + c + 10, " ".join(own)))
    rows += [(9000 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(60)]
    return rows + rows[5:9]


@pytest.mark.parametrize("node_rows", [simhash.NODE_ROWS, 3])
def test_near_components_equal_brute_force(spark, node_rows):
    rows = near_rows()
    found = simhash.near_components(docs(spark, rows).repartition(3), node_rows=node_rows).collect()
    expected = brute_components([(i, slow_fingerprint(t or "")) for i, t in rows])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert len({x[2] for x in expected}) < len(expected) - 40  # there were near copies to find


def test_drop_near_copies_keeps_the_smallest_id_of_each_component(spark):
    rows = near_rows()
    expected = {c for _, _, c in brute_components([(i, slow_fingerprint(t or "")) for i, t in rows])}
    kept = simhash.drop_near_copies(docs(spark, rows))
    assert kept.schema.simpleString() == docs(spark, []).schema.simpleString()
    assert all(tuple(r)[2:] == tuple(OTHERS) for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


@pytest.mark.parametrize("seed", range(4))
def test_trie_walk_connects_all_close_values(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 48, (3, 40, 30), dtype=np.uint64))
    values = np.unique(np.concatenate([base, *(base[:, None] ^ flips[0] ^ f for f in (flips[1], flips[1] ^ flips[2]))], axis=None))
    unit = (values >> np.uint64(48)).astype(np.int64)
    label = simhash.trie_links(values, unit, np.full(len(values), 16), np.zeros(len(values), dtype=np.int64))
    for node in np.unique(unit):
        own = np.flatnonzero(unit == node)
        close = np.bitwise_count(values[own][:, None] ^ values[own][None]) <= 3
        assert (label[own][:, None] == label[own][None])[close].all()
        assert (unit[label[own]] == node).all()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)] + [(7, 7)]
    found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
