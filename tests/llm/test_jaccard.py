"""Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pytest

from cargoledger.llm import jaccard_join
from cargoledger.llm.components import components

SPACE = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = [w for w in "".join(" " if c in SPACE else c for c in (text or "").translate(LOWER)).split(" ") if w]
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice(["new", "Other", w + "x"]) if rng.random() < share else w for w in words]


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 7, 9, 20, 36, 60, 150, 500]))] for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        kind = rng.random()
        if kind < 0.5:
            words = edited(rng, words, rng.choice([0.005, 0.02, 0.04, 0.08]))
        elif kind < 0.7:
            words = words[: max(1, int(len(words) * rng.uniform(0.7, 1)))]
        elif kind < 0.8:
            words = passage + words
        text = rng.choice([" ", "\n", "  "]).join(words)
        rows.append((i * 3, text.upper() if rng.random() < 0.1 else text))
    return [*rows, (10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "É é"), (10_005, "é é"), (10_006, "a b")]


@pytest.mark.parametrize("seed,block", [(1, 20_000), (2, 20_000), (3, 3)])
def test_components_match_all_pairs(spark, seed, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    found = jaccard_join.linked_components(docs, family_block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == by_hand(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10_000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.012))) for i in range(1, 400)] + [(0, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = by_hand(rows)
    for block in (20_000, 50):
        found = jaccard_join.linked_components(docs, family_block=block).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_missing_and_repeated_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (7, text), (7, text), (4, text), (7, "another text entirely"), (9, "another text entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.linked_components(docs).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(None, None), (4, 4), (7, 4), (9, 4)}
    assert jaccard_join.linked_components(docs.where("doc_id < 0")).count() == 0


def test_one_of_each_component(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text + " tail", "a"), (1, text, "b"), (8, "different words here", "c"), (None, text, "d"), (5, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `dropped id` string")
    out = jaccard_join.one_of_each_component(docs)
    assert out.columns == docs.columns
    assert sorted(r[2] for r in out.collect()) == ["b", "c", "d", "e"]


def test_sketch_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (3, 40, 700):
        pool = rng.integers(1, 2**63, size + 60, dtype=np.uint64)
        rows, values = [], []
        for row in range(12):
            chosen = np.sort(rng.choice(pool, size, replace=False))
            rows.append(np.full(size, row))
            values.append(chosen)
        bits = jaccard_join.folded(jaccard_join.parity_bits(np.concatenate(rows), np.concatenate(values), np.full(12, size)))
        for a in range(12):
            for b in range(a):
                difference = len(set(values[a].tolist()) ^ set(values[b].tolist()))
                assert int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= difference


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 400)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(found[i] == 100 for i in range(100, 401)) and found[7] == 5
