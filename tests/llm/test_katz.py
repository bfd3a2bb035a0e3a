"""Katz scores against a plain implementation, and exact normalisation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cargoledger.llm import katz
from cargoledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w] + ["</s>"]


def discounts(counts):
    n = [0, *(sum(c == r for c in counts.values()) for r in range(1, 7))]
    absolute = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.9) if n[1] else 0.5
    tail = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and n[r + 1] and tail < 1 else 0
        out[r] = d if 0 < d < 1 else 1 - absolute / r
    return lambda c: out.get(c, 1.0)


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.histories = Counter(), Counter(), Counter()
        for t in texts:
            before = "<s>"
            for w in tokens(t):
                self.words[w] += 1
                self.pairs[before, w] += 1
                self.histories[before] += 1
                before = w
        self.total = sum(self.words.values())
        self.d1, self.d2 = discounts(self.words), discounts(self.pairs)
        kept = sum(self.d1(c) * c for c in self.words.values())
        self.full = self.total - kept < 1e-9
        self.followers = {}
        for (h, w), c in self.pairs.items():
            self.followers.setdefault(h, {})[w] = c

    def unigram(self, w):
        if not self.total:
            return 1.0
        n = self.total + 1 if self.full else self.total
        if w in self.words:
            return self.d1(self.words[w]) * self.words[w] / n
        return 1 / n if self.full else 1 - sum(self.d1(c) * c for c in self.words.values()) / n

    def probability(self, h, w):
        seen = self.followers.get(h)
        if not seen:
            return self.unigram(w)
        kept = sum(self.d2(c) * c for c in seen.values())
        n = self.histories[h]
        if n - kept < 1e-9 * n:
            n += 1
        if w in seen:
            return self.d2(seen[w]) * seen[w] / n
        return (1 - kept / n) / (1 - sum(self.unigram(x) for x in seen)) * self.unigram(w)

    def score(self, text):
        out, before = 0.0, "<s>"
        for w in tokens(text):
            out += math.log10(self.probability(before, w))
            before = w
        return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    found = {(r["doc_id"], r["text"]): r for r in katz.scores(docs, **options).join(docs.select("doc_id", "text"), "doc_id").collect()}
    return compare(rows, found)


def compare(rows, found):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    plain = Plain([t for i, t in rows if not held[i]])
    for i, t in rows:
        r, ts = found[i, t], tokens(t)
        assert r["held_out"] == held[i] and r["n_tokens"] == len(ts) and r["train_tokens"] == plain.total
        assert r["n_known"] == sum(w in plain.words for w in ts)
        base = sum(math.log10((plain.words[w] + 1) / (plain.total + len(plain.words) + 1)) for w in ts)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(plain.score(t), rel=1e-6)
    return plain


def sample(n=120):
    rng = np.random.default_rng(4)
    vocabulary = [f"W{int(x)}" for x in rng.zipf(1.4, 3000) % 300]
    return [(i, " \n".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(n)] + [(900, None), (901, ""), (902, "x" * 50_000)]


def test_scores_match_plain_code(spark):
    check(spark, sample())


def test_histories_in_slots(spark, monkeypatch):
    monkeypatch.setattr(katz, "SLOT_COUNT", 20)
    check(spark, sample(), batches=5)


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in sample()])
    for h in ["<s>", "w1", "w2", *list(plain.words)[:20], "never seen"]:
        assert sum(plain.probability(h, w) for w in plain.words) + plain.probability(h, "unknown") == pytest.approx(1, abs=1e-9)


def test_registered_query_matches_plain_code(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = dict(rows)
    found = {(r["doc_id"], texts[r["doc_id"]]): r for r in QUERIES["op5_katz_scores"](spark, SMALL).collect()}
    assert len(found) == len(rows)
    compare(rows, found)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string")
    rows = katz.scores(docs).collect()
    assert len(rows) == 3 and all(r["held_out"] for r in rows if r["doc_id"] is None)
    alone = katz.scores(docs.where("doc_id is null")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in alone)
    assert katz.scores(docs.where("doc_id > 5")).count() == 0
