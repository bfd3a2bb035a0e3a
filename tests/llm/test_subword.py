"""Sampled segmentation: exact probabilities against enumeration, lossless decoding, reproducible draws."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cargoledger.llm import subword

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  two  spaces ", "line\nbreak\ttab", "élan Ünder ß ñ", "▁mark ▁▁ and   ideographic", "漢字 and 🎉 emoji \x00 end",
    "x" * 3000, "word " * 500, None, "The and of.\nThe and of.",
]


@pytest.fixture(scope="module")
def pieces():
    return subword.load_pieces(MODEL)


def segmentations(pieces, raw):
    """Every path through the lattice of ``raw`` with its probability, by plain recursion."""
    spelled = {}
    for i in range(len(pieces.begins) - 1):
        piece = pieces.flat[pieces.begins[i] : pieces.begins[i + 1]].tobytes()
        if piece and i not in set(pieces.byte_ids.tolist()):
            spelled[piece] = i
    characters = set()
    text, at = raw.decode(), 0
    for c in text:
        size = len(c.encode())
        if c.encode() not in spelled:
            characters.update(range(at, at + size))
        at += size

    def paths(at):
        if at == len(raw):
            yield (), 0.0
            return
        for end in range(at + 1, len(raw) + 1):
            steps = [spelled[raw[at:end]]] if raw[at:end] in spelled else []
            if end == at + 1 and at in characters:
                steps.append(int(pieces.byte_ids[raw[at]]))
            for i in steps:
                for rest, score in paths(end):
                    yield (i, *rest), score + pieces.scores[i]

    found = {p: math.exp(s) for p, s in paths(0)}
    total = sum(found.values())
    return {p: v / total for p, v in found.items()}


@pytest.mark.parametrize("word", [" the", "ends", " é!", " 漢a"])
def test_draws_follow_the_exact_distribution(pieces, word):
    raw = word.encode()
    wanted = segmentations(pieces, raw)
    n = 20_000
    data, offsets = np.frombuffer(raw * n, np.uint8), np.arange(n + 1) * len(raw)
    ids, bounds = subword.encode_slice(pieces, data, offsets, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(got) <= set(wanted)
    for path, probability in wanted.items():
        deviation = 5 * math.sqrt(n * probability * (1 - probability)) + 1
        assert abs(got[path] - n * probability) <= deviation


def test_decoding_is_lossless_and_repeatable(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id at all"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {(r["doc_id"], r["text"]): r["ids"] for r in subword.encode(docs, MODEL, carried=("doc_id", "text")).collect()}
    again = subword.encode(docs.repartition(5), MODEL, carried=("doc_id", "text"))
    assert {(r["doc_id"], r["text"]): r["ids"] for r in again.collect()} == first
    decoded = subword.decode(again, MODEL, carried=("text",)).toDF("original", "text").collect()
    assert len(decoded) == len(rows)
    assert all(r["original"] == r["text"] for r in decoded)


def test_keys_and_seeds_draw_apart(spark):
    docs = spark.createDataFrame([(i, "ztonerin qheation wherundering") for i in range(200)], "doc_id long, text string")
    drawn = [tuple(r["ids"]) for r in subword.encode(docs, MODEL, theta=0.3).collect()]
    assert len(set(drawn)) > 20
    other = [tuple(r["ids"]) for r in subword.encode(docs, MODEL, seed=1, theta=0.3).collect()]
    assert other != drawn


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert subword.encode(docs, MODEL).count() == 0
