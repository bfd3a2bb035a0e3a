"""Cross-tokenizer alignment against a plain walk over bytes and plain counting of linked pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cargoledger.llm import alignment, queries

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
TEXTS = [
    "", None, " ", "a", "The quick brown fox", "The quick brown fox", "  two  spaces\n\n\ttabs ", "naïve café 漢字かな交じり文 🎉🎉 á",
    "<|endoftext|> and </s> <unk> <0x41> stay", "under▁score", "\x00\x01﻿ ", "=" * 300 + "-" * 200, "ab" * 700 + " " * 90 + "\n" * 90,
    "internationalization of antidisestablishmentarianism", "12345678901234567890 3.14159", "\r\n\r\n",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def plain_groups(both, text):
    """Groups of (A ids, B ids), cut wherever both sequences have given the same bytes."""
    a, b = both
    if not text:
        return []
    # The tokenizer's own table of byte characters, read off its pre-tokenizer's decoder.
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table = {chr(i): i for i in plain}
    table.update({chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in plain)})
    a_tokens = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    b_tokens = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    raw = (" " + text).encode()
    if b"".join(t for _, t in a_tokens) != raw or b"".join(t for _, t in b_tokens) != raw:
        return []
    groups, left, right, x, y = [], [], [], 0, 0
    while a_tokens or b_tokens:
        if x <= y and a_tokens:
            i, t = a_tokens.pop(0)
            left.append(i)
            x += len(t)
        else:
            i, t = b_tokens.pop(0)
            right.append(i)
            y += len(t)
        if x == y and left and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def brute_force(both, rows):
    grouped = [(i, plain_groups(both, t)) for i, t in rows]
    links = [[(a, b) for left, right in g for a in left for b in right] for _, g in grouped]
    counts = Counter(pair for found in links for pair in set(found))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, groups), found in zip(grouped, links, strict=True):
        text = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in groups)
        out.append((
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(found),
            sum(counts[p] == best[p[0]] for p in found), sum(counts[p] for p in found), text,
        ))
    return sorted(out, key=str)


def got(found):
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("limits", [None, (60, 25, 2, 7, 3)])
def test_groups_links_and_counts(spark, both, monkeypatch, limits):
    rng = random.Random(2)
    words = "the of tokenization naïve 漢字 12 3.5 don't  \n == antidote 🎉 x".split(" ")
    rows = [*enumerate(TEXTS), (None, "The quick fox"), (4, TEXTS[4])]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)]
    data = [(i, t, "x", 1, 2) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, groups string, batch int, key int").repartition(3)
    if limits is None:
        assert got(alignment.align(docs, BYTE, PIECE)) == brute_force(both, rows)
        return
    for name, value in zip(("BATCH_CHARS", "STEP_CHARS", "WIDE_LINKS", "STEP_LINKS", "REQUEST_PAIRS"), limits, strict=True):
        monkeypatch.setattr(alignment, name, value)
    # In this process, so that the small limits hold: batches of all rows against plain groups and links.
    tokenizers = alignment.Tokenizers(BYTE, PIECE)
    encoded = [tokenizers.encode([t or ""]).__next__() for _, t in rows]
    batch = alignment.Batch(encoded, len(tokenizers.a_bytes), len(tokenizers.b_bytes))
    plain = [plain_groups(both, t) for _, t in rows]
    doc, pair, links = batch.pairs()
    counted = Counter((d, a * len(tokenizers.b_bytes) + b) for d, g in enumerate(plain) for left, right in g for a in left for b in right)
    assert dict(zip(zip(doc.tolist(), pair.tolist(), strict=True), links.tolist(), strict=True)) == counted
    assert batch.n_links.tolist() == [sum(len(left) * len(right) for left, right in g) for g in plain]


def test_wide_group():
    """A group without a common end inside is expanded by distinct ids."""
    a, b = [1, 2] * 4000, [0, 1, 2] * 3000
    batch = alignment.Batch([(a, b, [len(a)], [len(b)]), ([], [], [], []), ([1], [2], [1], [1])], 3, 4)
    doc, pair, links = batch.pairs()
    assert doc.tolist() == [0] * 6 + [2] and pair.tolist() == [4, 5, 6, 8, 9, 10, 6]
    assert links.tolist() == [4000 * 3000] * 6 + [1] and batch.n_links.tolist() == [len(a) * len(b), 0, 1]


def test_group_ends():
    assert alignment.group_ends([1, 2, 3], [3, 1, 2]) == ([2, 3], [1, 3])
    assert alignment.group_ends([], []) == ([], [])
    rng = np.random.default_rng(1)
    for _ in range(50):
        cut = lambda: np.diff([0, *sorted({*rng.integers(1, 40, 9).tolist(), 40})]).tolist()
        a, b = cut(), cut()
        ends = sorted(set(np.cumsum(a).tolist()) & set(np.cumsum(b).tolist()))
        assert [sum(a[:i]) for i in alignment.group_ends(a, b)[0]] == ends == [sum(b[:i]) for i in alignment.group_ends(a, b)[1]]


def test_empty_tables_and_a_long_text(spark, both):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert alignment.align(docs([]), BYTE, PIECE).count() == 0
    assert got(alignment.align(docs([(1, None), (2, "")]), BYTE, PIECE)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    rows = [(1, "many words of one text, and again. " * 3000), (2, "many words")]
    assert got(alignment.align(docs(rows), BYTE, PIECE)) == brute_force(both, rows)


def test_query_over_the_table(spark, both):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_force(both, rows)]
    found = queries.op12_token_alignment(spark, sf_dir).withColumnRenamed("groups_sha256", "groups")
    assert got(found) == sorted(want, key=str)
