"""Packing: token ids against the tokenizer, the plan against plain best-fit decreasing, gapless sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cargoledger.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIZE = 64
TEXTS = [
    "", None, "plain words here", " leading", "trailing \n", "two  spaces\n\n\nand lines", "no break   and 　 wide  thin", "a<|endoftext|>b",
    "it's they're 12 345", "émigré ñandú ß", "漢字🎉", "word " * 300, "x" * 5000, " ", "\t\t", "a\x1c b", "",
]


def plain_best_fit(lengths, size):
    """Remaining capacities after best-fit decreasing, item by item."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(size - length)
    return sorted(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 65), rng.randrange(1, 12), 33, 64]) for _ in range(rng.choice([1, 50, 700]))]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    steps = packing.plan_best_fit(histogram, SIZE)
    filled, used = {}, {}
    for length, first, end, sequence, per, offset in steps.tolist():
        used.setdefault(length, []).extend(range(first, end))
        for rank in range(first, end):
            filled.setdefault(sequence + (rank - first) // per, []).append((offset + (rank - first) % per * length, length))
    assert {k: sorted(v) for k, v in used.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= SIZE
    assert sorted(SIZE - sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, SIZE)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    assert tree.tightest(0) is None
    for c in (3, 7, 10):
        tree.put(c, True)
    assert [tree.tightest(n) for n in (0, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.put(10, False)
    assert tree.tightest(8) is None


def test_packed_pieces(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (2, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    found = packing.pack_documents(docs, PATH, SIZE).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, end, piece = 0, (len(ids) - 1) % SIZE + 1, 0
        while start < len(ids):
            want.append((str(i), piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
            start, end, piece = end, end + SIZE, piece + 1
    assert sorted((str(r["doc_id"]), *r[1:5]) for r in found) == sorted(want)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= SIZE
    assert len(sequences) == len(plain_best_fit([r["length"] for r in found], SIZE))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def test_chunks_are_encoded_as_in_whole_texts(spark):
    import pyarrow as pa

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [t or "" for t in TEXTS]
    tokenizer = Tokenizer.from_file(PATH)
    got = [ids.tolist() for _, ids in packing._encode_texts(packing.ChunkCodes(tokenizer), pa.array(texts))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_that_end_in_white_space_beside_empty_lines():
    import pyarrow as pa

    ends = ["\n", "\n\n", " ", " \n", "\r\n", "\t", "\n\n\n\n"]
    texts = [f"a{i}\n\nb{i}\n\n c{i}!{ends[i % len(ends)]}" for i in range(400)] + ends
    tokenizer = Tokenizer.from_file(PATH)
    got = [ids.tolist() for _, ids in packing._encode_texts(packing.ChunkCodes(tokenizer), pa.array(texts))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
