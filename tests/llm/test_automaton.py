"""Tokenization automaton: ids and decoded texts against the tokenizer, transitions against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargoledger.llm import automaton

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "hello world", " Leading and trailing ", "a<|endoftext|>b <|startoftext|>", "<|endoftext|><|endoftext|>", "It's THEY'RE 12345",
    "ΟΔΟΣ İstanbul ǅ", "é ́a\x1cb\x85c d　e", "漢字かな混じり文 🎉🎉", "x" * 5000, "hello world", "\x00\x01", "<|endoftext", "\n\n\t",
]


@pytest.fixture(scope="module")
def table():
    return automaton.load(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def encoded(table, texts):
    encoder, out = automaton.ChunkEncoder(table, PATH), []
    for _, _, ids, bounds in automaton.encode_column(encoder, pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def wanted(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def plain_merges(merges, symbols):
    """Merges in order, each from left to right."""
    for left, right in merges:
        out = []
        for s in symbols:
            if out and out[-1] == left and s == right:
                out[-1] = left + right
            else:
                out.append(s)
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(8))
def test_gadgets_equal_plain_merging(seed):
    rng = random.Random(seed)
    alphabet = automaton.byte_alphabet()
    vocabulary = {c + s: i for i, (c, s) in enumerate([(c, "") for c in alphabet] + [(c, "</w>") for c in alphabet])}
    tokens, merges = ["a", "b", "c", "a</w>", "b</w>"], []
    while len(merges) < 25:
        left, right = rng.choice(tokens), rng.choice(tokens)
        if left.endswith("</w>") or left + right in vocabulary or plain_merges(merges, plain_symbols(left + right)) != [left, right]:
            continue
        merges.append((left, right))
        vocabulary[left + right] = len(vocabulary)
        tokens.append(left + right)
    table = automaton.compile_merges(vocabulary, merges, "</w>")
    names = {i: t for t, i in vocabulary.items()}
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) + rng.choice("ab")
        symbols = np.array([vocabulary[c] for c in word], dtype=np.int16)
        symbols[-1] += automaton.END
        ids, _ = automaton.encode_words(table, symbols, np.array([len(word)]))
        assert [names[i] for i in ids.tolist()] == plain_merges(merges, [*word[:-1], word[-1] + "</w>"])


def plain_symbols(text):
    ended = text.endswith("</w>")
    letters = list(text.removesuffix("</w>"))
    return [*letters[:-1], letters[-1] + "</w>"] if ended else letters


def test_merges_out_of_order_are_refused():
    vocabulary = {c + s: i for i, (c, s) in enumerate([(c, "") for c in automaton.byte_alphabet()] + [(c, "</w>") for c in automaton.byte_alphabet()])}
    vocabulary |= {"ab": 600, "abc": 601, "bc": 602}
    with pytest.raises(ValueError):
        automaton.compile_merges(vocabulary, [("ab", "c"), ("a", "b")], "</w>")
    with pytest.raises(ValueError):
        automaton.compile_merges(vocabulary, [("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")], "</w>")


def test_ids_equal_the_tokenizer(table, tokenizer):
    rng = random.Random(5)
    pools = ["abcdefghij '’ABC.,!?0123\n\t", "éÉèßÀΣσςİıǅﬁ ́̂ ab", "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(400)) + "  "]
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(60))) for p in pools for _ in range(1500)]
    assert encoded(table, TEXTS + texts) == wanted(tokenizer, TEXTS + texts)


def test_long_words_equal_the_tokenizer(table, tokenizer):
    rng = random.Random(6)
    texts = ["".join(rng.choice(p) for _ in range(n)) for p, n in (("ab", 5000), ("etaoin", 30_000), ("漢字文章書", 20_000), ("a", 9001), ("!?", 3000))]
    texts += ["abc" * 3000, "aaab" * 2000 + " " + "the" * 1000]
    assert encoded(table, texts) == wanted(tokenizer, texts)


def test_long_texts_are_encoded_in_parts(table, tokenizer, monkeypatch):
    text = " ".join(f"Word{i % 37}, l'été\n" for i in range(4000))
    whole = wanted(tokenizer, [text])
    monkeypatch.setattr(automaton, "STEP_BYTES", 512)
    parts = list(automaton.parts_of(np.frombuffer(text.encode(), np.uint8), 512))
    assert len(parts) > 50 and b"".join(p.tobytes() for p in parts).decode() == text
    assert encoded(table, [text]) == whole
    monkeypatch.setattr(automaton, "REMEMBERED", 20)
    assert encoded(table, [text, "again", text]) == wanted(tokenizer, [text, "again", text])


def test_round_trip_of_a_table(spark, tokenizer):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (2, TEXTS[2], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    found = automaton.encode(docs, PATH, digests=True)
    back = automaton.decode(found, PATH, carried=("doc_id", "n_tokens", "ids_sha256")).collect()
    want = []
    for doc_id, text, _, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in back)


def test_null_ids_and_empty_tables(spark):
    assert automaton.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in automaton.decode(rows, PATH).collect()} == {1: None, 2: "", 3: "a</w>"}
