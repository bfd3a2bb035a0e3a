"""Alignment of two tokenizations of one text, and the corpus counts of the token pairs it links.

A text is encoded by a byte-level vocabulary (A) and by a piece model with byte fallback (B). Both give the same bytes,
so the ends of their tokens are offsets in one string. A dictionary leads from every cumulative end to the number of
tokens before it; the offsets that both dictionaries hold, a hash-set intersection, are the places where both
tokenizations may be cut. The sorted common offsets slice both id lists into groups, and every
A token of a group is linked to every B token of it.

How many documents hold a pair of ids linked is counted over the whole corpus by request and answer. Documents are
aligned in batches; a batch sends each of its distinct pairs once, with the number of its documents that hold
it, and gets the pair's corpus count back once, however many links it has. What a batch's documents need to add up
their links, places in its sorted list of pairs, is written to the shared folder with the rest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import slices, written
from cargoledger.llm.packing import ChunkCodes, _encode_texts

PIECE_SPACE = "▁"
# Characters of one batch of documents, and of those that B encodes at once; a longer text comes alone.
BATCH_CHARS = 4 << 20
STEP_CHARS = 1 << 18
# Groups of more links are expanded by distinct ids, weighted by how often these occur.
WIDE_LINKS = 1 << 10
# Links that are expanded at once.
STEP_LINKS = 1 << 20
# Distinct pairs in one request row.
REQUEST_PAIRS = 1 << 14


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def group_ends(a_sizes: Sequence[int], b_sizes: Sequence[int]) -> tuple[list[int], list[int]]:
    """Per group, how many A tokens and how many B tokens end with it or before it; sizes are in bytes."""
    a_ends = dict(zip(accumulate(a_sizes), range(1, len(a_sizes) + 1), strict=True))
    b_ends = dict(zip(accumulate(b_sizes), range(1, len(b_sizes) + 1), strict=True))
    common = sorted(a_ends.keys() & b_ends.keys())
    return [a_ends[e] for e in common], [b_ends[e] for e in common]


class Tokenizers:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, byte_tokenizer: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_tokenizer)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.chunks = ChunkCodes(self.a)  # encodes a distinct chunk of text once, with the ids of whole texts
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        symbols, vocabulary = byte_symbols(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(symbols[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(PIECE_SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
        """A ids, B ids and the group ends in both for every text; empty lists where the bytes of either differ from the text's."""
        spaced = [" " + t for t in texts]
        a_lists = (ids.tolist() for _, ids in _encode_texts(self.chunks, pa.array(spaced, pa.string())))
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        b_lists = (ids for x, y in slices(offsets, STEP_CHARS) for ids in self.b.encode(texts[x:y], num_threads=1))
        for text, whole, a, b in zip(texts, spaced, a_lists, b_lists, strict=True):
            a_tokens, b_tokens = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            raw = whole.encode("utf-8")
            if not text or b"".join(a_tokens) != raw or b"".join(b_tokens) != raw:
                yield [], [], [], []
            else:
                yield a, b, *group_ends(list(map(len, a_tokens)), list(map(len, b_tokens)))


@lru_cache(maxsize=1)
def loaded(byte_tokenizer: str, piece_model: str) -> Tokenizers:
    """The tokenizers of two files; a Python worker serves many tasks and loads them once."""
    return Tokenizers(byte_tokenizer, piece_model)


class Batch:
    """The groups of some documents, as arrays over all of them."""

    def __init__(self, encoded: list[tuple], a_size: int, b_size: int):
        self.a_size, self.b_size = a_size, b_size
        self.n_a = np.array([len(a) for a, _, _, _ in encoded], np.int64)
        self.n_b = np.array([len(b) for _, b, _, _ in encoded], np.int64)
        self.n_groups = np.array([len(e) for _, _, e, _ in encoded], np.int64)
        flat = lambda i, kind: np.concatenate([np.asarray(e[i], kind) for e in encoded]) if encoded else np.zeros(0, kind)
        self.a, self.b = flat(0, np.int64), flat(1, np.int64)
        self.doc = np.repeat(np.arange(len(encoded)), self.n_groups)
        self.a_ends = flat(2, np.int64) + (np.cumsum(self.n_a) - self.n_a)[self.doc]
        self.b_ends = flat(3, np.int64) + (np.cumsum(self.n_b) - self.n_b)[self.doc]
        self.a_sizes, self.b_sizes = np.diff(self.a_ends, prepend=0), np.diff(self.b_ends, prepend=0)
        self.links = self.a_sizes * self.b_sizes
        self.n_links = np.zeros(len(encoded), np.int64)
        np.add.at(self.n_links, self.doc, self.links)

    def texts(self) -> Iterator[str]:
        """The groups of each document as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        a_end, b_end = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_end[self.a_ends - 1], b_end[self.b_ends - 1] = True, True
        first_a, first_b = np.concatenate(([0], np.cumsum(self.n_a))), np.concatenate(([0], np.cumsum(self.n_b)))
        first_group = np.concatenate(([0], np.cumsum(self.n_groups)))
        a_words, b_words = decimals(self.a_size, ",", "|"), decimals(self.b_size, ",", ";")
        for row in range(len(self.n_a)):
            groups = slice(first_group[row], first_group[row + 1])
            a, b = slice(first_a[row], first_a[row + 1]), slice(first_b[row], first_b[row + 1])
            a_sizes, b_sizes = self.a_sizes[groups], self.b_sizes[groups]
            # Before an A token stand the B tokens of earlier groups, before a B token the A tokens up to its group.
            a_place = np.arange(a.stop - a.start) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
            b_place = np.arange(b.stop - b.start) + np.repeat(np.cumsum(a_sizes), b_sizes)
            parts = np.empty(len(a_place) + len(b_place), object)
            parts[a_place] = a_words[2 * self.a[a] + a_end[a]]
            parts[b_place] = b_words[2 * self.b[b] + b_end[b]]
            yield "".join(parts.tolist())[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (A id times the size of B's vocabulary plus B id) and number of links, once per document and pair, sorted."""
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        span = self.a_size * self.b_size
        a_first, b_first = self.a_ends - self.a_sizes, self.b_ends - self.b_sizes
        wide = self.links > WIDE_LINKS
        narrow = np.flatnonzero(~wide)
        for x, y in slices(np.concatenate(([0], np.cumsum(self.links[narrow]))), STEP_LINKS):
            group = narrow[x:y]
            n = self.links[group]
            owner = np.repeat(group, n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.divmod(within, self.b_sizes[owner])
            found = self.doc[owner] * span + self.a[a_first[owner] + i] * self.b_size + self.b[b_first[owner] + j]
            found, counts = np.unique(found, return_counts=True)
            keys.append(found)
            weights.append(counts)
        for g in np.flatnonzero(wide).tolist():
            a, a_counts = np.unique(self.a[a_first[g] : self.a_ends[g]], return_counts=True)
            b, b_counts = np.unique(self.b[b_first[g] : self.b_ends[g]], return_counts=True)
            keys.append((self.doc[g] * span + a[:, None] * self.b_size + b).ravel())
            weights.append((a_counts[:, None] * b_counts).ravel())
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        added = np.zeros(len(found), np.int64)
        np.add.at(added, at, np.concatenate(weights))
        return found // span, found % span, added


@lru_cache(maxsize=4)
def decimals(size: int, *separators: str) -> np.ndarray:
    """Numbers below ``size`` as texts, each followed by every separator in turn."""
    return np.array([f"{i}{s}" for i in range(size) for s in separators], object)


ALIGNED = T.StructType(
    [
        T.StructField("batch", T.LongType()),
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups", T.StringType()),
        T.StructField("steps", T.BinaryType()),  # from place to place in the batch's sorted pairs
        T.StructField("links", T.BinaryType()),  # links of each of these pairs in the document
        T.StructField("pairs", T.ArrayType(T.LongType())),  # in request rows only, as is the next
        T.StructField("n_docs", T.ArrayType(T.LongType())),
    ]
)
COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def batch_rows(batch: Batch, number: int, keys: pa.Array, digest: bool) -> Iterator[dict[str, pa.Array]]:
    """One row per document of the batch, then its request rows."""
    doc, pair, links = batch.pairs()
    distinct, place = np.unique(pair, return_inverse=True)
    first = np.searchsorted(doc, np.arange(len(keys) + 1))
    steps = np.diff(place, prepend=0).astype("<i4")
    steps[first[:-1][first[:-1] < first[1:]]] = place[first[:-1][first[:-1] < first[1:]]]
    links = links.astype("<i8")
    texts = batch.texts()
    if digest:
        texts = (hashlib.sha256(t.encode("ascii")).hexdigest() if t else "" for t in texts)
    ranges = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
    yield {
        "batch": pa.array([number] * len(keys), pa.int64()),
        **{name: pa.array(getattr(batch, name)) for name in COUNTED},
        "groups": pa.array(texts, pa.string()),
        "steps": pa.array([steps[x:y].tobytes() for x, y in ranges], pa.binary()),
        "links": pa.array([links[x:y].tobytes() for x, y in ranges], pa.binary()),
        "key": keys,
    }
    n_docs = np.bincount(place, minlength=len(distinct))
    for x in range(0, len(distinct), REQUEST_PAIRS):
        yield {
            "batch": pa.array([number], pa.int64()),
            "pairs": pa.array([distinct[x : x + REQUEST_PAIRS]], pa.list_(pa.int64())),
            "n_docs": pa.array([n_docs[x : x + REQUEST_PAIRS]], pa.list_(pa.int64())),
        }


def align(
    docs: DataFrame,
    byte_tokenizer: str,
    piece_model: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: bool = False,
) -> DataFrame:
    """The id column and ``n_a, n_b, n_groups, n_links, groups, n_best, count_sum`` of every row.

    ``byte_tokenizer`` is a byte-level tokenizer file (A), which gets a space before the text, ``piece_model`` a
    piece model that adds this space itself (B). Special tokens inside texts are plain text.
    ``groups`` lists the groups as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the sha256 of that. ``n_links`` counts pairs of
    token occurrences that share a group. The count of a pair of ids is the number of rows of the whole table that hold
    it linked; ``count_sum`` adds it up over the links, and ``n_best`` counts the links whose count is the
    highest of their A id, ties included.

    Null and empty texts, and texts whose A or B tokens do not give their bytes back (such as texts
    with U+2581), have no tokens: zeros and empty ``groups``. Rows that repeat, or share an id, count as often as
    they occur, a null id stays null, an empty table gives no rows, and other columns are not read. Whole texts
    are aligned; a worker holds a batch of BATCH_CHARS characters or one longer text.
    """
    rows = docs.select(
        F.struct(F.col(id_column)).alias("key"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    schema = T.StructType([*ALIGNED.fields, T.StructField("key", rows.schema["key"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(byte_tokenizer, piece_model)
        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            kinds = pa.schema([*(pa.field(f.name, _arrow(f.dataType)) for f in ALIGNED.fields), rows.schema.field("key").with_nullable(True)])
            texts = rows.column(1)
            sizes = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            for first, last in slices(offsets, BATCH_CHARS):
                found = both.encode(texts.slice(first, last - first).to_pylist())
                # Arrays take a quarter of the memory of lists of numbers.
                encoded = [tuple(np.asarray(part, np.int32) for part in parts) for parts in found]
                batch = Batch(encoded, len(both.a_bytes), len(both.b_bytes))
                for found in batch_rows(batch, number, rows.column(0).slice(first, last - first), digest):
                    n = len(found["batch"])
                    columns = [found[f.name] if f.name in found else pa.nulls(n, f.type) for f in kinds]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)
                number += 1

    aligned = written(rows.mapInArrow(run, schema), "alignment")
    b_size = len(loaded(byte_tokenizer, piece_model).b_bytes)
    asked = aligned.where("pairs is not null").select("batch", F.inline(F.arrays_zip("pairs", "n_docs")))
    counts = asked.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("docs"))
    a_id = F.floor(F.col("pair") / b_size)
    # An A id has at most as many pairs as B has ids.
    best = F.col("docs") == F.max("docs").over(W.partitionBy("a_id"))
    answers = counts.withColumn("a_id", a_id).withColumn("best", best).select("pair", "docs", "best")
    answered = asked.select(F.col("batch").alias("asker"), F.col("pairs").alias("pair")).join(answers, "pair")
    documents = aligned.where("pairs is null").drop("pairs", "n_docs")

    def add_up(documents: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["pair"].to_numpy())
        docs = answers["docs"].to_numpy()[order]
        best = answers["best"].to_numpy(zero_copy_only=False).astype(bool)[order]
        n_best, count_sum = [], []
        for steps, links in zip(documents["steps"].to_pylist(), documents["links"].to_pylist(), strict=True):
            place, links = np.cumsum(np.frombuffer(steps, "<i4"), dtype=np.int64), np.frombuffer(links, "<i8")
            n_best.append(int(links[best[place]].sum()))
            count_sum.append(int((links * docs[place]).sum()))
        kept = documents.select(["key", *COUNTED, "groups"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    kept = documents.select("key", *COUNTED, "groups").schema
    result = T.StructType([*kept.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    summed = documents.groupBy("batch").cogroup(answered.groupBy("asker")).applyInArrow(add_up, result)
    return summed.select("key.*", *COUNTED, "groups", "n_best", "count_sum")


def _arrow(kind: T.DataType) -> pa.DataType:
    known = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    return known[kind]
