"""Packing of token sequences by best-fit decreasing.

The decision which pieces share a sequence depends on their lengths only, and a length is an
integer between 1 and the sequence size. So the driver reads the histogram of lengths, at most
``size`` rows however many documents there are, and plans on it: a segment tree over remaining
capacities finds the tightest open sequence that takes a piece, and sequences with one remaining
capacity are kept as ranges of numbers and filled together. The plan says for every length which
ranks go where. Ranks are assigned in the cluster from running sums over slices, so neither a common
length nor a hot source is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoledger.llm.common import CODES, WORD_SPACE, run_hashes, shuffle_partitions, slices, text_buffer, written

# White space outside ASCII, and special tokens: rows that hold any are encoded whole.
ODD_TEXT = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
# Bytes without which a text cannot match.
SUSPECT = np.zeros(256, dtype=bool)
SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0x7C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# Distinct chunks that a Python worker remembers at most, and bytes of chunks that are encoded as one text.
REMEMBERED = 1_000_000
JOINED_BYTES = 1 << 14

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: the smallest one at or above a need that has open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = np.zeros(2 * self.leaves, dtype=bool)

    def put(self, capacity: int, is_open: bool) -> None:
        node = self.leaves + capacity
        self.open[node] = is_open
        while node > 1:
            node >>= 1
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        node = self.leaves + need
        if self.open[node]:
            return need
        while node > 1 and not (node % 2 == 0 and self.open[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan_best_fit(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Rows are (length, first rank, end rank, first sequence, pieces per sequence, offset): the piece of
    that length with rank r lies in sequence ``first + (r - first rank) // per`` at
    ``offset + (r - first rank) % per * length``.
    """
    tree = CapacityTree(size)
    ranges: list[deque[tuple[int, int]]] = [deque() for _ in range(size + 1)]
    steps, opened = [], 0

    def put(capacity: int, first: int, end: int) -> None:
        if first < end:
            ranges[capacity].append((first, end))
            tree.put(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = size
                per = size // length
                fresh = -(-(count - rank) // per)
                first, end = opened, opened + fresh
                opened = end
            else:
                first, end = ranges[capacity].popleft()
                if not ranges[capacity]:
                    tree.put(capacity, False)
                per = capacity // length
            whole = min(end - first, (count - rank) // per)
            if whole:
                steps.append((length, rank, rank + whole * per, first, per, size - capacity))
                rank += whole * per
                put(capacity - per * length, first, first + whole)
                first += whole
            if first < end and rank < count:
                rest = count - rank
                steps.append((length, rank, count, first, rest, size - capacity))
                rank = count
                put(capacity - rest * length, first, first + 1)
                first += 1
            put(capacity, first, end)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


class ChunkCodes:
    """Token ids of distinct chunks of text, found by the chunks' hashes."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        # In a byte-level vocabulary every character of a token stands for one byte.
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] != hashes

    def add(self, hashes: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
        """Encode chunks, which follow one another in ``data``, joined to texts of some length.

        Chunks of white space only, which end a row, would join with the white space of the next chunk
        and are encoded by themselves.
        """
        ends = np.cumsum(lengths)
        blank = WORD_SPACE[data[ends - 1]]
        opens = np.diff(ends // JOINED_BYTES, prepend=-1) > 0
        opens |= blank
        opens[1:] |= blank[:-1]
        groups = np.flatnonzero(opens)
        bounds = np.append((ends - lengths)[groups], len(data)).tolist()
        raw = data.tobytes()
        codes = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, dtype=np.uint32) for c in codes]) if codes else np.zeros(0, np.uint32)
        token_ends = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(ends) and not np.array_equal(token_ends[np.minimum(last, len(ids) - 1)], ends):
            raise ValueError("the tokenizer joins a character to the white space after it")
        sizes = np.diff(last + 1, prepend=0)
        begins = len(self.ids) + last + 1 - sizes
        self.ids = np.concatenate((self.ids, ids))
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.begins, self.sizes = np.concatenate((self.begins, begins))[order], np.concatenate((self.sizes, sizes))[order]

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``data[starts:starts + lengths]`` in sequence, and their number per chunk."""
        hashes, at, inverse = np.unique(run_hashes(data, starts, starts + lengths, CODES), return_index=True, return_inverse=True)
        new = self.missing(hashes)
        if len(self.hashes) + new.sum() > REMEMBERED:
            self.clear()
            new[:] = True
        at, size = starts[at[new]], lengths[at[new]]
        self.add(hashes[new], data[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size)
        known = np.searchsorted(self.hashes, hashes)[inverse]
        counts = self.sizes[known]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.begins[known] - ends + counts, counts) + np.arange(int(counts.sum()))], counts


def _encode_texts(codes: ChunkCodes, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, token ids) for every row, each distinct chunk being encoded once.

    A chunk is a run of ASCII white space with the run of other characters after it. The tokenizer's
    pattern never joins a character to white space after it, so chunks may be encoded apart or joined in
    any order, if all begin with white space and hold other characters. A row's first chunk may not begin
    so, its last may be white space only, and rows that hold other white space or a special token are
    encoded whole.
    """
    data, offsets = text_buffer(column)
    for first, last in slices(offsets):
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        whole = np.unique(np.searchsorted(bounds, np.flatnonzero(SUSPECT[part]), side="right") - 1)
        texts = {r: part[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8") for r in whole.tolist()}
        texts = {r: t for r, t in texts.items() if ODD_TEXT.search(t)}
        space = WORD_SPACE[part]
        cut = np.zeros(len(part), bool)
        cut[1:] = space[1:] & ~space[:-1]
        heads = bounds[:-1][bounds[:-1] < len(part)]
        cut[heads] = space[heads]
        starts = np.flatnonzero(cut)
        row = np.searchsorted(bounds, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(part)), bounds[row + 1]) if len(starts) else starts
        ids, counts = codes.encode(part, starts, ends - starts)
        token = np.concatenate(([0], np.cumsum(counts)))
        of_row = token[np.searchsorted(starts, bounds)]
        lead_ends = np.minimum(np.append(starts, len(part))[np.searchsorted(starts, bounds[:-1])], bounds[1:])
        lead = [part[a:b].tobytes().decode("utf-8") for a, b in zip(bounds[:-1].tolist(), lead_ends.tolist(), strict=True)]
        leads = codes.tokenizer.encode_batch_fast(lead, add_special_tokens=False)
        for r in range(last - first):
            if r in texts:
                yield first + r, np.array(codes.tokenizer.encode(texts[r], add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield first + r, np.concatenate((np.array(leads[r].ids, dtype=np.uint32), ids[of_row[r] : of_row[r + 1]]))


def piece_table(
    docs: DataFrame, tokenizer_path: str, size: int, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0
) -> DataFrame:
    """Pieces of the documents: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its whole text and then ``end_id``; a null text is empty and gives that
    one token. Only documents of more than ``size`` tokens are cut; all their pieces but the first
    are full. Null ids stay null.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        codes = ChunkCodes(Tokenizer.from_file(tokenizer_path))
        for batch in batches:
            out: list[tuple] = []
            ids_of = batch.column(0).to_pylist()
            for row, ids in _encode_texts(codes, batch.column(1)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, piece = 0, 0
                end = (len(ids) - 1) % size + 1 if len(ids) > size else len(ids)
                while start < len(ids):
                    out.append((ids_of[row], piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + size, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(encode, PIECES)


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0 in column ``rank`` without gathering a length in one task."""
    slots = max(64, shuffle_partitions(pieces.sparkSession))
    sliced = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    before = W.partitionBy("length").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    base = (
        sliced.groupBy("length", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = W.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")
    return (
        sliced.withColumn("rank", F.row_number().over(within) - 1)
        .join(base, ["length", "slot"])
        .withColumn("rank", (F.col("rank") + F.col("base")).cast("bigint"))
        .drop("slot", "base")
    )


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be a written table."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value
        steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
        # Lengths fit 2**16 and ranks 2**47, so (length, rank) is one sortable number.
        order = (steps[:, 0] << 47) + steps[:, 1]
        for batch in batches:
            length = np.asarray(batch.column("length"), dtype=np.int64)
            rank = np.asarray(batch.column("rank"), dtype=np.int64)
            step = steps[np.searchsorted(order, (length << 47) + rank, side="right") - 1]
            rank = rank - step[:, 1]
            sequence, offset = step[:, 3] + rank // step[:, 4], step[:, 5] + rank % step[:, 4] * length
            columns = [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    if size >= 1 << 16:
        raise ValueError("sequences hold fewer than 65536 tokens")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(pieces).select(*columns, "rank").mapInArrow(place, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, **columns) -> DataFrame:
    """Pack whole documents into sequences of at most ``size`` tokens by best-fit decreasing.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Empty and
    null texts are one end token; repeated rows are packed as often as they occur; an empty table
    gives no rows; other columns are not read. Pieces are encoded once into the shared folder.
    """
    return pack(written(piece_table(docs, tokenizer_path, size, **columns), "pieces"), size)
