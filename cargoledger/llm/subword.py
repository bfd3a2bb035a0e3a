"""Sampled subword segmentation: forward filtering and backward sampling over the piece lattice.

The pieces come from a public SentencePiece model; nothing is trained. A text is a lattice whose nodes
are byte positions and whose edges are pieces (a space in the text is the model's word mark) or, at
characters that have no piece, single bytes. Forward filtering sums the probability of all ways to
reach a node; backward sampling then walks from the end, drawing each last piece with its exact
conditional probability, so whole segmentations are drawn in proportion to their probability. The
draws are functions of the seed, the row key and the place in the text: runs repeat exactly however
rows are batched, and rows with other keys draw independently.

No piece has a space after another character, so the lattice falls apart before every run of spaces.
The forward pass runs once per distinct chunk of a slice, for all chunks at once; the backward pass
runs over all occurrences at once. Decoding joins the pieces' bytes, and gives the text back exactly.

The model ranks its pieces and has no probabilities; a piece of rank r gets one in proportion to
``(r + 1) ** -exponent``, to the power ``theta``. Lower values of theta give more varied segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import CODES, mix, run_hashes, slices, text_buffer

CHUNK_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD1342543DE82EF95)


@dataclass
class Pieces:
    """A vocabulary as byte strings. Prefixes of each length are sorted hashes with the id of the piece that ends there, or -1."""

    flat: np.ndarray  # the bytes of all pieces in sequence
    begins: np.ndarray  # where each piece's bytes begin, by id, with the end
    prefixes: list[tuple[np.ndarray, np.ndarray]]
    byte_ids: np.ndarray  # ids of the 256 byte pieces
    scores: np.ndarray  # log probability by id


def _extend(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (hashes + codes) * _STEP ^ (hashes >> np.uint64(31))


def load_pieces(model_path: str, exponent: float = 1.0, theta: float = 1.0) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    raw, byte_ids, by_length = [b""] * size, np.zeros(256, np.int64), {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw[i] = piece.replace("▁", " ").encode()
            for length in range(1, len(raw[i]) + 1):
                found = by_length.setdefault(length, {})
                found.setdefault(raw[i][:length], -1)
            by_length[len(raw[i])][raw[i]] = i
    prefixes = []
    for length in range(1, max(by_length) + 1):
        strings = list(by_length[length])
        grid = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, length)
        hashes = np.zeros(len(strings), np.uint64)
        for k in range(length):
            hashes = _extend(hashes, CODES[grid[:, k]])
        order = np.argsort(hashes)
        prefixes.append((hashes[order], np.array(list(by_length[length].values()))[order]))
    scores = -exponent * np.log(np.arange(size) + 1.0)
    scores = theta * (scores - np.log(np.exp(scores).sum()))
    lengths = np.array([len(r) for r in raw])
    return Pieces(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(lengths))), prefixes, byte_ids, scores)


def lattice_edges(pieces: Pieces, data: np.ndarray, chunk_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, end, id) over positions of ``data``; ``chunk_ends`` has the end of the chunk of every position."""
    characters = np.flatnonzero((data & 0xC0) != 0x80)
    widths = np.diff(np.append(characters, len(data)))
    starts, ends, ids = [], [], []
    at, hashes, covered = characters, np.zeros(len(characters), np.uint64), np.zeros(len(data) + 1, bool)
    width_at = np.zeros(len(data), np.int64)
    width_at[characters] = widths
    for length, (known, piece_ids) in enumerate(pieces.prefixes, start=1):
        fits = at + length <= chunk_ends[at]
        at, hashes = at[fits], hashes[fits]
        if not len(at):
            break
        hashes = _extend(hashes, CODES[data[at + length - 1]])
        found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        fits = known[found] == hashes
        at, hashes, found = at[fits], hashes[fits], found[fits]
        whole = piece_ids[found]
        hit = whole >= 0
        starts.append(at[hit])
        ends.append(at[hit] + length)
        ids.append(whole[hit])
        covered[at[hit][width_at[at[hit]] == length]] = True
    lone = np.repeat(~covered[characters], widths)
    single = np.flatnonzero(lone)
    starts.append(single)
    ends.append(single + 1)
    ids.append(pieces.byte_ids[data[single]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


def forward(pieces: Pieces, data: np.ndarray, chunk_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward filtering of all chunks, which follow one another in ``data``.

    Gives per node (a position p > chunk start is node p - 1) its number in the order of evaluation, and
    per edge, sorted by that number, its start, id and ``number + cumulated conditional probability``.
    """
    n = len(data)
    lengths = np.diff(np.append(chunk_starts, n))
    begin = np.repeat(chunk_starts, lengths)
    start, end, ids = lattice_edges(pieces, data, begin + np.repeat(lengths, lengths))
    depth = end - begin[end - 1]
    order = np.lexsort((end, depth))
    start, end, ids, depth = start[order], end[order], ids[order], depth[order]
    fresh = np.ones(len(end), bool)
    fresh[1:] = end[1:] != end[:-1]
    first = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    sizes = np.diff(np.append(first, len(end)))
    score = pieces.scores[ids]
    reach = np.zeros(n + 1)  # log of the summed probability of all paths from the chunk's start, at its end positions
    at_start = start == begin[np.minimum(start, n - 1)]
    value = np.empty(len(end))
    node_depth = depth[first]
    bounds = np.searchsorted(node_depth, np.arange(1, int(node_depth.max(initial=0)) + 2))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            continue
        lo, hi = first[a], first[b] if b < len(first) else len(end)
        part = score[lo:hi] + np.where(at_start[lo:hi], 0.0, reach[start[lo:hi]])
        top = np.maximum.reduceat(part, first[a:b] - lo)
        total = top + np.log(np.add.reduceat(np.exp(part - np.repeat(top, sizes[a:b])), first[a:b] - lo))
        reach[end[first[a:b]]] = total
        value[lo:hi] = part - np.repeat(total, sizes[a:b])
    summed = np.cumsum(np.exp(value))
    before = np.concatenate(([0.0], summed))[first]
    share = np.minimum((summed - np.repeat(before, sizes)), 1.0)
    share[np.append(first[1:], len(end)) - 1] = 1.0
    node = np.full(n, -1, np.int64)
    node[end[first] - 1] = np.arange(len(first))
    return node, start, ids, number + share, first


def sample(
    model: tuple[np.ndarray, ...], chunk_starts: np.ndarray, chunk_ends: np.ndarray, chunk: np.ndarray, keys: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of occurrence i of chunk ``chunk[i]`` with random key ``keys[i]``: ids in order, ids per occurrence."""
    node, start, ids, cumulated, first = model
    # Occurrences of a chunk are walked side by side, so that their nodes stay in the processor's cache.
    active = np.argsort(chunk, kind="stable")
    position = chunk_ends[chunk[active]]
    stop = chunk_starts[chunk]
    steps, counts = [], np.zeros(len(chunk), np.int64)
    last = np.append(first[1:], len(ids)) - 1
    step = 0
    while len(active):
        number = node[position - 1]
        draw = (mix(keys[active] + np.uint64((step + 1) * int(_STEP) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        edge = np.clip(np.searchsorted(cumulated, number + draw, side="right"), first[number], last[number])
        steps.append((active, ids[edge]))
        counts[active] += 1
        position = start[edge]
        going = position > stop[active]
        active, position = active[going], position[going]
        step += 1
    ends = np.cumsum(counts)
    out = np.zeros(int(counts.sum()), np.int32)
    for step, (who, drawn) in enumerate(steps):
        out[ends[who] - 1 - step] = drawn
    return out, counts


def encode_slice(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled ids of all rows in sequence, and the offsets of the rows."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    space = data == 0x20
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    _, at, chunk = np.unique(run_hashes(data, starts, ends, CODES), return_index=True, return_inverse=True)
    lengths = (ends - starts)[at]
    chunk_ends = np.cumsum(lengths)
    chunk_starts = chunk_ends - lengths
    distinct = data[np.repeat(starts[at] - chunk_starts, lengths) + np.arange(int(lengths.sum()))]
    row = np.searchsorted(offsets, starts, side="right") - 1
    place = (starts - offsets[row]).astype(np.uint64)
    ids, counts = sample(forward(pieces, distinct, chunk_starts), chunk_starts, chunk_ends, chunk, mix(keys[row] + place * _PLACE))
    token = np.concatenate(([0], np.cumsum(counts)))
    return ids, token[np.searchsorted(starts, offsets)]


def encode(
    docs: DataFrame,
    model_path: str,
    seed: int = 0,
    key_column: str = "doc_id",
    text_column: str = "text",
    carried: tuple[str, ...] = ("doc_id",),
    theta: float = 1.0,
) -> DataFrame:
    """``carried`` columns and ``ids``: a sampled segmentation of the whole text of every row.

    A null text stays null, an empty one has no ids. Rows with equal keys (null being a key too) and
    equal texts get equal segmentations. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in carried]).alias("carried"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(key_column).cast("string"), F.lit("null"))).alias("key"),
        F.col(text_column).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path, theta=theta)
        for batch in batches:
            text = batch.column("text")
            data, offsets = text_buffer(text)
            keys = np.asarray(batch.column("key"), dtype=np.int64).view(np.uint64)
            for i, j in slices(offsets, CHUNK_BYTES):
                ids, bounds = encode_slice(pieces, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=text.slice(i, j - i).is_null())
                yield pa.RecordBatch.from_arrays([batch.column("carried").slice(i, j - i), lists], names=["carried", "ids"])

    schema = T.StructType([rows.schema["carried"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).select("carried.*", "ids")


def decode(encoded: DataFrame, model_path: str, ids_column: str = "ids", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and ``text``: the bytes of the pieces joined. Null ids give null text."""
    rows = encoded.select(F.struct(*[F.col(c) for c in carried]).alias("carried"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_path)
        lengths = np.diff(pieces.begins)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets, dtype=np.int64)
            ids = np.asarray(lists.values, dtype=np.int64)
            texts = []
            for k, missing in enumerate(lists.is_null().to_pylist()):
                own = ids[bounds[k] : bounds[k + 1]]
                size = lengths[own]
                ends = np.cumsum(size)
                at = np.repeat(pieces.begins[own] - ends + size, size) + np.arange(int(size.sum()))
                texts.append(None if missing else pieces.flat[at].tobytes().decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(texts, pa.string())], names=["carried", "text"])

    schema = T.StructType([rows.schema["carried"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select("carried.*", "text")
