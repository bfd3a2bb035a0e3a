"""Removal of byte strings of ``width`` bytes or more that occur twice, by sorted suffixes.

Equal strings must meet in one task without the text being shipped once per byte. Every window of
``width`` bytes is owned by its anchor, the position in it whose next ``GRAM`` bytes hash lowest;
equal windows have equal anchors at the same place in them. Runs of windows with one anchor form a
context: the windows' starts and ``width - 1`` bytes after them. Three steps follow:

1. Anchor hashes, packed per batch and hash bucket, are counted. Windows of an anchor whose hash
   occurs once are unique, and most text ends here. A hash that occurs again within one slice of a batch
   needs no counting: one place of it goes to its bucket, for other slices to see, and the rest is dealt
   out over all tasks.
2. The contexts of the other anchors are cut out of the documents and dealt out by anchor hash, without
   their places: identical contexts of a batch are one row with their number. A task builds the suffix
   array of its distinct contexts by two-stage sorting, compares adjacent suffixes, and marks every
   window that has an equal one elsewhere.
3. The marks of a context are joined to its places by its digest and a slot, of which the places of one
   context have up to ``SLOTS``, and come back to the documents, where covered bytes are removed.

Two-stage sorting sorts directly only the suffixes that are smaller than their successors; a scan over
the buckets of first bytes, in ascending order, then induces all others from the suffix that follows
them. Suffixes are compared over ``width`` bytes, which is all that the marks need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import CODES, mix, shuffle_partitions, slices, text_buffer

GRAM = 24
# Bytes of contexts whose suffixes one sort takes.
SORT_BYTES = 1 << 20
# Bytes of text that are hashed at once.
GRAM_BYTES = 1 << 19
# The places of one context are dealt to so many slots by their document.
SLOTS = 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each position on, by doubling; positions near the end are left out."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    power = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(GRAM)]
    joined = lambda left, right, k: left[: len(right)] * power[k] + right
    one = CODES[data]
    two = joined(one, one[1:], 1)
    four = joined(two, two[2:], 2)
    eight = joined(four, four[4:], 4)
    sixteen = joined(eight, eight[8:], 8)
    return mix(joined(sixteen, eight[16:], 8))


def sliding_argmin(values: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest value in every run of ``window`` values, the first of equal ones.

    Values are compared by their upper 32 bits and then by position. One running minimum forward and
    one backward per block of ``window`` values answer all runs.
    """
    n = len(values) - window + 1
    blocks = -(-len(values) // window)
    packed = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    packed[: len(values)] = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    grid = packed.reshape(blocks, window)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(backward[:n], forward[window - 1 : window - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: row, first window start and last, in the row, and the anchor's hash."""
    rows, firsts, lasts, hashes = [], [], [], []
    for a, b in slices(offsets, GRAM_BYTES):
        grams = gram_hashes(data[offsets[a] : offsets[b]])
        for row in (a + np.flatnonzero(np.diff(offsets[a : b + 1]) >= width)).tolist():
            begin, end = int(offsets[row] - offsets[a]), int(offsets[row + 1] - offsets[a])
            own = grams[begin : end - GRAM + 1]
            anchor = sliding_argmin(own, width - GRAM + 1)
            cut = np.flatnonzero(np.diff(anchor)) + 1
            first = np.concatenate(([0], cut))
            rows.append(np.full(len(first), row, np.int64))
            firsts.append(first)
            lasts.append(np.concatenate((cut - 1, [len(anchor) - 1])))
            hashes.append(own[anchor[first]])
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number; bytes past the end count as zero."""
    out = np.zeros(len(text), np.uint64)
    padded = np.concatenate((text, np.zeros(7, np.uint8)))
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _direct_sort(eights: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """``suffixes`` in the order of their first ``depth`` bytes, eight bytes a round.

    Suffixes that are equal so far form a group; only groups of more than one go on, and only those in
    which the next bytes differ are sorted.
    """
    out = suffixes[np.argsort(eights[suffixes], kind="stable")]
    slots, groups = np.arange(len(out)), np.zeros(len(out), np.int64)
    for done in range(0, depth, 8):
        word = eights[out[slots] + done]
        joined = groups[1:] == groups[:-1]
        if done:
            mixed = np.zeros(int(groups[-1]) + 1, bool)
            mixed[groups[1:][joined & (word[1:] != word[:-1])]] = True
            at = np.flatnonzero(mixed[groups])
            order = np.lexsort((word[at], groups[at]))
            out[slots[at]] = out[slots[at[order]]]
            word[at] = word[at[order]]
        tie = joined & (word[1:] == word[:-1])
        fresh = np.append(True, ~tie)
        tied = ~fresh
        tied[:-1] |= tie
        slots, groups = slots[tied], (np.cumsum(fresh) - 1)[tied]
        if not len(slots):
            break
    return out


def suffix_order(text: np.ndarray, eights: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The order of the suffixes at 0..n-1, compared over ``depth`` bytes; ``text`` has ``depth + 8`` more bytes."""
    if n == 0:
        return np.zeros(0, np.int64)
    first, following = text[:n], text[1 : n + 1]
    # A suffix is smaller than its successor if its first byte is, or if they are equal and the successor is.
    differs = first != following
    next_change = np.where(differs, np.arange(n), n)
    next_change = np.minimum.accumulate(next_change[::-1])[::-1]
    at = np.minimum(next_change, n - 1)
    smaller = np.where(next_change < n, text[at] < text[at + 1], True)
    direct = np.flatnonzero(smaller)
    direct = _direct_sort(eights, direct, depth) if len(direct) else direct
    direct_byte = text[direct]
    bounds = np.searchsorted(direct_byte, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not smaller[n - 1]:  # it follows from the empty suffix, the smallest of all
        pending[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        induced = []
        level = np.concatenate(pending[byte]) if pending[byte] else np.zeros(0, np.int64)
        while len(level):
            induced.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == byte) & ~smaller[before]]
        bucket = np.concatenate([*induced, direct[bounds[byte] : bounds[byte + 1]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > byte)]
        heads = text[before]
        split = np.argsort(heads, kind="stable")
        before, heads = before[split], heads[split]
        present, begins = np.unique(heads, return_index=True)
        for head, part in zip(present.tolist(), np.split(before, begins[1:]), strict=False):
            pending[head].append(part)
    return np.concatenate(order)


def adjacent_equal(eights: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix but the first in ``order``, whether it shares ``depth`` bytes with the one before."""
    same = np.ones(max(len(order) - 1, 0), bool)
    left = np.flatnonzero(same)
    for done in range(0, depth, 8):
        unread = np.uint64(8 * max(0, done + 8 - depth))
        equal = eights[order[left] + done] >> unread == eights[order[left + 1] + done] >> unread
        same[left[~equal]] = False
        left = left[equal]
    return same


def repeated_windows(pieces: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """Per piece and window of ``width`` bytes, whether it occurs again; piece i stands for ``counts[i]`` places."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces) + bytes(width + 8), np.uint8)
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    starts = ends - lengths
    eights = eight_bytes(text)
    order = suffix_order(text, eights, n, width)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    whole = (ends[piece] - np.arange(n)) >= width
    order = order[whole[order]]
    same = adjacent_equal(eights, order, width)
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again |= whole & (np.array(counts)[piece] > 1)
    return [again[s : max(s, e - width + 1)] for s, e in zip(starts, ends, strict=True)]


def _spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(17)) % np.uint64(n)


def _repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every hash, whether it occurs again, and whether it occurred before."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again | later, later


def _spread(ids: pa.Array, tags: np.ndarray) -> np.ndarray:
    """A hash per document, from its id and text, so that a task that runs again deals alike."""
    return mix(np.asarray(ids.fill_null(-1), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tags.view(np.uint64))


def anchor_counts(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """Contexts whose anchor hash occurs again: ``doc_id, text_hash, first, last, hash``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids, tags = batch.column("doc_id"), np.asarray(batch.column("text_hash"), dtype=np.int64)
            spread = _spread(ids, tags)
            for i, j in slices(offsets):
                row, first, last, hashes = contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                bucket = _buckets(hashes, buckets)
                known, later = _repeats(hashes)
                bucket[later] = np.uint64(buckets) + (bucket[later] + spread[row[later] + i]) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                row, first, last, hashes, bucket, known = row[order], first[order], last[order], hashes[order], bucket[order], known[order]
                present, begins = np.unique(bucket, return_index=True)
                edges = [*begins.tolist(), len(bucket)]
                blobs = [[], [], [], [], [], []]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    held, local = np.unique(row[a:b], return_inverse=True)
                    packed = np.zeros(b - a, dtype=ENTRY)
                    packed["hash"], packed["row"], packed["first"], packed["run"] = hashes[a:b], local, first[a:b], last[a:b] - first[a:b]
                    packed["known"] = known[a:b]
                    blobs[0].append(ids.take(pa.array(held + i)).to_pylist())
                    blobs[1].append(tags[held + i].tolist())
                    blobs[2].append(packed.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present.astype(np.int32)), pa.array(blobs[0], pa.list_(pa.int64())), pa.array(blobs[1], pa.list_(pa.int64())), pa.array(blobs[2], pa.binary())],
                    names=["bucket", "ids", "tags", "entries"],
                )

    def hits(entry: np.ndarray, owner: np.ndarray, ids: list, tags: list) -> pa.RecordBatch:
        first = entry["first"].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()).take(pa.array(owner)),
                pa.array(tags, pa.int64()).take(pa.array(owner)),
                pa.array(first),
                pa.array(first + entry["run"]),
                pa.array(entry["hash"].view(np.int64)),
            ],
            names=["doc_id", "text_hash", "first", "last", "hash"],
        )

    def find(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, parts, ids, tags = [], [], [], []
        base = 0
        for batch in batches:
            for held, tag, blob in zip(batch.column("ids").to_pylist(), batch.column("tags").to_pylist(), batch.column("entries"), strict=True):
                entry = np.frombuffer(blob.as_py(), ENTRY)
                if key[0].as_py() >= buckets:
                    yield hits(entry, entry["row"].astype(np.int64), held, tag)
                    continue
                parts.append(entry)
                owners.append(entry["row"].astype(np.int64) + base)
                ids += held
                tags += tag
                base += len(held)
        if not parts:
            return
        entry, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(entry["hash"], kind="stable")
        hashes = entry["hash"][order]
        same = hashes[1:] == hashes[:-1]
        again = entry["known"][order] > 0
        again[1:] |= same
        again[:-1] |= same
        hit = order[again]
        yield hits(entry[hit], owner[hit], ids, tags)

    packed = rows.mapInArrow(pack, "bucket int, ids array<bigint>, tags array<bigint>, entries binary")
    return packed.groupBy("bucket").applyInArrow(find, "doc_id bigint, text_hash bigint, first bigint, last bigint, hash bigint")


ENTRY = np.dtype([("hash", "<u8"), ("row", "<u4"), ("first", "<u4"), ("run", "<u2"), ("known", "u1")])


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def context_marks(cut: DataFrame, width: int, buckets: int) -> DataFrame:
    """Covered byte spans per document: ``doc_id, text_hash, begin, end``; ``cut`` has each document's contexts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            tags = np.asarray(batch.column("text_hash"), dtype=np.int64)
            slots = _spread(batch.column("doc_id"), tags) % np.uint64(SLOTS)
            places = []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                for run in runs:
                    begin = int(offsets[i]) + run["first"]
                    places.append((i, run["first"], run["hash"], data[begin : begin + run["last"] - run["first"] + width].tobytes()))
            yield batch, slots, places

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, slots, places in found(batches):
            bits = [1 << s for s in slots.tolist()]
            counts: dict[tuple[int, bytes], list[int]] = {}
            for i, _, h, piece in places:
                seen = counts.setdefault((h, piece), [0, 0])
                seen[0] += 1
                seen[1] |= bits[i]
            hashes = np.array([h for h, _ in counts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_buckets(hashes.view(np.uint64), buckets).astype(np.int32)),
                    pa.array(hashes),
                    pa.array([p for _, p in counts], pa.binary()),
                    pa.array([n for n, _ in counts.values()], pa.int64()),
                    pa.array(np.array([s for _, s in counts.values()], np.uint64).view(np.int64)),
                ],
                names=["bucket", "hash", "piece", "n", "slots"],
            )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slots, places in found(batches):
            row = np.array([i for i, _, _, _ in places], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(p) for _, _, _, p in places], pa.binary()),
                    pa.array(slots[row].astype(np.int32)),
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("text_hash").take(pa.array(row)),
                    pa.array([f for _, f, _, _ in places], pa.int64()),
                ],
                names=["digest", "slot", "doc_id", "text_hash", "first"],
            )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[int, bytes], list[int]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hash", "piece", "n", "slots")]
            for h, piece, n, slots in zip(*columns, strict=True):
                seen = merged.setdefault((h, piece), [0, 0])
                seen[0] += n
                seen[1] |= slots & 0xFFFFFFFFFFFFFFFF
        keys = sorted(merged, key=lambda k: k[0])
        i = 0
        while i < len(keys):
            # All contexts of one hash are sorted together, with as many whole hashes as fit.
            j, size = i, 0
            while j < len(keys) and (size < SORT_BYTES or keys[j][0] == keys[j - 1][0]):
                size += len(keys[j][1])
                j += 1
            group = keys[i:j]
            marks = repeated_windows([p for _, p in group], [merged[k][0] for k in group], width)
            out: list[list] = [[], [], []]
            for key, marked in zip(group, marks, strict=True):
                begins, ends = _spans(marked)
                if not len(begins):
                    continue
                digest, held = _digest(key[1]), merged[key][1]
                covered = [{"b": b, "e": e} for b, e in zip(begins.tolist(), (ends + width - 1).tolist(), strict=True)]
                for slot in range(SLOTS):
                    if held >> slot & 1:
                        for column, value in zip(out, (digest, slot, covered), strict=True):
                            column.append(value)
            span = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), span), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "slot", "covered"])
            i = j

    pieces = cut.mapInArrow(extract, "bucket int, hash bigint, piece binary, n bigint, slots bigint")
    marks = pieces.groupBy("bucket").applyInArrow(mark, "digest binary, slot int, covered array<struct<b: bigint, e: bigint>>")
    places = cut.mapInArrow(locate, "digest binary, slot int, doc_id bigint, text_hash bigint, first bigint")
    return (
        places.join(marks, ["digest", "slot"])
        .select("doc_id", "text_hash", "first", F.inline("covered"))
        .select("doc_id", "text_hash", (F.col("first") + F.col("b")).alias("begin"), (F.col("first") + F.col("e")).alias("end"))
    )


def covered_spans(rows: DataFrame, width: int) -> DataFrame:
    """Spans of covered bytes of each distinct (doc_id, text_hash): a column ``spans`` of (begin, end) structs."""
    buckets = 4 * shuffle_partitions(rows.sparkSession)
    hits = (
        anchor_counts(rows, width, shuffle_partitions(rows.sparkSession))
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
        .agg(F.collect_set(F.struct("first", "last", "hash")).alias("runs"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    cut = rows.join(hits, same).select("doc_id", "text_hash", "text", "runs")
    return (
        context_marks(cut, width, buckets)
        .groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"))
        .agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    )


def merge_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted maximal spans; touching ones are one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def with_spans(rows: DataFrame, width: int) -> DataFrame:
    """``rows``, which have ``doc_id`` and ``text``, with ``spans``, null where nothing is covered."""
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    spans = covered_spans(rows.select("doc_id", "text", "text_hash"), width)
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash"))
    return rows.join(spans, same, "left").drop("text_hash", "span_id", "span_hash")


def _inputs(docs: DataFrame, id_column: str, text_column: str) -> list:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return [F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text")]


def repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 200) -> DataFrame:
    """What stays of every document as bytes: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    A byte is removed if a string of ``width`` bytes that covers it also starts anywhere else in the
    table, in the same document or another, overlapping or not; strings are judged on the input and
    never cross documents. Null texts are empty, texts under ``width`` bytes stay whole. Rows that repeat
    an id or a text are documents of their own, each copy being elsewhere for the other. An empty table
    gives no rows; other columns are not read.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                runs = merge_spans(spans)
                keep = np.ones(len(raw), bool)
                for begin, end in runs:
                    keep[begin:end] = False
                kept = raw[keep].tobytes()
                row = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_spans(docs.select(*_inputs(docs, id_column, text_column)), width).mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )


def drop_repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 200) -> DataFrame:
    """``docs`` with the covered bytes taken out of their texts; all columns and all other texts stay.

    Removed spans shrink to whole characters, so that texts stay valid: a character of which a part is
    not covered is kept.
    """
    others = [c for c in docs.columns if c != text_column]
    gone = F.col(text_column).isNull()
    rest = F.struct(*[F.col(f"`{c}`") for c in others], gone.alias("no text"))
    found = with_spans(docs.select(rest.alias("rest"), *_inputs(docs, id_column, text_column)), width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            texts = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                if spans:
                    keep = np.ones(len(raw), bool)
                    for begin, end in merge_spans(spans):
                        keep[begin:end] = False
                    character = np.cumsum((raw & 0xC0) != 0x80) - 1
                    raw = raw[np.bincount(character, weights=keep)[character] > 0]
                texts.append(raw.tobytes().decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "left"])

    schema = T.StructType([found.schema["rest"]]).add("left", "string")
    left = F.when(~F.col("rest.`no text`"), F.col("left"))
    columns = [left.alias(c) if c == text_column else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return found.select("rest", "text", "spans").mapInArrow(cut, schema).select(*columns)
