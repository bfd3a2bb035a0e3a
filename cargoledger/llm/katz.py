"""Language-model scoring with Katz backoff.

Tokens are words with A-Z lower-cased and one end per text. The model is a bigram model: a pair (h, w) seen c
times after a history h seen c(h) times has probability ``d(c) * c / c(h)``, with the Good-Turing
discount d(c) for c up to ``GT_LIMIT``; what the discounts free is given to the words not seen after h, in
proportion to their unigram probability, by a weight that makes the probabilities of all words sum to
exactly one. Unigrams are discounted the same way, and their freed mass is that of the one class of
unknown words. A history never seen leaves the unigram probability as it is.

Counts live in tables partitioned by hash. Documents are dealt to batches; a batch sends every distinct
n-gram once to the part of the table that holds it, with the count it adds from its training
documents, and gets the corpus count back. First words are counted, then pairs, where the part also returns
for each history how many successors it has per count and their summed unigram probability: all that
the discounts and the backoff weight need. Counts of counts are sums over the parts and travel with the
answers. So every n-gram crosses the network once per batch that holds it, packed, and nothing is
gathered on the driver. A history with many successors is cut into slots by a hash of the successor, as
many as its count asks for; its sums are added up in the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm.common import FOLDED_CODES, mix, run_hashes, shuffle_partitions, split_hash, text_buffer, words

# Counts above this are not discounted.
GT_LIMIT = 5
# Occurrences of a history from which on it is cut into slots of about this many.
SLOT_COUNT = 200_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_SLOT = np.uint64(0x9E3779B97F4A7C15)

ANSWER = "batch bigint, level int, bucket int, counts binary, sums binary, totals array<bigint>"
REQUEST = "bucket int, batch bigint, grams binary, groups binary, totals array<bigint>"

WORD = np.dtype([("key", "<u8"), ("added", "<u4")])
PAIR = np.dtype([("low", "<u4"), ("high", "<u2"), ("added", "<u4"), ("count", "<u4")])
GROUP = np.dtype([("key", "<u8"), ("size", "<u4")])
COUNT = np.dtype([("count", "<u4")])
SUMS = np.dtype([("of_count", "<u4", GT_LIMIT), ("larger", "<u4"), ("unigram", "<f8")])


@dataclass
class Totals:
    """Counts of counts 1 to GT_LIMIT + 1, occurrences and distinct n-grams of one order."""

    of_count: np.ndarray
    occurrences: int
    distinct: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Totals:
        counts = counts[counts > 0]
        small = np.bincount(counts[counts <= GT_LIMIT + 1].astype(np.int64), minlength=GT_LIMIT + 2)[1:]
        return cls(small, int(counts.sum()), len(counts))

    @classmethod
    def summed(cls, parts: list[list[int]]) -> Totals:
        total = np.array(parts, dtype=np.int64).reshape(-1, GT_LIMIT + 3).sum(axis=0)
        return cls(total[: GT_LIMIT + 1], int(total[-2]), int(total[-1]))

    def packed(self) -> list[int]:
        return [*self.of_count.tolist(), self.occurrences, self.distinct]

    def discounts(self) -> np.ndarray:
        """Katz's Good-Turing discounts by count 0 to GT_LIMIT + 1 (1 at both ends).

        Where the counts of counts are too few for a discount between 0 and 1, an absolute discount of
        n1 / (n1 + 2 n2) stands in.
        """
        n = self.of_count.astype(float)
        absolute = min(max(n[0] / (n[0] + 2 * n[1]), 0.1), 0.9) if n[0] else 0.5
        out = np.ones(GT_LIMIT + 2)
        tail = (GT_LIMIT + 1) * n[GT_LIMIT] / n[0] if n[0] else 1.0
        for r in range(1, GT_LIMIT + 1):
            good_turing = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and n[r] and tail < 1 else 0.0
            out[r] = good_turing if 0 < good_turing < 1 else 1 - absolute / r
        return out


class Unigrams:
    """Discounted unigram probabilities; ``unknown`` is the mass of the class of unseen words."""

    def __init__(self, totals: Totals):
        self.totals, self.discount = totals, totals.discounts()
        n = max(totals.occurrences, 1)
        r = np.arange(1, GT_LIMIT + 1)
        freed = float((totals.of_count[:GT_LIMIT] * r * (1 - self.discount[1 : GT_LIMIT + 1])).sum()) / n
        if not totals.occurrences:
            self.unknown, self.scale = 1.0, 1.0
        elif freed > 1e-12:
            self.unknown, self.scale = freed, 1.0 / n
        else:  # no count is discounted: one more occurrence is set aside for the unknown
            self.unknown, self.scale = 1.0 / (n + 1), 1.0 / (n + 1)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        seen = self.discount[np.minimum(counts, GT_LIMIT + 1)] * counts * self.scale
        return np.where(counts > 0, seen, self.unknown)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.totals.occurrences + self.totals.distinct + 1))


def backoff(sums: np.ndarray, history: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor of the seen pairs, and backoff weight, of histories with these sums and counts ``history`` > 0."""
    r = np.arange(1, GT_LIMIT + 1)
    kept = (sums["of_count"] * (r * discount[1 : GT_LIMIT + 1])).sum(axis=1) + sums["larger"]
    freed = 1 - kept / history
    # Without any discounted successor one more occurrence of the history is set aside.
    full = freed <= 1e-12
    factor = np.where(full, 1 / (history + 1.0), 1.0 / history)
    left = np.where(full, 1 / (history + 1.0), freed)
    return factor, left / np.maximum(1 - sums["unigram"], 1e-300)


class Batch:
    """The tokens of a batch of documents, in order, an end after each."""

    def __init__(self, rows: pa.Table):
        data, offsets = text_buffer(rows.column("text"))
        starts, ends, row = words(data, offsets)
        n = len(offsets) - 1
        word = run_hashes(data, starts, ends, FOLDED_CODES)
        number = np.bincount(row, minlength=n)
        self.lengths = number + 1
        last = np.cumsum(self.lengths) - 1
        hashes = np.full(len(word) + n, END, np.uint64)
        hashes[np.arange(len(word)) + row] = word
        self.first = last - number
        self.held_out = np.asarray(rows.column("held_out").combine_chunks(), dtype=bool)
        trained = np.repeat(~self.held_out, self.lengths)
        self.vocabulary, self.token = np.unique(hashes, return_inverse=True)
        self.added = np.bincount(self.token[trained], minlength=len(self.vocabulary))
        self.trained = trained

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as history and word numbers (the start has the number after the last word), the count
        added by training texts, and the pair of every token."""
        size = len(self.vocabulary)
        history = np.empty(len(self.token), np.int64)
        history[1:] = self.token[:-1]
        history[self.first] = size
        code = history * size + self.token
        order = np.argsort(code, kind="stable")
        ordered = code[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        begins = np.flatnonzero(fresh)
        pair = np.empty(len(code), np.int64)
        pair[order] = np.cumsum(fresh) - 1
        added = np.add.reduceat(self.trained[order].astype(np.int64), begins) if len(begins) else begins
        return ordered[begins] // size, ordered[begins] % size, added, pair


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order that sorts by bucket, then by hash, the buckets, and their ranges in that order.

    Empty buckets are asked too: their answer brings the totals that every batch adds up.
    """
    bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((hashes, bucket))
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
    return order, np.arange(buckets, dtype=np.int32), list(zip(edges[:-1], edges[1:], strict=True))


def _requests(present: np.ndarray, batch: int, grams: list[bytes], groups: list[bytes], totals: list[int]) -> pa.Table:
    n = len(present)
    columns = [pa.array(present), pa.array([batch] * n, pa.int64()), pa.array(grams, pa.binary()), pa.array(groups, pa.binary()), pa.array([totals] * n, pa.list_(pa.int64()))]
    return pa.table(columns, names=["bucket", "batch", "grams", "groups", "totals"])


def word_answers(answers: pa.Table, batch: Batch, buckets: int) -> tuple[np.ndarray, Unigrams]:
    """Corpus counts of the batch's vocabulary, and the unigram model."""
    rows = answers.filter(pa.compute.equal(answers["level"], 1))
    order, present, ranges = _by_bucket(batch.vocabulary, buckets)
    counts = np.zeros(len(batch.vocabulary), np.int64)
    found = dict(zip(rows["bucket"].to_pylist(), rows["counts"].to_pylist(), strict=True))
    for bucket, (a, b) in zip(present.tolist(), ranges, strict=True):
        counts[order[a:b]] = _unpacked(found[bucket], COUNT)["count"]
    return counts, Unigrams(Totals.summed(rows["totals"].to_pylist()))


class PairLayout:
    """How a batch's pairs are grouped by history and slot and dealt to buckets; the same for request and answer."""

    def __init__(self, batch: Batch, counts: np.ndarray, buckets: int):
        self.history, self.word, self.added, self.pair = batch.pairs()
        size = len(batch.vocabulary)
        seen = np.append(counts, 1) > 0  # texts' start is a known history
        wanted = np.flatnonzero(seen[self.history])
        slots = np.append(1 + counts // SLOT_COUNT, 1 + counts[np.searchsorted(batch.vocabulary, END)] // SLOT_COUNT if size else 1)
        history, word = self.history[wanted], self.word[wanted]
        spread = mix(batch.vocabulary + _SLOT)[word]
        slot = (spread % slots[history].astype(np.uint64)).astype(np.int64)
        # A history in several slots asks all of them, for its sums.
        used = np.unique(history)
        many = used[slots[used] > 1]
        asked = np.repeat(many, slots[many])
        every = np.arange(len(asked)) - np.repeat(np.cumsum(slots[many]) - slots[many], slots[many])
        keys = np.append(mix(batch.vocabulary ^ START), START)
        key = lambda h, s: mix(keys[h] + s.astype(np.uint64) * _SLOT)
        gram_key, all_keys = key(history, slot), key(asked, every)
        self.groups, first = np.unique(np.concatenate((gram_key, all_keys)), return_index=True)
        self.group_history = np.concatenate((history, asked))[first]
        group = np.searchsorted(self.groups, gram_key)
        group_order, self.present, self.group_ranges = _by_bucket(self.groups, buckets)
        place = np.empty(len(group_order), np.int64)
        place[group_order] = np.arange(len(group_order))
        self.order = wanted[np.lexsort((batch.vocabulary[word], place[group]))]
        sorted_group = np.sort(place[group])
        bounds = np.searchsorted(sorted_group, np.arange(len(group_order) + 1))
        self.sizes = np.diff(bounds)
        self.group_order = group_order
        self.gram_ranges = [(int(bounds[a]), int(bounds[b])) for a, b in self.group_ranges]


def scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 7, held_out: int = 2, batches: int | None = None) -> DataFrame:
    """Scores of all whole texts: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from documents whose crc32(id as text) modulo ``folds`` is not ``held_out``; documents without
    an id are held out. Tokens are words between bytes 0x20 and 0x09-0x0D, A-Z lower-cased, then one end,
    also for empty and null texts. ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens, and
    ``score`` is the model's log10 probability. Rows that repeat are counted and scored as often as they
    occur; without training texts every word is unknown, with probability one. An empty table gives no
    rows; other columns are not read.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    n_batches = batches or buckets
    remainder = split_hash(id_column, folds)
    rows = docs.select(
        F.pmod(F.xxhash64(id_column, text_column), F.lit(n_batches)).cast("bigint").alias("batch"),
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(remainder == held_out, F.lit(True)).alias("held_out"),
        F.col(text_column).cast("string").alias("text"),
    )

    def ask_words(rows: pa.Table) -> pa.Table:
        batch = Batch(rows)
        order, present, ranges = _by_bucket(batch.vocabulary, buckets)
        grams = np.zeros(len(order), WORD)
        grams["key"], grams["added"] = batch.vocabulary[order], batch.added[order]
        return _requests(present, rows["batch"][0].as_py(), [_packed(grams[a:b]) for a, b in ranges], [b""] * len(present), [])

    def count_words(requests: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(requests))
        parts = [_unpacked(g, WORD) for g in table["grams"].to_pylist()]
        grams = np.concatenate(parts)
        keys, at = np.unique(grams["key"], return_inverse=True)
        counts = np.bincount(at, weights=grams["added"], minlength=len(keys)).astype(np.int64)
        answers = np.split(counts[at].astype("<u4"), np.cumsum([len(p) for p in parts])[:-1])
        yield from _answers(table, 1, answers, [b""] * len(parts), Totals.of(counts))

    def ask_pairs(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows)
        counts, unigrams = word_answers(answers, batch, buckets)
        layout = PairLayout(batch, counts, buckets)
        at = layout.order
        grams = np.zeros(len(at), PAIR)
        word = batch.vocabulary[layout.word[at]]
        grams["low"], grams["high"] = word & np.uint64(0xFFFFFFFF), (word >> np.uint64(32)) & np.uint64(0xFFFF)
        grams["added"], grams["count"] = layout.added[at], counts[layout.word[at]]
        groups = np.zeros(len(layout.groups), GROUP)
        groups["key"], groups["size"] = layout.groups[layout.group_order], layout.sizes
        return _requests(
            layout.present,
            rows["batch"][0].as_py(),
            [_packed(grams[a:b]) for a, b in layout.gram_ranges],
            [_packed(groups[a:b]) for a, b in layout.group_ranges],
            unigrams.totals.packed(),
        )

    def count_pairs(requests: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(requests))
        parts = [_unpacked(g, PAIR) for g in table["grams"].to_pylist()]
        heads = [_unpacked(g, GROUP) for g in table["groups"].to_pylist()]
        unigrams = Unigrams(Totals.summed([table["totals"][0].as_py()]))
        grams, groups = np.concatenate(parts), np.concatenate(heads)
        keys, group = np.unique(groups["key"], return_inverse=True)
        history = np.repeat(group, groups["size"])
        word = grams["low"].astype(np.uint64) | (grams["high"].astype(np.uint64) << np.uint64(32))
        order = np.lexsort((word, history))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (history[order][1:] != history[order][:-1]) | (word[order][1:] != word[order][:-1])
        begins = np.flatnonzero(fresh)
        counts = np.add.reduceat(grams["added"][order].astype(np.int64), begins) if len(begins) else begins
        answer = np.empty(len(order), "<u4")
        answer[order] = counts[np.cumsum(fresh) - 1] if len(begins) else 0
        kept = order[begins][counts > 0]
        totals = Totals.of(counts)
        owner, counts = history[kept], counts[counts > 0]
        sums = np.zeros(len(keys), SUMS)
        for r in range(1, GT_LIMIT + 1):
            sums["of_count"][:, r - 1] = np.bincount(owner[counts == r], minlength=len(keys))
        sums["larger"] = np.bincount(owner, weights=np.where(counts > GT_LIMIT, counts, 0), minlength=len(keys))
        sums["unigram"] = np.bincount(owner, weights=unigrams.probability(grams["count"][kept].astype(np.int64)), minlength=len(keys))
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        head_cuts = np.cumsum([len(h) for h in heads])[:-1]
        yield from _answers(table, 2, np.split(answer, cuts), [_packed(s) for s in np.split(sums[group], head_cuts)], totals)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows)
        counts, unigrams = word_answers(answers, batch, buckets)
        layout = PairLayout(batch, counts, buckets)
        found = answers.filter(pa.compute.equal(answers["level"], 2))
        pairs = Totals.summed(found["totals"].to_pylist())
        blobs = {b: (c, s) for b, c, s in zip(found["bucket"].to_pylist(), found["counts"].to_pylist(), found["sums"].to_pylist(), strict=True)}
        times = np.zeros(len(layout.history), np.int64)
        sums = np.zeros(len(batch.vocabulary) + 1, SUMS)
        for bucket, (a, b), (x, y) in zip(layout.present.tolist(), layout.group_ranges, layout.gram_ranges, strict=True):
            count, part = blobs[bucket]
            times[layout.order[x:y]] = _unpacked(count, COUNT)["count"]
            part, owner = _unpacked(part, SUMS), layout.group_history[layout.group_order[a:b]]
            for name in ("of_count", "larger", "unigram"):
                np.add.at(sums[name], owner, part[name])
        # Every training text has one start and one end.
        of_history = np.append(counts, counts[np.searchsorted(batch.vocabulary, END)])
        known = of_history > 0
        factor, weight = backoff(sums, np.maximum(of_history, 1), pairs.discounts())
        discount = pairs.discounts()[np.minimum(times, GT_LIMIT + 1)]
        lower = unigrams.probability(counts)[layout.word]
        backed = np.where(known[layout.history], weight[layout.history] * lower, lower)
        probability = np.where(times > 0, discount * times * factor[layout.history], backed)
        row = np.repeat(np.arange(len(batch.lengths)), batch.lengths)
        total = lambda values: np.bincount(row, weights=values, minlength=len(batch.lengths))
        columns = {
            "doc_id": rows["doc_id"],
            "held_out": rows["held_out"],
            "n_tokens": pa.array(batch.lengths.astype(np.int64)),
            "n_known": pa.array(total((counts > 0)[batch.token]).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(batch.lengths), unigrams.totals.occurrences, np.int64)),
            "base_score": pa.array(total(unigrams.base_log(counts)[batch.token])),
            "score": pa.array(total(np.log10(probability)[layout.pair])),
        }
        return pa.table(columns)

    counted = rows.groupBy("batch").applyInArrow(ask_words, REQUEST).groupBy("bucket").applyInArrow(count_words, ANSWER)
    paired = (
        rows.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(ask_pairs, REQUEST).groupBy("bucket").applyInArrow(count_pairs, ANSWER)
    )
    result = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("batch").cogroup(counted.unionByName(paired).groupBy("batch")).applyInArrow(score, result)


def _packed(rows: np.ndarray) -> bytes:
    """Rows as compressed planes, all first bytes of a field, then all second ones: counts are mostly zeros there."""
    planes = b"".join(
        np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for name in rows.dtype.names
    ) if len(rows) else b""
    return len(rows).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    out = np.zeros(int.from_bytes(blob[:8], "little"), kind)
    if len(out):
        planes = np.frombuffer(pa.decompress(blob[8:], len(out) * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
        at = 0
        for name in kind.names:
            size = kind[name].itemsize
            field = np.ascontiguousarray(planes[at * len(out) : (at + size) * len(out)].reshape(size, len(out)).T)
            out[name] = field.view(kind[name].base).reshape(len(out), *kind[name].shape)
            at += size
    return out


def _answers(table: pa.Table, level: int, counts: list[np.ndarray], sums: list[bytes], totals: Totals) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    yield pa.RecordBatch.from_arrays(
        [
            table["batch"].combine_chunks(),
            pa.array([level] * n, pa.int32()),
            table["bucket"].combine_chunks(),
            pa.array([_packed(c.astype("<u4").view(COUNT)) for c in counts], pa.binary()),
            pa.array(sums, pa.binary()),
            pa.array([totals.packed()] * n, pa.list_(pa.int64())),
        ],
        names=["batch", "level", "bucket", "counts", "sums", "totals"],
    )
