"""Jaccard join of documents on word shingles, by parity sketches.

A parity sketch XORs the hashes of a set's shingles into words (or bits), each shingle into one of
them, so the number of differing words or bits is at most the size of the symmetric difference. Sets
of a and b shingles with similarity 3/4 or more differ in at most (a + b) / 7 shingles. Four steps:

1. Every document becomes its shingle set, kept as its size, a 128-bit sum that identifies the set, and
   a sketch of parity bits. Documents with equal sets form a class, represented by its smallest id.
2. Candidates. Sizes are banded by powers of two, and a set is sketched into a number of words that
   exceeds the largest difference in its band. By the pigeonhole principle sets that link agree in a
   word, so sets are joined on their words. Not all words are needed: if at most D words differ, then of
   the words in any fixed order the first common one is among the first D + 1 of either set. Words that
   hold many shingles come first, because a shared passage rarely fills them.
3. Within a group that shares a word, parity bits discard pairs that differ in too many bits. What
   remains connects documents into families.
4. Families are verified on whole shingle sets, and links found there give the components.

Groups are searched from one member outwards: what a member links to leaves the search, so a group of
copies costs about one comparison per member. Results of a group are trees over its members, never
all pairs. A family of more than ``FAMILY_BLOCK`` documents is dealt to blocks that each hold the
family's first document too; documents that do not reach it inside their block are then compared
with every block.

A set of 32 or more shingles shares a word with every set it links to as long as its shingles fill more
than a third as many words as it has shingles. They fill 0.4 times as many on average, with a deviation
of about ten standard deviations to that bound; sets below 32 shingles use every shingle as a word,
which is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoledger.llm.common import FOLDED_CODES, mix, run_hashes, shuffle_partitions, slices, spread_join, text_buffer, tree_parents, words, written
from cargoledger.llm.components import components
from cargoledger.llm.exact_dedup import merge_tree

SHINGLE = 5
# Documents of a family that one task verifies together.
FAMILY_BLOCK = 20_000
# Below 2 ** CERTAIN_BAND shingles every shingle is a word of its own.
CERTAIN_BAND = 5
ROWS_AT_ONCE = 60_000
# Bytes of text whose shingles are made at once.
TEXT_BYTES = 2 << 20

ENTRY = np.dtype([("key", "<u4"), ("row", "<u2")])
_K = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row as (row, 64-bit hash), sorted; A-Z count as a-z.

    A shingle is five consecutive words; a row of one to four words has its whole sequence as one.
    """
    starts, ends, row = words(data, offsets)
    word = run_hashes(data, starts, ends, FOLDED_CODES)
    n = len(offsets) - 1
    number = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(number)[:-1])) if n else np.zeros(0, np.int64)

    def sequence(at: np.ndarray, length: int) -> np.ndarray:
        total = np.full(len(at), _K[length - 1], np.uint64)
        for k in range(length):
            total = mix(total + word[at + k] * _K[k])
        return total

    rows, hashes = [], []
    at = np.arange(max(0, len(word) - SHINGLE + 1))
    at = at[row[at] == row[at + SHINGLE - 1]]
    rows.append(row[at])
    hashes.append(sequence(at, SHINGLE))
    for length in range(1, SHINGLE):
        short = np.flatnonzero(number == length)
        rows.append(short)
        hashes.append(sequence(first[short], length))
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[fresh], hashed[fresh]


def band_of(n: np.ndarray) -> np.ndarray:
    """floor(log2(n)) for n >= 1."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1


def sketch_words(band: np.ndarray) -> np.ndarray:
    """Words of the sketches compared in a band of sizes [2 ** band, 2 ** (band + 1))."""
    share = np.where(band >= 9, 0.45, np.where(band == 8, 0.5, 1.0))
    return np.ceil(share * 2.0 ** (band + 1)).astype(np.int64)


def sketch_entries(row: np.ndarray, hashed: np.ndarray, band: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to join on, as (row, value): per row the ``kept[row]`` first non-empty words of its sketch in ``band[row]``."""
    certain = band[row] < CERTAIN_BAND
    spread = mix(hashed ^ _K[0])
    word = np.where(certain, (hashed & np.uint64((1 << 40) - 1)).astype(np.int64), (spread % sketch_words(band[row]).astype(np.uint64)).astype(np.int64))
    order = np.lexsort((word, row))
    row, word, value = row[order], word[order], mix(hashed ^ _K[1])[order]
    if not len(row):
        return row, value
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    begins = np.flatnonzero(begins)
    value = np.bitwise_xor.reduceat(value, begins)
    held = np.diff(np.append(begins, len(row)))
    row, word = row[begins], word[begins]
    value = mix(value + word.astype(np.uint64) * _K[2] + band[row].astype(np.uint64) * _K[3])
    order = np.lexsort((value, -held, row))
    row, value = row[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < kept[row]], value[rank < kept[row]]


def parity_bits(row: np.ndarray, hashed: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A sketch of parity bits for every row, about four to eight bits a shingle, a power of two of at least 64."""
    bits = np.where(size > 0, 1 << np.maximum(band_of(np.maximum(size, 1)) + 3, 6), 64).astype(np.int64)
    base = np.cumsum(bits) - bits
    at = base[row] + (mix(hashed ^ _K[4]) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [parity[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit numbers, all folded to the shortest length by XOR of their halves."""
    length = min(len(s) for s in sketches) // 8
    out = np.zeros((len(sketches), length), np.uint64)
    for i, sketch in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, length), axis=0)
    return out


def _row_totals(row: np.ndarray, values: np.ndarray, n: int, ufunc: np.ufunc) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(row):
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[begins]] = ufunc.reduceat(values, begins)
    return out


def features(rows: DataFrame) -> DataFrame:
    """``doc_id, n, set_a, set_b, sketch`` of every row; set_a and set_b identify the shingle set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                row, hashed = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(row, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(_row_totals(row, mix(hashed ^ _K[2]), j - i, np.add).view(np.int64)),
                        pa.array(_row_totals(row, mix(hashed ^ _K[3]), j - i, np.bitwise_xor).view(np.int64)),
                        pa.array(parity_bits(row, hashed, n), pa.binary()),
                    ],
                    names=["doc_id", "n", "set_a", "set_b", "sketch"],
                )

    return rows.select("doc_id", "text").mapInArrow(describe, "doc_id bigint, n bigint, set_a bigint, set_b bigint, sketch binary")


def sharing_groups(rows: DataFrame, buckets: int) -> DataFrame:
    """Groups of documents that share a sketch word, as ``gid, doc_id``; groups with the same members are one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids = np.asarray(batch.column("doc_id"), dtype=np.int64)
            for i, j in ((a, b) for x, y in slices(offsets, TEXT_BYTES) for a in range(x, y, ROWS_AT_ONCE) for b in [min(y, a + ROWS_AT_ONCE)]):
                row, hashed = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.bincount(row, minlength=j - i)
                sums = _row_totals(row, mix(hashed ^ _K[2]), j - i, np.add)
                xors = _row_totals(row, mix(hashed ^ _K[3]), j - i, np.bitwise_xor)
                keys = zip(n.tolist(), sums.tolist(), xors.tolist(), strict=True)
                # Of equal sets in one partition the first speaks for all; its class links the others.
                fresh = np.zeros(j - i, bool)
                for k, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[k] = key[0] > 0
                row, hashed = row[fresh[row]], hashed[fresh[row]]
                band = band_of(np.maximum(n, 1))
                own = sketch_entries(row, hashed, band, n // 3 + 1)
                # A set also meets the band below if it can link to a set there.
                lower = (band > 0) & (3 * n <= 4 * ((1 << band) - 1))
                below = sketch_entries(row[lower[row]], hashed[lower[row]], band - 1, 2 * n // 7 + 1)
                row, value = np.concatenate((own[0], below[0])), np.concatenate((own[1], below[1]))
                bucket = (value >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                row, value, bucket = row[order], value[order], bucket[order]
                present, begins = np.unique(bucket, return_index=True)
                edges = [*begins.tolist(), len(bucket)]
                held, blobs = [], []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    used, local = np.unique(row[a:b], return_inverse=True)
                    entry = np.zeros(b - a, ENTRY)
                    entry["key"], entry["row"] = value[a:b] & np.uint64(0xFFFFFFFF), local
                    held.append(ids[used + i])
                    blobs.append(entry.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(present.astype(np.int32)), pa.array(held, pa.list_(pa.int64())), pa.array(blobs, pa.binary())],
                    names=["bucket", "ids", "entries"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners = [], []
        for batch in batches:
            lists = batch.column("ids")
            for k in range(batch.num_rows):
                entry = np.frombuffer(batch.column("entries")[k].as_py(), ENTRY)
                keys.append(entry["key"])
                owners.append(np.asarray(lists[k].values, dtype=np.int64)[entry["row"]])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        key, owner = key[shared], owner[order[shared]]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[fresh], owner[fresh]
        if not len(key):
            return
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        held = np.diff(np.append(begins, len(key)))
        gid = mix(np.add.reduceat(mix(owner.view(np.uint64) + _K[0]), begins))
        _, chosen = np.unique(gid, return_index=True)
        chosen = chosen[held[chosen] > 1]
        at = np.repeat(begins[chosen] - np.cumsum(held[chosen]) + held[chosen], held[chosen]) + np.arange(int(held[chosen].sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(gid[chosen], held[chosen]).view(np.int64)), pa.array(owner[at])], names=["gid", "doc_id"]
        )

    packed = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(pack, "bucket int, ids array<bigint>, entries binary")
    return packed.groupBy("bucket").applyInArrow(meet, "gid bigint, doc_id bigint")


def search(n: int, near) -> list[np.ndarray]:
    """Components of 0..n-1, where ``near(i, others)`` flags those of ``others`` that i links to."""
    found, rest = [], np.arange(n)
    while len(rest):
        queue, component = [rest[0]], [rest[:1]]
        rest = rest[1:]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            if hit.any():
                component.append(rest[hit])
                queue.extend(rest[hit])
                rest = rest[~hit]
        found.append(np.sort(np.concatenate(component)))
    return found


def family_edges(groups: DataFrame, sketches: DataFrame, buckets: int) -> DataFrame:
    """Edges ``a, b`` of trees over members of a group that their parity bits do not tell apart."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        rows = rows.take(pa.compute.sort_indices(rows, [("gid", "ascending"), ("doc_id", "ascending")]))
        gid = np.asarray(rows["gid"])
        ids, size = np.asarray(rows["doc_id"]), np.asarray(rows["n"])
        sketches = rows["sketch"].combine_chunks()
        begins = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        children, parents = [], []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(gid)], strict=True):
            if b - a < 2:
                continue
            bits, n = folded(sketches[a:b].to_pylist()), size[a:b]

            def near(i: int, others: np.ndarray, bits=bits, n=n) -> np.ndarray:
                differing = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
                return 7 * differing <= n[others] + n[i]

            for component in search(b - a, near):
                child, parent = tree_parents(ids[a:b][component])
                children.append(child)
                parents.append(parent)
        if children:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children)), pa.array(np.concatenate(parents))], names=["a", "b"])

    members = groups.join(sketches, "doc_id").withColumn("bucket", F.pmod("gid", F.lit(buckets)))
    return members.groupBy("bucket").applyInArrow(compare, "a bigint, b bigint")


def _near_sets(ends: np.ndarray, flat: np.ndarray, size: np.ndarray):
    """``near`` for ``search`` on whole sets; set i is ``flat[ends[i] - size[i]:ends[i]]``, sorted."""

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = flat[ends[i] - size[i] : ends[i]]
        close = (4 * size[others] >= 3 * size[i]) & (4 * size[i] >= 3 * size[others])
        tried = others[close]
        hit = np.zeros(len(others), bool)
        if len(tried):
            lengths = size[tried]
            begins = np.cumsum(lengths) - lengths
            values = flat[np.repeat(ends[tried] - lengths - begins, lengths) + np.arange(int(lengths.sum()))]
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            common = np.add.reduceat(own[at] == values, begins, dtype=np.int64)
            hit[close] = 100 * common >= 75 * (lengths + size[i] - common)
        return hit

    return near


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text_buffer(rows["shingles"])
    return offsets[1:] // 8, np.frombuffer(raw.tobytes(), np.uint64), np.diff(offsets) // 8


def _family_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket, family and block by family and block, ids ascending."""
    rows = pa.Table.from_batches(list(batches))
    rows = rows.take(pa.compute.sort_indices(rows, [("family", "ascending"), ("block", "ascending"), ("doc_id", "ascending")]))
    family, block = np.asarray(rows["family"]), np.asarray(rows["block"])
    change = (family[1:] != family[:-1]) | (block[1:] != block[:-1])
    begins = np.flatnonzero(np.concatenate(([True], change)))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(family)], strict=True):
        yield rows.slice(a, b - a)


def shingle_table(rows: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns with ``shingles``, the sorted 64-bit hashes of the row's set in one binary."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                row, hashed = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds = (8 * np.searchsorted(row, np.arange(j - i + 1))).tolist()
                raw = hashed.tobytes()
                blobs = pa.array([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carried), blobs], names=[*carried, "shingles"])

    return rows.select(*carried, "text").mapInArrow(shingle, rows.select(*carried).withColumn("shingles", F.lit(b"")).schema)


def verified_components(rows: DataFrame, families: DataFrame, buckets: int, block_size: int) -> DataFrame:
    """``doc_id, component`` for the documents of families, from links between whole shingle sets."""
    sizes = families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("blocks"))
    placed = spread_join(families, sizes, "family", ["doc_id"], "inner")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    # The family's first document goes to every block.
    blocks = F.when(F.col("doc_id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    sets = written(
        shingle_table(rows.select("doc_id", "text").join(placed, "doc_id"), ["doc_id", "family", "blocks"]).select(
            "doc_id", "family", "blocks", "shingles", F.pmod(F.xxhash64("family"), F.lit(buckets)).alias("bucket")
        ),
        "shingles",
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _family_groups(batches):
            ids, family = np.asarray(group["doc_id"]), np.asarray(group["family"])
            ends, flat, size = _unpacked(group)
            label, anchored = ids.copy(), np.zeros(len(ids), bool)
            for component in search(len(ids), _near_sets(ends, flat, size)):
                label[component] = ids[component[0]]
                anchored[component] = (ids[component] == family[component]).any()
            yield pa.RecordBatch.from_arrays(
                [group[c].combine_chunks() for c in ("doc_id", "family", "block")] + [pa.array(label), pa.array(anchored)],
                names=["doc_id", "family", "block", "label", "anchored"],
            )

    dealt = sets.withColumn("block", F.explode(blocks)).withColumn("task", F.pmod(F.xxhash64("family", "block"), F.lit(buckets)))
    found = dealt.groupBy("task").applyInArrow(link, "doc_id bigint, family bigint, block int, label bigint, anchored boolean")
    if sizes.where("blocks > 1").isEmpty():
        return found.select("doc_id", F.col("label").alias("component"))
    return _across_blocks(dealt, written(found, "blocks"), buckets)


def _across_blocks(dealt: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Components of families in several blocks: documents that missed the first one visit every block."""
    labelled = dealt.join(found.select("doc_id", "block", "label", "anchored"), ["doc_id", "block"])
    homes = labelled.select("doc_id", "family", "block", "label", "shingles", "task", F.lit(False).alias("visits"))
    visitors = (
        labelled.where("blocks > 1 and not anchored")
        .withColumn("home", F.col("block"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .where("block <> home")
        .withColumn("task", F.pmod(F.xxhash64("family", "block"), F.lit(buckets)))
        .select("doc_id", "family", "block", "label", "shingles", "task", F.lit(True).alias("visits"))
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _family_groups(batches):
            visits, label = np.asarray(group["visits"], dtype=bool), np.asarray(group["label"])
            near = _near_sets(*_unpacked(group))
            hosts = np.flatnonzero(~visits)
            for guest in np.flatnonzero(visits).tolist():
                met = np.unique(label[hosts[near(guest, hosts)]])
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), label[guest])), pa.array(met)], names=["a", "b"])

    edges = homes.unionByName(visitors).groupBy("task").applyInArrow(visit, "a bigint, b bigint")
    joined = components(edges).withColumnRenamed("node", "label")
    # The first document is in every block; its label there is the block's own.
    labels = spread_join(found.select("doc_id", "label"), joined, "label", ["doc_id"])
    return labels.groupBy("doc_id").agg(F.min(F.coalesce("component", "label")).alias("component"))


def linked_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", family_block: int = FAMILY_BLOCK
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, class_id, component_id``.

    A document's set holds its distinct five-word shingles over its whole text, A-Z counting as a-z;
    with one to four words the whole sequence is one shingle; without words the set is empty and
    links with nothing. Documents link when 100 * intersection >= 75 * union, and ``component_id`` is
    the smallest id reachable by links; ``class_id`` is the smallest id with the same set (for empty
    sets the own id). Rows that share an id are one node of the graph and each has its own row here.
    Rows without an id link with nothing and have neither class nor component. An empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    buckets = shuffle_partitions(docs.sparkSession)
    described = written(features(rows), "features")
    solid = described.where("n > 0 and doc_id is not null")
    classes = written(
        merge_tree(solid.select("doc_id", "n", "set_a", "set_b").distinct(), ["n", "set_a", "set_b"], "doc_id", "smallest", 64, 3)
        .groupBy("doc_id")
        .agg(F.min("keep_id").alias("class_id")),
        "classes",
    )
    groups = (
        sharing_groups(rows, buckets)
        .join(classes, "doc_id")
        .select("gid", F.col("class_id").alias("doc_id"))
        .distinct()
    )
    edges = written(family_edges(groups, solid.select("doc_id", "n", "sketch"), 4 * buckets).distinct(), "family-edges")
    families = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    labels = verified_components(rows, families, 4 * buckets, family_block).withColumnRenamed("doc_id", "class_id")
    labels = labels.groupBy("class_id").agg(F.min("component").alias("component"))
    of_class = spread_join(classes, labels, "class_id", ["doc_id"])
    component = F.coalesce("component", "class_id", "doc_id")
    return described.select("doc_id", F.col("n").alias("n_shingles")).join(of_class, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id")
    )


def one_of_each_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with, of each group of linked documents, the one with the smallest id; all columns stay.

    Rows without an id link with nothing and stay; rows that share the id that stays all stay.
    """
    found = linked_components(docs, id_column, text_column, **options)
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped id")).distinct()
    tagged = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("bigint").alias("id"))
    return tagged.join(dropped, F.col("id") == F.col("dropped id"), "left_anti").select("row.*")
