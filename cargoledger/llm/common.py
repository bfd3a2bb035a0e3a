"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.sources.scratch import scratch_folder

# Bytes of text that one step of a vectorised loop works on; bounds the memory of a Python worker.
SLICE_BYTES = 4 << 20
HASHED_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Bytes 0x09 to 0x0D and 0x20 separate words.
WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def null_free(column: str) -> Column:
    """An id as text that is never null, so that joins and groups on it share one shuffle; null gives a text no id has."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00"))


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which a deployment sets from the size of its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut of lineage that outlives executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_hash(id_column: str, modulus: int) -> Column:
    """Remainder of crc32 of the id as text; null ids give null."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row comes alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly (splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


CODES = _byte_codes(fold_case=False)
FOLDED_CODES = _byte_codes(fold_case=True)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``data[starts[i]:ends[i]]``, which must not be empty or overlap."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    powers = np.full(int(lengths.max(initial=1)), _MULTIPLIER)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    for a, b in slices(np.concatenate(([0], np.cumsum(lengths))), HASHED_BYTES):
        size = lengths[a:b]
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        at = within + np.repeat(starts[a:b], size)
        sums = np.add.reduceat(codes[data[at]] * powers[within], first)
        out[a:b] = mix(sums + size.astype(np.uint64) * _MULTIPLIER)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words; a word never crosses from one row to the next."""
    inside = ~WORD_SPACE[data]
    begins = np.zeros(len(data), bool)
    if len(data):
        begins[0] = inside[0]
        begins[1:] = inside[1:] & ~inside[:-1]
        row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[row_starts] = inside[row_starts]
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[-1] = inside[-1]
        ends[:-1] = inside[:-1] & ~inside[1:]
        row_ends = row_starts[1:] - 1
        ends[row_ends] = inside[row_ends]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def spread_join(facts: DataFrame, lookup: DataFrame, on: str, row_key: list[str], how: str = "left", slots: int = 64) -> DataFrame:
    """Join ``facts`` to a ``lookup`` with one row per key, which any number of facts may share.

    Facts are dealt to slots by a hash of ``row_key`` and the lookup row is repeated for the slots
    that occur, so no task takes more than a slot's share of a key.
    """
    dealt = facts.withColumn("_slot", F.pmod(F.xxhash64(*row_key), F.lit(slots)).cast("int"))
    repeated = dealt.select(on, "_slot").distinct().join(lookup, on)
    return dealt.join(repeated, [on, "_slot"], how).drop("_slot")


def tree_parents(members: np.ndarray, fan_out: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) of a shallow tree over sorted ``members``; no member has many edges."""
    return members[1:], members[(np.arange(1, len(members)) - 1) // fan_out]
