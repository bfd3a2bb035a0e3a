"""Fill-in-the-middle transformation of documents cut at line ends.

A document is a sequence of units, its lines with their line feeds. Two ranks between 0 and the number
of units, drawn from a hash of the seed and the row key, cut it into prefix, middle and suffix. An
indexable skip list over the units finds the cuts: every link of a lane carries how many units and
how many code points it passes over, so descending by accumulated widths reaches a rank exactly and gives
its place in the text in a logarithmic number of steps. Towers are a hash of the unit's number, so
a list is built the same way whenever a task runs again.

The output is one text with markers: prefix, suffix and middle, or suffix, prefix and middle. A text that is
empty or holds a marker stays as it is, so every output can be taken apart again (``restore``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import mix

PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
MARKERS = ("<P>", "<S>", "<M>")
DRAWS = 4
# One unit in 4 rises to the next lane.
RISE_BITS = np.uint64(2)
# Texts of one step's output batch, in characters.
STEP_CHARS = 8 << 20


@dataclass
class Lane:
    units: np.ndarray  # units that the link from each node passes over
    chars: np.ndarray  # code points of these units
    below: np.ndarray  # each node's place in the lane below


class SkipList:
    """An indexable skip list over units of given widths in code points."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        nodes = np.arange(self.n)
        chars, units = widths.astype(np.int64), np.ones(self.n, np.int64)
        self.lanes = [Lane(units, chars, nodes)]
        tower = mix(nodes.astype(np.uint64) + np.uint64(1))
        while len(nodes) > 4:
            high = tower & np.uint64(3) == 0
            high[0] = True
            places = np.flatnonzero(high)
            if len(places) == len(nodes):
                break
            units, chars = np.add.reduceat(units, places), np.add.reduceat(chars, places)
            self.lanes.append(Lane(units, chars, places))
            nodes, tower = nodes[places], tower[places] >> RISE_BITS

    def code_points(self, rank: int) -> int:
        """Code points before unit ``rank``; all of them at rank n."""
        units = chars = node = 0
        for lane in reversed(self.lanes):
            while units < rank and units + lane.units[node] <= rank:
                units += int(lane.units[node])
                chars += int(lane.chars[node])
                node += 1
            if units == rank:
                return chars
            node = int(lane.below[node])
        raise IndexError(f"rank {rank} of {self.n} units")


def line_widths(text: str) -> np.ndarray:
    """Code points of each match of ``[^\\n]*\\n|[^\\n]+``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(raw[:-1] == 0x0A) + 1
    return np.add.reduceat((raw & 0xC0) != 0x80, np.concatenate(([0], starts)), dtype=np.int64)


def draws(seed: int, key: Column) -> list[Column]:
    """Four numbers below 2**32: groups of eight hexadecimal digits of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(DRAWS)]


def cut(text: str, drawn: tuple[int, ...], rate: int, suffix_first_rate: int, markers: tuple[str, ...]) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    units = SkipList(line_widths(text))
    first, second = sorted(h % (units.n + 1) for h in drawn[:2])
    if not text or drawn[2] % 100 >= rate or any(m in text for m in markers):
        return units.n, PLAIN, None, None, text
    a, b = units.code_points(first), units.code_points(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < suffix_first_rate:
        form, parts = SUFFIX_FIRST, (markers[1], suffix, markers[0], prefix, markers[2], middle)
    else:
        form, parts = PREFIX_FIRST, (markers[0], prefix, markers[1], suffix, markers[2], middle)
    return units.n, form, a, b - a, "".join(parts)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    suffix_first_rate: int = 50,
    markers: tuple[str, str, str] = MARKERS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The id column and ``n, form, prefix_chars, middle_chars, output`` of every row.

    ``rate`` per cent of the rows are transformed, and of these ``suffix_first_rate`` per cent begin with the
    suffix. A null text counts as empty; empty texts and texts that hold a marker are ``plain``, have no
    lengths and come out as they are. Rows with equal ids get equal draws, a null id counts as the
    text ``null``; repeated rows come out as often as they occur, an empty table gives no rows, and other
    columns are not read. Whole texts are cut whatever their length: a worker holds one text, its output and eight
    bytes or so for each of its lines.
    """
    rows = docs.select(
        F.struct(F.col(id_column)).alias("key"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col(id_column)))],
    )
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = list(zip(*(batch.column(2 + i).to_pylist() for i in range(DRAWS)), strict=True))
            first, size, out = 0, 0, []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                out.append(cut(text, drawn[row], rate, suffix_first_rate, markers))
                size += len(text)
                if size >= STEP_CHARS or row + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
                    key = batch.column(0).slice(first, len(out))
                    yield pa.RecordBatch.from_arrays([key, *columns], names=["key", *(name for name, _ in fields)])
                    first, size, out = row + 1, 0, []

    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([rows.schema["key"], *[T.StructField(name, t) for (name, _), t in zip(fields, types, strict=True)]])
    return rows.mapInArrow(run, schema).select("key.*", *[name for name, _ in fields])


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of, from the output and its form."""
    prefix_mark, suffix_mark, middle_mark = markers
    head, middle = F.substring_index(output, middle_mark, 1), F.substring(output, F.instr(output, middle_mark) + len(middle_mark), F.length(output))
    second = F.when(form == PREFIX_FIRST, F.lit(suffix_mark)).otherwise(F.lit(prefix_mark))
    at = F.locate  # places count from 1
    left_from = F.when(form == PREFIX_FIRST, F.lit(len(prefix_mark) + 1)).otherwise(F.lit(len(suffix_mark) + 1))
    place = F.when(form == PREFIX_FIRST, at(suffix_mark, head)).otherwise(at(prefix_mark, head))
    left = F.substring(head, left_from, place - left_from)
    right = F.substring(head, place + F.length(second), F.length(head))
    rebuilt = F.when(form == PREFIX_FIRST, F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
    return F.when(form == PLAIN, output).otherwise(rebuilt)
