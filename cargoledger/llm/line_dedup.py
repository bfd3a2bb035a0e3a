"""Line deduplication over overlapping windows of three consecutive lines.

Every window of lines is hashed, and of windows that occur more than once in the whole table all
but the first are removed: their lines are covered, covered positions are merged into runs, and what
the runs leave is the new text. The first occurrence of a window is found in two steps, per slot of
the documents and then over slots, so the occurrences of a common window are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoledger.llm.common import null_free

SLOTS = 64


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, a hash that tells texts of one id apart, and the lines."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).select(
        "doc_id", null_free("doc_id").alias("key"), F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines")
    )


def _windows(documents: DataFrame, width: int) -> DataFrame:
    """One row per window: its 128-bit digest, where it starts, and the slot of its document."""
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(0), F.size("lines") - width)).otherwise(
        F.array().cast("array<int>")
    )
    digest = lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, F.lit(width)), "\n")))
    return documents.select(
        "doc_id",
        "key",
        "text_hash",
        F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SLOTS)).cast("int").alias("slot"),
        F.posexplode(F.transform(starts, digest)).alias("position", "digest"),
    )


def _place() -> Column:
    """Order of occurrences: by id, ids before null, then text hash and position."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "position")


def removed_runs(documents: DataFrame, width: int) -> DataFrame:
    """Maximal runs of removed lines: ``key, text_hash, first, last``."""
    windows = _windows(documents, width)
    per_slot = windows.groupBy("digest", "slot").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    repeated = (
        per_slot.groupBy("digest")
        .agg(F.min("first").alias("origin"), F.max("last").alias("last"))
        .where("origin < last")
        .select("digest", "origin")
    )
    origins = per_slot.select("digest", "slot").join(repeated, "digest")
    later = windows.join(origins, ["digest", "slot"]).where(_place() > F.col("origin"))
    document = W.partitionBy("key", "text_hash").orderBy("position")
    return (
        later.select("key", "text_hash", "position")
        .distinct()
        .withColumn("opens", F.coalesce(F.col("position") - F.lag("position").over(document) > width, F.lit(True)))
        .withColumn("run", F.sum(F.col("opens").cast("int")).over(document))
        .groupBy("key", "text_hash", "run")
        .agg(F.min("position").alias("first"), (F.max("position") + width - 1).alias("last"))
        .drop("run")
    )


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``doc_id, text, n_lines, n_removed, n_spans``.

    Lines end at line feeds; null text is one empty line. A window is ``width`` consecutive lines of
    one document; documents with fewer lines have none and stay whole. Of equal windows, in the same
    document or others, the first by id and position stays and all lines of the others go, judged on
    the input. Documents without an id come last in that order. Rows that repeat both id and text are one document to
    that order, so they do not repeat each other's windows; each comes out, all with the same result. No
    input rows give no rows.
    """
    documents = _documents(docs, id_column, text_column)
    runs = (
        removed_runs(documents, width)
        .groupBy("key", "text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )
    joined = (
        documents.join(runs, ["key", "text_hash"], "left")
        .withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>")))
    )
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last"] + 1))
    ends = F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("lines")))
    parts = F.transform(F.arrays_zip(begins.alias("begin"), ends.alias("end")), lambda p: F.slice("lines", p["begin"] + 1, p["end"] - p["begin"]))
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        "doc_id",
        F.array_join(F.flatten(parts), "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"),
        F.size("runs").cast("bigint").alias("n_spans"),
    )
