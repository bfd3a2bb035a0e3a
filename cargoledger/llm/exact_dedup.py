"""Exact deduplication by a tree of merges over sorted digest runs.

Every document goes to one of ``runs`` runs by a hash of its id and its place in the digest table, so
rows that repeat an id are spread too. A run is the sorted list of its
distinct digests, each with the one id to keep and the number of documents it stands for. In each
round the runs whose numbers agree but for their last bits are merged into one, as in a binomial
exchange: every digest keeps the best of the ids that its parts kept and the sum of their counts.
After the last round a digest is one row, and the decision travels back down the same tree. No step
brings more than ``fan_in`` rows of one digest together, nor more than a run's share of its
documents, so a group that holds a third of all rows is worked on by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoledger.llm.common import ascii_lower, null_free, shuffle_partitions, written

# What two entries must share to count as one text: the digest, and two checks that verify it.
TEXT_KEY = ["digest", "size", "check"]


def with_text_key(rows: DataFrame, text: Column) -> DataFrame:
    """Add the columns of TEXT_KEY for ``text`` with A-Z lower-cased; null counts as empty."""
    folded = ascii_lower(text)
    return rows.withColumns(
        {
            "digest": F.unhex(F.sha2(folded, 256)),
            "size": F.octet_length(folded),
            "check": F.xxhash64(folded),
        }
    )


def _preferred(keep: str) -> Column:
    """The id to keep; an id always wins over null."""
    if keep == "smallest":
        return F.min(F.struct(F.col("best").isNull().alias("absent"), "best"))["best"]
    if keep == "largest":
        return F.max(F.struct(F.col("best").isNotNull().alias("present"), "best"))["best"]
    raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")


def merge_tree(
    entries: DataFrame, key: list[str], id_column: str, keep: str, runs: int, fan_in_bits: int, place: tuple[str, ...] = ()
) -> DataFrame:
    """``entries`` with ``keep_id`` and ``group_size`` of their key.

    Entries are distinct (id, key) rows, or ``place`` names a stored column that tells equal ones apart.
    """
    run = F.pmod(F.xxhash64(id_column, *key, *place), F.lit(runs)).cast("int")
    levels = [
        entries.select(run.alias("run"), *key, F.col(id_column).alias("best"))
        .groupBy("run", *key)
        .agg(_preferred(keep).alias("best"), F.count(F.lit(1)).alias("members"))
    ]
    left = runs
    while left > 1:
        left = -(-left >> fan_in_bits) if left >= 1 << fan_in_bits else 1
        shorter = F.shiftright("run", fan_in_bits).alias("run")
        levels.append(
            levels[-1]
            .select(shorter, *key, "best", "members")
            .groupBy("run", *key)
            .agg(_preferred(keep).alias("best"), F.sum("members").alias("members"))
        )
    decided = levels[-1].select("run", *key, F.col("best").alias("keep_id"), F.col("members").alias("group_size"))
    for level in reversed(levels[:-1]):
        children = level.select("run", *key, F.shiftright("run", fan_in_bits).alias("parent"))
        decided = children.join(decided.withColumnRenamed("run", "parent"), ["parent", *key]).drop("parent")
    return entries.withColumn("run", run).join(decided, ["run", *key]).drop("run")


def exact_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    runs: int | None = None,
    fan_in_bits: int = 4,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    document with the smallest or largest id is kept. Every row comes out and counts, also one that repeats
    the id and text of another; such rows are all marked kept if that id is (``drop_exact_copies`` keeps
    one of them). Rows without an id are documents like any other; they are kept only if no equal text
    has an id. An empty table gives no rows; other columns are not read. ``runs`` defaults to the power of
    two above the shuffle width. The digests are computed once, into the shared folder, and every
    round reads them from there.
    """
    if runs is None:
        runs = 1 << max(6, (shuffle_partitions(docs.sparkSession) - 1).bit_length())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    digests = with_text_key(rows, F.col("text")).select("doc_id", *TEXT_KEY, F.monotonically_increasing_id().alias("place"))
    entries = written(digests, "digests")
    return merge_tree(entries, TEXT_KEY, "doc_id", keep, runs, fan_in_bits, ("place",)).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that ``exact_groups`` does not keep; all columns stay as they are.

    Of rows that repeat id and text, the one whose row hashes lowest stays.
    """
    tagged = with_text_key(
        docs.select(F.struct("*").alias("row"), null_free(id_column).alias("id"), F.col(text_column).cast("string").alias("text")),
        F.col("text"),
    ).withColumn("text_sha256", F.lower(F.hex("digest")))
    kept = exact_groups(docs, id_column, text_column, **options).where("kept").select(null_free("doc_id").alias("id"), "text_sha256")
    plain = [F.col(f"row.`{f.name}`").cast("string") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return (
        tagged.select("id", "text_sha256", "row")
        .join(kept, ["id", "text_sha256"], "left_semi")
        .groupBy("id", "text_sha256")
        .agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
        .select("row.*")
    )
