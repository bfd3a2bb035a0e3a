"""Joins, numbering and nesting that stay balanced when one key holds a large share of the rows.

Three shapes recur in this library: looking something up for every row, numbering the rows of
a group, and nesting the rows of a group into one record. Written naively each of them brings a
whole group to one task. The versions here split large groups along a deterministic function of
the row's own key, so a task that is run again after a lost executor makes the same split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of one key that a single task may take.
SLICE_ROWS = 1_000_000
# A key is sliced if it also holds more than this fraction of all rows. So fewer than 65,536 keys are
# ever listed, whatever the data, and a key that is not holds no more than an even share of 65,536 tasks.
LISTED_SHARE = 1 / 65_536
# Buckets that keys are counted in first; only keys of a bucket that could hold a heavy one are counted themselves.
KEY_BUCKETS = 65_536
# Slices that rows without a key are dealt to.
KEYLESS_SLICES = 4_096
# Neighbouring positions that are numbered or nested together.
SPAN = 10_000


def large_keys(weights: DataFrame, keys: Sequence[str], rows: str, slice_rows: int) -> DataFrame:
    """The heavy keys and the number of slices each is cut into."""
    share = weights.agg((F.sum(rows) * LISTED_SHARE).alias("_share")).scalar()
    return weights.where((F.col(rows) > slice_rows) & (F.col(rows) > share) & F.col(keys[0]).isNotNull()).select(
        *keys, F.ceil(F.col(rows) / slice_rows).cast("int").alias("_slices")
    )


def counted_large_keys(facts: DataFrame, keys: Sequence[str], slice_rows: int) -> DataFrame:
    """``large_keys`` of rows that nobody has counted.

    A heavy key makes its bucket heavy, so keys are counted only in buckets that pass the tests themselves.
    Buckets are few, and where none passes, no key is sent to be counted.
    """
    keys = list(keys)
    held = facts.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("_bucket"))
    buckets = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One window over all buckets, of which there are at most KEY_BUCKETS.
    share = F.greatest(F.sum("_n").over(W.partitionBy(F.lit(0))) * LISTED_SHARE, F.lit(float(slice_rows)))
    full = buckets.withColumn("_least", share).where(F.col("_n") > F.col("_least")).select("_bucket", "_least")
    counts = held.where(F.col(keys[0]).isNotNull()).join(F.broadcast(full), "_bucket").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_least").alias("_least")
    )
    return counts.where(F.col("_rows") > F.col("_least")).select(*keys, F.ceil(F.col("_rows") / slice_rows).cast("int").alias("_slices"))


def balanced_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    row_key: Sequence[str],
    how: str = "left",
    weights: DataFrame | None = None,
    rows: str = "_rows",
    slice_rows: int = SLICE_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup``, which has at most one row per key; ``how`` keeps facts only.

    ``weights`` holds one row per key with its row count in column ``rows``; callers that have a small
    table of these already pass it. Otherwise keys are counted on ``counted``, which has the keys of at
    least as many rows and defaults to the facts. Facts of a heavy key are dealt to slices by a
    hash of ``row_key`` and the one lookup row is repeated per slice. Facts without a key match
    nothing and are dealt out the same way. A ``lookup`` that carries the row counts itself is
    repeated by those, which spares its side the list of heavy keys.
    """
    keys = list(keys)
    if weights is None:
        sliced = F.broadcast(counted_large_keys(facts if counted is None else counted, keys, slice_rows))
    else:
        sliced = F.broadcast(large_keys(weights, keys, rows, slice_rows))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    slices = F.when(no_key, F.lit(KEYLESS_SLICES)).otherwise(F.coalesce("_slices", F.lit(1)))
    dealt = (
        facts.join(sliced, keys, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*row_key), slices).cast("int"))
        .drop("_slices")
    )
    if rows in lookup.columns:
        # A heavy key that is not listed is dealt to slice 0 only, which is always there.
        repeated = lookup.withColumn("_slices", F.greatest(F.ceil(F.col(rows) / slice_rows), F.lit(1)).cast("int"))
    else:
        repeated = lookup.join(sliced, keys, "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))
    repeated = repeated.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return dealt.join(repeated.drop("_slices", rows), [*keys, "_slice"], how).drop("_slice")


def number_rows(
    rows: DataFrame,
    group: str,
    outer: str,
    inner: str,
    ties: Sequence[Column] = (),
    name: str = "item_number",
    outer_span: int = SPAN,
    inner_span: int = SPAN,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Number rows 1..n per ``group`` in the order ``outer``, ``inner``, ``ties``.

    An ordinary group is ranked by one window. A heavy one is ranked inside short runs, each
    ``inner_span`` positions of one ``outer`` value; a run starts at the running sum of the counts
    before it, first over the runs in a block of ``outer_span`` outer values, then over blocks. So
    no window ever takes the rows of a heavy group.
    """
    heavy = F.broadcast(counted_large_keys(rows, [group], slice_rows).withColumnRenamed("_slices", "_heavy"))
    is_heavy = F.col("_heavy").isNotNull()
    cut = (
        rows.join(heavy, group, "left")
        .withColumn("_outer", F.when(is_heavy, F.col(outer)))
        .withColumn("_run", F.when(is_heavy, F.floor(F.col(inner) / inner_span)))
        .drop("_heavy")
    )
    runs = (
        rows.join(heavy, group)
        .groupBy(group, F.col(outer).alias("_outer"), F.floor(F.col(inner) / inner_span).alias("_run"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", F.floor(F.col("_outer") / outer_span))
    )
    blocks = runs.groupBy(group, "_block").agg(F.sum("_n").alias("_n"))
    earlier_runs = W.partitionBy(group, "_block").orderBy("_outer", "_run").rowsBetween(W.unboundedPreceding, -1)
    earlier_blocks = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    block_starts = blocks.select(
        group, "_block", F.coalesce(F.sum("_n").over(earlier_blocks), F.lit(0)).alias("_block_start")
    )
    run_starts = (
        runs.withColumn("_in_block", F.coalesce(F.sum("_n").over(earlier_runs), F.lit(0)))
        .join(block_starts, [group, "_block"])
        .select(group, "_outer", "_run", (F.col("_block_start") + F.col("_in_block")).alias("_start"))
    )
    in_run = W.partitionBy(group, "_outer", "_run").orderBy(outer, inner, *ties)
    return (
        cut.withColumn("_rank", F.row_number().over(in_run))
        .join(run_starts, [group, "_outer", "_run"], "left")
        .withColumn(name, (F.coalesce("_start", F.lit(0)) + F.col("_rank")).cast("bigint"))
        .drop("_outer", "_run", "_rank", "_start")
    )


def nest_rows(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    fields: Sequence[str],
    name: str,
    span: int = SPAN,
) -> DataFrame:
    """Nest rows under their key in the order of ``position``, one array per run of ``span`` positions.

    A key whose positions stay below ``span`` gives one row with ``part_no`` 0, the usual case.
    A longer one continues in further parts, so no record grows with the data.
    """
    element = F.struct(position, *[f for f in fields if f != position])
    return (
        rows.withColumn("part_no", F.floor(F.col(position) / span).cast("bigint"))
        .groupBy(*keys, "part_no")
        .agg(F.array_sort(F.collect_list(element)).alias(name))
    )


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps only n rows per key before its shuffle."""
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
