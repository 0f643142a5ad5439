"""Backward as-of join.

A plain window per session would put a session that holds a third of all rows into one task.
Here a session is cut into time slices:

1. right rows with equal times collapse to the last one (map-side combine);
2. left rows are counted per slice, and the last right row before each slice that has left rows
   is carried into it (one row per slice, so this window is short);
3. left rows, right rows and carried rows meet in one shuffle on (key, slice, split), and the last
   right row is filled forward.

A slice with more than ``hot_rows`` left rows is divided into splits; its right rows are copied to
each.  The list of such slices holds at most rows / ``hot_rows`` entries, so it can be broadcast.
Right rows of a slice are as many as its distinct times.  Times are held to milliseconds at ingest, so
that is at most a thousand times its width, however many samples a session has.  The left side is shuffled once, and read once more, by three columns, for the count.  No
pairs are formed.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS_FOR_UNTIMED = 997


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    fields: Sequence[str],
    tie: str,
    slice_width: float = 900.0,
    hot_rows: int = 5_000_000,
) -> DataFrame:
    """Left rows, each with ``fields`` of the last right row at or before its time.

    The right row is taken whole, so a NULL field in it stays NULL.  Equal times are decided by
    the greatest ``tie``.  Left rows without a time or without an earlier right row get NULLs.
    ``slice_width`` is in units of ``on``.
    """
    by, fields = list(by), list(fields)
    left_columns = left.columns
    # The slice leads: sorting compares it first, and it tells rows apart best.
    cell = ["_slice", *by]
    slice_of = F.floor(F.col(on) / F.lit(float(slice_width))).cast("long")
    timed = F.col(on).isNotNull()
    for key in by:
        timed = timed & F.col(key).isNotNull()

    points = (
        right.where(timed)
        .groupBy(*by, slice_of.alias("_slice"), F.col(on).alias("_at"))
        .agg(F.max(F.struct(F.col(tie), *fields)).alias("_last"))
        .select(*cell, "_at", F.struct(*[F.col(f"_last.{f}") for f in fields]).alias("_point"))
    )

    # Keys that cannot be null keep both uses of this count one and the same exchange.
    load = (
        left.where(timed)
        .groupBy(*by, F.coalesce(slice_of, F.lit(0)).alias("_slice"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*cell, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("long").alias("_splits"))
    )
    hot = F.broadcast(
        load.where(F.col("_splits") > 1).select(*[F.col(c).alias(f"_hot_{c}") for c in cell], "_splits")
    )

    def with_splits(df: DataFrame) -> DataFrame:
        match = [F.col(c) == F.col(f"_hot_{c}") for c in cell]
        joined = df.join(hot, match, "left").drop(*[f"_hot_{c}" for c in cell])
        return joined.withColumn("_splits", F.coalesce("_splits", F.lit(1)))

    # Last right row of every slice, seen from the later slices that have left rows.
    ends = points.groupBy(*cell).agg(F.max_by("_point", "_at").alias("_point"))
    marks = load.withColumn("_end", F.lit(0)).unionByName(
        ends.withColumn("_end", F.lit(1)), allowMissingColumns=True
    )
    earlier = Window.partitionBy(*by).orderBy("_slice", "_end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = (
        marks.withColumn("_point", F.last("_point", ignorenulls=True).over(earlier))
        .where((F.col("_end") == 0) & F.col("_point").isNotNull())
        .select(*cell, F.lit(None).cast("double").alias("_at"), "_point", "_splits")
    )

    # Same split when a task is run again: the hash is of the time and the task's own partition.
    # The partition number keeps copies with equal times from all meeting in one split.
    spread = F.xxhash64(F.col(on), F.spark_partition_id())
    rows = (
        with_splits(left.withColumn("_slice", slice_of))
        .withColumn(
            "_split",
            F.pmod(spread, F.when(F.col(on).isNull(), F.lit(SPLITS_FOR_UNTIMED)).otherwise(F.col("_splits"))),
        )
        .drop("_splits")
        .withColumn("_at", F.col(on).cast("double"))
        .withColumn("_side", F.lit(1))
    )
    known = (
        with_splits(points)
        .unionByName(carried)
        .withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - F.lit(1))))
        .select(*cell, "_split", F.col("_at").cast("double").alias("_at"), "_point")
        .withColumn("_side", F.lit(0))
    )
    forward = (
        Window.partitionBy(*cell, "_split")
        .orderBy(F.col("_at").asc_nulls_first(), "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(known, allowMissingColumns=True)
        .withColumn("_point", F.last("_point", ignorenulls=True).over(forward))
        .where(F.col("_side") == 1)
        .select(*left_columns, *[F.col(f"_point.{f}").alias(f) for f in fields])
    )
