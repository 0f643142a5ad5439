"""Weighted statistics in mergeable form."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight, means, and sums of squares and products about the means: what determines a line.
MOMENTS = "struct<w:double,mx:double,my:double,cxx:double,cxy:double>"


def point_moments(x: Column, y: Column, weight: Column) -> Column:
    """Moments of a single point."""
    zero = F.lit(0.0)
    return F.struct(
        weight.cast("double").alias("w"), x.cast("double").alias("mx"), y.cast("double").alias("my"), zero.alias("cxx"), zero.alias("cxy")
    )


def merged_moments(a: Column, b: Column) -> Column:
    """Moments of two sets of points together.

    Means are moved and not summed, so nothing cancels when points lie close together far from zero.
    """
    w = a["w"] + b["w"]
    share = F.when(w == 0, F.lit(0.0)).otherwise(b["w"] / F.when(w != 0, w))
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    cross = a["w"] * share
    return F.struct(
        w.alias("w"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
        (a["cxx"] + b["cxx"] + dx * dx * cross).alias("cxx"), (a["cxy"] + b["cxy"] + dx * dy * cross).alias("cxy"),
    )


def all_moments(parts: Column) -> Column:
    """Moments of an array of moments; of none, all zero."""
    nothing = F.struct(*[F.lit(0.0).alias(name) for name in ("w", "mx", "my", "cxx", "cxy")])
    return F.aggregate(parts, nothing, merged_moments)


def line(total: Column) -> tuple[Column, Column]:
    """(slope, intercept); NULL where no line is determined."""
    slope = F.try_divide(total["cxy"], total["cxx"])
    return slope, total["my"] - slope * total["mx"]


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: Column, name: str) -> DataFrame:
    """Lower weighted median per group: least value whose running weight reaches half the total.

    Equal values are summed before anything is ordered, with map-side combine, so the ordered part
    has one row per distinct value of the group.  For lap times, which come in milliseconds, that
    is at most 1000 rows per second of spread.  ``weight`` is a whole number, so sums and the
    comparison are exact however many rows there are.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.groupBy(*keys, value)
        .agg(F.sum(weight).alias("_w"))
        .withColumn("_cum", F.sum("_w").over(running))
        .withColumn("_total", F.sum("_w").over(group))
        .where(2 * F.col("_cum") >= F.col("_total"))
        .groupBy(*keys)
        .agg(F.min(value).alias(name))
    )
