"""Exact quantiles of any doubles, however many different ones a group has.

Built-in ``percentile`` holds a group's distinct values in one buffer.  Here a group with many rows is
narrowed first: a quantile sketch proposes cut points, rows are counted between and at them, and only the bucket that
holds a wanted rank goes on.  The counts are exact, so the sketch decides how fast ranges shrink and never
the result.  Sketches and counts are mergeable, and of fixed size; a range with at most ``leaf`` rows is ordered whole.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwise.sources.staging import Staging

LEAF_ROWS = 10_000
CUTS = 64
ACCURACY = 10_000

_RANGE = ["g", "lo", "hi"]


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], staging: Staging, leaf: int = LEAF_ROWS
) -> DataFrame:
    """``keys``, ``rows`` and one column for each of ``wanted`` (name to fraction), interpolated between ranks.

    Nulls and NaN are left out and groups without a value are absent; a null key is a group of its own.  ``staging``
    keeps keys and values, ranges, cuts and the rows left between rounds, so it is to be deleted after the result was
    used.  ``df`` is computed once.  Ranges and cuts, being staged, have a size that Spark knows, and are broadcast to the
    rows where they are small.  A range shrinks to about a 64th a round, so a billion rows take three.
    """
    rows = staging.table(
        df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"),
        "rows",
    )
    groups = staging.table(
        rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups"
    )
    place = (F.col("n") - 1) * F.col("w.at")
    targets = groups.select(
        "g", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(q)).alias("at")) for k, q in wanted.items()])).alias("w"),
    ).select(
        "g", "n", "w.name", F.floor(place).alias("low"), F.ceil(place).alias("high"), (place - F.floor(place)).alias("share"),
    )
    ranks = targets.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    state = groups.join(ranks, "g").select(*_RANGE, "n", "rank", F.lit(0).cast("long").alias("below"))
    live, found, k = rows, [], 0
    while True:
        state = staging.table(state, f"ranges{k}")
        found.append(state.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        open_ = state.where("lo < hi")
        found.append(_ordered(_within(live, open_.where(F.col("n") <= leaf)), open_))
        wide = open_.where(F.col("n") > leaf)
        if wide.isEmpty():
            break
        inside = _within(live, wide)
        if k:
            inside = staging.table(inside, f"rows{k}")
            live = inside.select("g", "v")
        state, k = _narrowed(inside, wide, staging, k), k + 1
    values = staging.table(_union(found), "values")
    one = lambda name: values.select("g", F.col("rank").alias(name), F.col("v").alias(f"{name}_v"))
    between = F.when((F.col("share") == 0) | (F.col("low_v") == F.col("high_v")), F.col("low_v")).otherwise(
        F.col("low_v") + (F.col("high_v") - F.col("low_v")) * F.col("share")
    )
    told = targets.join(one("low"), ["g", "low"]).join(one("high"), ["g", "high"])
    return told.groupBy("g", "n").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in wanted]).select(
        *[F.col(f"g.`{c}`") for c in keys], F.col("n").alias("rows"), *wanted
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _within(live: DataFrame, state: DataFrame) -> DataFrame:
    """Rows in the ranges.  Ranges of a group do not overlap, so a row is in one at most."""
    ranges = state.select(*_RANGE).distinct()
    return live.join(ranges, "g").where("v BETWEEN lo AND hi").select(*_RANGE, "v")


def _ordered(inside: DataFrame, state: DataFrame) -> DataFrame:
    """The wanted ranks of small ranges."""
    lists = inside.groupBy(*_RANGE).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return state.join(lists, _RANGE).select(
        "g", "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")
    )


def _narrowed(inside: DataFrame, state: DataFrame, staging: Staging, k: int) -> DataFrame:
    """For every wanted rank the bucket that holds it: between two cuts, or all rows equal to one."""
    cuts = staging.table(
        inside.groupBy(*_RANGE).agg(
            F.array_distinct(F.percentile_approx("v", [j / CUTS for j in range(1, CUTS)], ACCURACY)).alias("cuts")
        ),
        f"cuts{k}",
    )
    # Odd for a row at a cut, even for one between cuts.
    at = lambda test: F.size(F.filter("cuts", test))
    bucket = at(lambda c: c < F.col("v")) + at(lambda c: c <= F.col("v"))
    counted = inside.join(cuts, _RANGE).groupBy(*_RANGE, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    before = Window.partitionBy(*_RANGE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = counted.withColumn("skip", F.sum("m").over(before) - F.col("m"))
    rank = F.col("rank") - F.col("below")
    return state.join(buckets, _RANGE).where((rank >= F.col("skip")) & (rank < F.col("skip") + F.col("m"))).select(
        "g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("m").alias("n"), "rank",
        (F.col("below") + F.col("skip")).alias("below"),
    )
