"""Laps and weather stored together for the as-of join: bucketed and sorted by session and time slice.

``store`` writes two bucketed tables once.  The laps keep their rows.  The weather becomes one row per cell, a
session's time slice with laps in it: its samples in order, led by the last one of an earlier slice.  As both have
the same buckets, ``asof_stored`` joins them where they lie: laps are read once, nothing of theirs is shuffled,
and a lap looks up its sample in its cell's list, which holds a slice's distinct sample times (a sample a minute in
practice; narrower slices for denser ones).

A cell with very many laps is in one bucket; ``operators.asof`` divides such cells, at the price of a shuffle, and is
what jobs over tables that are read once should use.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwise import schemas

SLICE_SECONDS = 900.0
CELL = [*schemas.SESSION, "Slice"]


@dataclass(frozen=True)
class Sliced:
    """Names of the two tables."""

    laps: str
    cells: str


def _bucketed(df: DataFrame, name: str, path: str, buckets: int, order: Sequence[str]) -> None:
    """One file per bucket and season, as each bucket is written by one task.

    The season is a folder, so that filters on it choose files; the year itself stays in the rows, as buckets need it.
    """
    (
        df.withColumn("Season", F.col("Year")).repartition(buckets, *CELL)
        .write.mode("overwrite").partitionBy("Season").bucketBy(buckets, *CELL).sortBy(*CELL, *order)
        .option("path", path).saveAsTable(name)
    )


def _slice(time: str) -> Column:
    return F.floor(F.col(time) / F.lit(SLICE_SECONDS)).cast("long")


def store(
    laps: DataFrame, weather: DataFrame, name: str, folder: str, buckets: int,
    fields: Sequence[str] = schemas.WEATHER_FIELDS,
) -> Sliced:
    """Stores both tables as ``<name>_laps`` and ``<name>_cells`` under ``folder``.

    Buckets should be about as many as the cores that will read them, or a multiple.
    """
    spark = laps.sparkSession
    stored = Sliced(f"{name}_laps", f"{name}_cells")
    _bucketed(laps.withColumn("Slice", _slice("Time")), stored.laps, f"{folder}/laps", buckets, ["Time"])

    samples = (
        weather.where(F.col("Time").isNotNull()).withColumn("Slice", _slice("Time"))
        .groupBy(*CELL, F.col("Time").alias("at")).agg(F.max(F.struct("seq", *fields)).alias("_last"))
    )
    sample = F.struct("at", *[F.col(f"_last.{f}").alias(f) for f in fields])
    lists = samples.groupBy(*CELL).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    # The buckets are the grouping: finding the cells shuffles no laps.
    wanted = spark.table(stored.laps).groupBy(*CELL).agg(F.count(F.lit(1)).alias("laps"))
    told = lists.join(wanted, CELL, "full")
    before = Window.partitionBy(*schemas.SESSION).orderBy("Slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last(F.get("samples", F.size("samples") - 1), ignorenulls=True).over(before)
    cells = told.withColumn("earlier", earlier).where(F.col("laps").isNotNull()).select(
        *CELL, F.concat(
            F.filter(F.array("earlier"), lambda s: s.isNotNull()),
            F.coalesce("samples", F.slice(F.array("earlier"), 1, 0)),
        ).alias("samples"),
    )
    _bucketed(cells, stored.cells, f"{folder}/cells", buckets, [])
    return stored


def asof_stored(
    spark: SparkSession, stored: Sliced, fields: Sequence[str] = schemas.WEATHER_FIELDS,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Stored laps, of the given ``years``, each with ``fields`` of the last sample at or before its time.

    The result of ``operators.asof.asof_backward``, without its shuffle.
    """
    laps, cells = spark.table(stored.laps), spark.table(stored.cells)
    if years is not None:
        laps, cells = (df.where(F.col("Season").isin(list(years))) for df in (laps, cells))
    columns = [c for c in laps.columns if c not in ("Slice", "Season")]
    known = F.filter("samples", lambda s: s["at"] <= F.col("Time"))
    joined = laps.join(cells.drop("Season"), CELL, "left").withColumn("_known", known)
    last = F.get("_known", F.size("_known") - 1)
    return joined.withColumn("_last", last).select(*columns, *[F.col(f"_last.{f}").alias(f) for f in fields])
