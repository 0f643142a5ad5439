import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapwise.operators.asof import asof_backward

LEFT = "Year int, Time double, id long"
RIGHT = "Year int, Time double, seq long, temp double, rain boolean"


def join(spark, left, right, **options):
    df = asof_backward(
        spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT),
        by=["Year"], on="Time", fields=["temp", "rain"], tie="seq", **options,
    )
    return {row["id"]: (row["temp"], row["rain"]) for row in df.collect()}


def test_exact_match_duplicates_nulls_and_misses(spark):
    right = [
        (1, 10.0, 1, 20.0, False),
        (1, 20.0, 2, 21.0, False),
        (1, 20.0, 3, 22.0, True),   # same time: the later one wins
        (1, 30.0, 4, None, True),   # a null field in the matched row stays null
        (2, 0.0, 5, 9.0, False),
    ]
    left = [(1, 5.0, 0), (1, 10.0, 1), (1, 19.9, 2), (1, 20.0, 3), (1, 35.0, 4), (3, 1.0, 5), (1, None, 6)]
    found = join(spark, left, right)
    assert found == {
        0: (None, None), 1: (20.0, False), 2: (20.0, False), 3: (22.0, True), 4: (None, True),
        5: (None, None), 6: (None, None),
    }


@pytest.mark.parametrize("width,hot", [(3600.0, 5_000_000), (7.0, 3), (50.0, 10), (0.5, 1)])
def test_agrees_with_sorted_merge_whatever_the_slices_and_splits(spark, width, hot):
    rng = random.Random(5)
    left = [(rng.choice([1, 1, 1, 2]), float(rng.randrange(0, 400)), i) for i in range(400)]
    left += [(1, 123.0, 400 + i) for i in range(200)]  # one moment holds a third of all rows
    right = [
        (rng.choice([1, 2]), float(rng.randrange(20, 400)), i, rng.choice([None, rng.random()]), bool(i % 2))
        for i in range(120)
    ]
    found = join(spark, left, right, slice_width=width, hot_rows=hot)
    frame = pd.DataFrame(right, columns=["Year", "Time", "seq", "temp", "rain"]).sort_values(["Time", "seq"])
    wanted = pd.merge_asof(
        pd.DataFrame(left, columns=["Year", "Time", "id"]).sort_values("Time"), frame, on="Time", by="Year"
    )
    expected = {
        int(r.id): (None if pd.isna(r.temp) else r.temp, None if pd.isna(r.rain) else bool(r.rain))
        for r in wanted.itertuples()
    }
    assert found == expected


def task_sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]


def test_hot_slice_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(
        F.lit(1).alias("Year"), F.lit(5.0).alias("Time"), F.col("id")
    ).repartition(16)
    weather = spark.createDataFrame([(1, 1.0, 1, 20.0, True)], RIGHT)
    df = asof_backward(rows, weather, ["Year"], "Time", ["temp", "rain"], "seq", hot_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test data is tiny
    try:
        sizes = task_sizes(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000
    assert len(sizes) >= 3 and max(sizes) < 14_000


def test_a_hot_weather_slice_collapses_to_its_distinct_times(spark):
    """Very many samples in one slice are one row per millisecond before they are shuffled to it."""
    samples = spark.range(200_000).selectExpr(
        "1 AS k", "round(100 + id % 300 / 1000D, 3) AS t", "id AS seq", "id AS v"
    )
    laps = spark.createDataFrame([(1, 100.0), (1, 100.15), (1, 99.9), (1, 5000.0)], "k int, t double")
    joined = asof_backward(laps, samples, by=["k"], on="t", fields=["v"], tie="seq")
    told = {r["t"]: r["v"] for r in joined.collect()}
    last = {m: max(i for i in range(200_000 - 300, 200_000) if i % 300 == m) for m in (0, 150, 299)}
    assert told == {100.0: last[0], 100.15: last[150], 99.9: None, 5000.0: last[299]}
