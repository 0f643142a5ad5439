"""Bucketed laps and weather: the as-of join where they lie, against the shuffling one."""

import random
import re
import uuid
from collections import Counter

import pytest

from lapwise.operators.asof import asof_backward
from lapwise.sources import sliced

LAPS = "Year int, RoundNumber int, Time double, lap long"
SAMPLES = "Year int, RoundNumber int, Time double, seq long, AirTemp double, Rainfall boolean"
FIELDS = ["AirTemp", "Rainfall"]


def stored(spark, tmp_path, laps, samples, buckets=4):
    tables = spark.createDataFrame(laps, LAPS), spark.createDataFrame(samples, SAMPLES)
    return *tables, sliced.store(*tables, f"t_{uuid.uuid4().hex}", str(tmp_path), buckets, FIELDS)


@pytest.fixture
def random_tables():
    draw = random.Random(2)
    laps = [(2020 + draw.randint(0, 1), draw.randint(1, 3), float(draw.randint(0, 9000)), k) for k in range(600)]
    samples = [
        (2020 + draw.randint(0, 1), draw.randint(1, 2), draw.choice([None, float(draw.randint(0, 6000))]), k,
         draw.choice([None, float(k)]), draw.choice([None, True, False]))
        for k in range(120)
    ]
    return laps, samples


def test_same_rows_as_the_shuffling_join(spark, tmp_path, random_tables):
    laps, samples, names = stored(spark, tmp_path, *random_tables)
    wanted = asof_backward(laps, samples, ["Year", "RoundNumber"], "Time", FIELDS, "seq")
    found = sliced.asof_stored(spark, names, FIELDS)
    assert found.columns == wanted.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))
    one = sliced.asof_stored(spark, names, FIELDS, [2021])
    assert Counter(map(tuple, one.collect())) == Counter(tuple(r) for r in wanted.collect() if r["Year"] == 2021)


def test_laps_are_read_once_and_not_shuffled(spark, tmp_path, random_tables):
    _, _, names = stored(spark, tmp_path, *random_tables)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sliced.asof_stored(spark, names, FIELDS, [2021])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert plan.count(f"{names.laps}[") == 1 and plan.count("Bucketed: true") == 2
    assert len(re.findall(r"PartitionFilters: \[[^\]]*Season", plan)) == 2


def test_empty_tables(spark, tmp_path):
    _, _, names = stored(spark, tmp_path / "a", [], [])
    assert sliced.asof_stored(spark, names, FIELDS).count() == 0
    _, _, names = stored(spark, tmp_path / "b", [(2020, 1, 5.0, 1)], [])
    assert [tuple(r) for r in sliced.asof_stored(spark, names, FIELDS).collect()] == [(2020, 1, 5.0, 1, None, None)]
