"""Exact quantiles against numpy, through every kind of range."""

import random

import numpy as np
import pytest

from lapwise.functions.selection import exact_quantiles
from lapwise.sources.staging import Staging

WANTED = {"least": 0.0, "tenth": 0.1, "mid": 0.5, "high": 0.937, "most": 1.0}


def groups():
    draw = random.Random(4)
    return {
        ("a", 1): [draw.gauss(90, 3) for _ in range(4000)],
        ("a", None): [draw.choice([1.5, 1.5, 1.5, draw.random()]) for _ in range(1500)],
        ("b", 1): [7.25] * 900,
        ("b", 2): [draw.uniform(-1, 1) * 10.0 ** draw.randint(-300, 300) for _ in range(1200)],
        (None, None): [3.0],
        ("c", 1): [1.0, float("inf"), -2.0, 0.0, -0.0],
        ("d", 1): [90 + 2.0**-40 * draw.randint(0, 5000) for _ in range(2000)],
    }


@pytest.mark.parametrize("leaf", [0, 40, 10_000])
def test_quantiles_like_numpy(spark, tmp_path, leaf):
    given = groups()
    rows = [(*g, v) for g, vs in given.items() for v in vs] + [("a", 1, None), ("b", 1, float("nan")), ("e", 1, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "`team.name` string, n int, pace double").repartition(4)
    df = df.withColumnRenamed("team.name", "team")
    with Staging(spark, str(tmp_path / "staged")) as staging:
        out = {(r.team, r.n): r for r in exact_quantiles(df, ["team", "n"], "pace", WANTED, staging, leaf).collect()}
    assert set(out) == set(given)
    for g, vs in given.items():
        assert out[g].rows == len(vs)
        ordered = np.sort(np.array(vs))
        for name, q in WANTED.items():
            at = (len(vs) - 1) * q
            a, b = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = a if a == b else a + (b - a) * (at - np.floor(at))
            assert out[g][name] == pytest.approx(want, rel=1e-15), (g, name)


def test_no_rows(spark, tmp_path):
    with Staging(spark, str(tmp_path / "staged")) as staging:
        df = spark.createDataFrame([], "k int, v double")
        out = exact_quantiles(df, ["k"], "v", {"mid": 0.5}, staging)
        assert out.columns == ["k", "rows", "mid"] and out.count() == 0


def test_input_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(5000, numPartitions=3).selectExpr("id % 3 AS g", "sqrt(id) AS v")
    df = df.mapInArrow(counted, df.schema)
    with Staging(spark, str(tmp_path / "staged")) as staging:
        out = {r.g: r.mid for r in exact_quantiles(df, ["g"], "v", {"mid": 0.5}, staging, 40).collect()}
    assert out == {g: np.quantile(np.sqrt(np.arange(g, 5000, 3)), 0.5) for g in range(3)}
    assert seen.value == 5000
