import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwise.functions.weighted import all_moments, line, merged_moments, point_moments, weighted_median
from lapwise.plans import degradation, history
from lapwise.sources import dims

COUNTS = (
    "Year int, EventName string, Driver string, Team string, Compound string, Stint double,"
    " TyreLife double, LapTimeSeconds double, IsWet int, n long"
)
PROFILE = (
    "target_id long, target_year int, target_round int, driver string, team string, level string,"
    " track_length_km double, wet_experience_km double, track_type string"
)
SLICE = "target_year int, target_round int, target_event string, Year int, EventName string, weight double, source string"
TRACKS = "name string, track_type string, length_km double"


def lap(event="E1", driver="A", team="T", compound="SOFT", stint=1.0, life=1.0, time=90.0, n=1):
    return (2024, event, driver, team, compound, stint, life, time, 0, n)


def models(spark, laps, weights={"E1": 3.0}, level="driver", wet_km=0.0, strict=False, driver="A", team="T", kinds={}):
    counts = spark.createDataFrame(laps, COUNTS)
    profiles = spark.createDataFrame([(1, 2024, 9, driver, team, level, 5.0, wet_km, "Medium")], PROFILE)
    slices = spark.createDataFrame([(2024, 9, "E9", 2024, e, w, "s") for e, w in weights.items()], SLICE)
    tracks = spark.createDataFrame([("E9", "Medium", 5.0), *[(e, k, 5.0) for e, k in kinds.items()]], TRACKS)
    scoped = degradation.scoped_slices(profiles, slices, tracks)
    lines = degradation.fit_lines(degradation.tyre_age_sums(counts, tracks), scoped, strict)
    medians = degradation.fresh_laps(degradation.lap_time_counts(counts, tracks), scoped, lines)
    return {r["Compound"]: r for r in degradation.compound_models(profiles, lines, medians).collect()}


@pytest.mark.parametrize("summed", [degradation.tyre_age_sums, degradation.lap_time_counts])
def test_rows_are_shuffled_before_they_are_multiplied(spark, summed):
    draw = random.Random(2)
    laps = [
        lap(f"E{draw.randrange(3)}", draw.choice("ABC"), draw.choice("TU"), "SOFT", float(draw.randrange(3)), float(draw.randrange(9)),
            90.0 + draw.randrange(40) / 8, draw.randint(1, 4))
        for _ in range(300)
    ]
    counts = spark.createDataFrame(laps, COUNTS).distinct()
    out = summed(counts, spark.createDataFrame([("E1", "Fast", 4.0)], TRACKS))
    total = {r["level"]: r["n"] for r in out.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert set(total) == {"driver", "team", "all"} and set(total.values()) == {counts.agg(F.sum("n")).first()[0]}
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate inline")[0]
    assert "HashAggregate" in above and "Exchange hashpartitioning" not in above.split("HashAggregate", 1)[1]


def test_weights_multiply_residuals(spark):
    times = {"E1": [90.0, 90.4, 91.5], "E2": [90.0, 90.9, 91.0]}
    weights = {"E1": 3.0, "E2": 1.0}
    laps = [lap(event=e, life=float(3 + 4 * i), time=t) for e, ts in times.items() for i, t in enumerate(ts)]
    found = models(spark, laps, weights)["SOFT"]
    x = [5.0 * (3 + 4 * i) for _ in times for i in range(3)]
    y = [t - min(ts) for ts in times.values() for t in ts]
    w = [weights[e] for e in times for _ in range(3)]
    slope, intercept = np.polyfit(x, y, 1, w=w)
    assert found["slope_sec_per_km"] == pytest.approx(slope, abs=1e-9)
    assert found["intercept_sec"] == pytest.approx(max(0.0, intercept), abs=1e-9)


@pytest.mark.parametrize("far", [0.0, 1e6, -1e7])
def test_lines_of_points_far_from_zero(spark, far):
    """Ages that lie close together, far from zero: raw sums lose the slope there."""
    draw = random.Random(3)
    rows = [(k % 2, far + draw.random(), 5.0 + draw.random(), draw.choice([1.0, 2.5, 3.0])) for k in range(60)]
    table = spark.createDataFrame(rows, "half int, x double, y double, w double")
    points = F.collect_list(point_moments(F.col("x"), F.col("y"), F.col("w")))
    halves = table.groupBy("half").agg(points.alias("points")).select(all_moments(F.col("points")).alias("m"))
    # Merged from both halves, and from their own points.
    both = halves.agg(F.collect_list("m").alias("m")).select(merged_moments(F.get("m", F.lit(0)), F.get("m", F.lit(1))).alias("m"))
    whole = table.agg(points.alias("points")).select(all_moments(F.col("points")).alias("m"))
    x, y, w = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    slope, intercept = np.polyfit(x - far, y, 1, w=np.sqrt(w))
    for found in (both, whole):
        got = found.select(*line(F.col("m"))).first()
        # Numbers near ``far`` are a ten-millionth of a billionth of it apart: that much of an age is lost before any sum.
        assert got[0] == pytest.approx(slope, rel=1e-9 + abs(far) * 1e-14)
        assert got[1] + got[0] * far == pytest.approx(intercept, rel=1e-6)


def test_no_line_through_one_age_or_none(spark):
    table = spark.range(1).select(
        all_moments(F.array(*[point_moments(F.lit(3.0), F.lit(float(k)), F.lit(1.0)) for k in range(3)])).alias("one"),
        all_moments(F.filter(F.array(point_moments(F.lit(1.0), F.lit(1.0), F.lit(1.0))), lambda _: F.lit(False))).alias("none"),
    )
    assert [table.select(line(F.col(c))[0]).first()[0] for c in ("one", "none")] == [None, None]


def test_few_rows_or_one_tyre_age_take_the_default_slope(spark):
    few = models(spark, [lap(life=float(i), time=90.0 + i) for i in range(1, 6)])["SOFT"]
    flat = models(spark, [lap(life=4.0, time=90.0 + i) for i in range(8)])["SOFT"]
    assert few["slope_sec_per_km"] == flat["slope_sec_per_km"] == 0.03
    assert few["intercept_sec"] == 0.0 and flat["window_km"] == 20.0


def test_laps_without_a_stint_count_but_do_not_fit(spark):
    laps = [lap(life=float(i), time=90.0 + 0.1 * i) for i in range(1, 8)]
    with_gap = [*laps, lap(life=40.0, time=99.0, stint=None)]
    plain, gap = models(spark, laps)["SOFT"], models(spark, with_gap)["SOFT"]
    assert gap["slope_sec_per_km"] == pytest.approx(plain["slope_sec_per_km"])
    assert gap["sample_size"] == plain["sample_size"] + 1
    strict = models(spark, with_gap, strict=True)["SOFT"]
    assert strict["slope_sec_per_km"] == 0.0 and strict["intercept_sec"] == 0.0
    ages = [5.0 * life for life in [*range(1, 8), 40]]
    assert strict["window_km"] == pytest.approx(np.quantile(ages, 0.75))


def test_scope_is_chosen_before_compounds(spark):
    laps = [lap(), lap(driver="B", compound="HARD")]
    assert set(models(spark, laps)) == {"SOFT"}
    assert set(models(spark, laps, level="team", driver="Z")) == {"SOFT", "HARD"}


def test_same_kind_of_track_needs_twelve_rows(spark):
    def mixed(count):
        near = [lap(life=float(i + 1), time=90.0 + 0.1 * i) for i in range(count)]
        far = [lap(event="E2", life=float(i + 1), time=95.0 + i) for i in range(20)]
        return models(spark, near + far, {"E1": 1.0, "E2": 1.0}, kinds={"E2": "High"})["SOFT"]

    assert mixed(12)["sample_size"] == 12.0
    assert mixed(11)["sample_size"] == 31.0


def test_wet_experience_slows_wear_up_to_a_fifth(spark):
    laps = [lap(compound=c, life=float(i), time=90.0 + 0.1 * i) for c in ("WET", "SOFT") for i in range(1, 9)]
    dry = models(spark, laps)
    assert models(spark, laps, wet_km=100.0)["WET"]["slope_sec_per_km"] == pytest.approx(
        dry["WET"]["slope_sec_per_km"] * 0.95
    )
    soaked = models(spark, laps, wet_km=9000.0)
    assert soaked["WET"]["slope_sec_per_km"] == pytest.approx(dry["WET"]["slope_sec_per_km"] * 0.8)
    assert soaked["SOFT"]["slope_sec_per_km"] == dry["SOFT"]["slope_sec_per_km"]


def test_fresh_laps_are_preferred(spark):
    laps = [lap(life=1.0, time=92.0), lap(life=2.0, time=93.0), lap(life=9.0, time=80.0)]
    assert models(spark, laps)["SOFT"]["fresh_lap_time_sec"] == 92.0
    assert models(spark, [lap(life=9.0, time=80.0)])["SOFT"]["fresh_lap_time_sec"] == 80.0


@pytest.mark.parametrize("rows,expected", [
    ([(1.0, 10), (2.0, 10), (3.0, 10), (4.0, 10)], 2.0),
    ([(1.0, 10), (2.0, 90), (3.0, 10)], 2.0),
    ([(7.0, 5)], 7.0),
    ([(1.0, 12)] * 3 + [(2.0, 12)] * 3, 1.0),
    ([(1.0, 3_000_000_000), (2.0, 3_000_000_001), (3.0, 0)], 2.0),
    ([(1.0, 3_000_000_001), (2.0, 3_000_000_000), (3.0, 0)], 1.0),
])
def test_lower_weighted_median(spark, rows, expected):
    df = spark.createDataFrame([("k", v, w) for v, w in rows], "k string, v double, w long")
    assert weighted_median(df, ["k"], "v", F.col("w"), "m").collect()[0]["m"] == expected


def test_agrees_with_a_lap_by_lap_restatement(spark):
    rng = random.Random(11)
    events = {"E1": ("Medium", 3.0), "E2": ("High", 2.5), "E3": ("Medium", 1.0)}
    laps = [
        lap(event=e, driver=rng.choice("AB"), compound=rng.choice(dims.VALID_COMPOUNDS),
            stint=float(rng.choice([1, 2])), life=float(rng.randrange(1, 30)),
            time=round(90 + rng.random() * 5, 3), n=rng.choice([1, 1, 2]))
        for e in events for _ in range(120)
    ]
    found = models(spark, laps, {e: w for e, (_, w) in events.items()}, kinds={"E2": "High"})
    rows = [l for l in laps if l[2] == "A" for _ in range(l[9])]
    for compound, model in found.items():
        mine = [r for r in rows if r[4] == compound]
        near = [r for r in mine if events[r[1]][0] == "Medium"]
        used = near if len(near) >= 12 else mine
        best = {}
        for r in rows:
            key = (r[1], r[4], r[5])
            best[key] = min(best.get(key, 1e9), r[7])
        x = np.array([r[6] * 5.0 for r in used])
        y = np.array([r[7] - best[(r[1], r[4], r[5])] for r in used])
        w = np.array([events[r[1]][1] for r in used])
        slope = max(0.0, np.polyfit(x, y, 1, w=w)[0])
        assert model["slope_sec_per_km"] == pytest.approx(slope, abs=1e-9)
        window = 1.2 / slope if slope > 1e-6 else np.quantile(x, 0.75)
        window = min(window, np.quantile(x, 0.9))
        assert model["window_km"] == pytest.approx(window)
        assert model["window_laps"] == max(1, round(window / 5.0))
        fresh = [r for r in used if r[6] <= 2] or used
        order = sorted((r[7], events[r[1]][1]) for r in fresh)
        total, running = sum(o[1] for o in order), np.cumsum([o[1] for o in order])
        assert model["fresh_lap_time_sec"] == order[int(np.searchsorted(running, total / 2))][0]


def test_overstay_adds_up(spark):
    model = spark.createDataFrame([(1, "SOFT", 0.01)], "target_id long, Compound string, slope_sec_per_km double")
    profile = spark.createDataFrame([(1, 5.0)], "target_id long, track_length_km double")
    rows = degradation.overstay_table(model, profile).orderBy("extra_lap").collect()
    assert [r["incremental_delta_sec"] for r in rows[:3]] == [0.05, 0.1, 0.15]
    assert [r["cumulative_delta_sec"] for r in rows] == [round(0.05 * k * (k + 1) / 2, 3) for k in range(1, 11)]


def test_counts_keep_every_lap(spark):
    columns = "Year int, EventName string, Driver string, Team string, Compound string, Stint double, TyreLife double, LapTimeSeconds double, IsWet int"
    rows = [(2024, "E1", "A", "T", "WET", 1.0, 1.0, 90.0, 1)] * 5 + [
        (2024, "E1", "A", "T", "SOFT", None, 1.0, 91.0, 0)
    ]
    counts = history.count_laps(spark.createDataFrame(rows, columns))
    assert sorted(r["n"] for r in counts.collect()) == [1, 5]
    entrant = history.entrant_counts(counts, spark.createDataFrame([("E1", "Low", 4.0)], TRACKS)).collect()[0]
    assert (entrant["n"], entrant["n_wet"], entrant["wet_km"]) == (6, 5, 20.0)
