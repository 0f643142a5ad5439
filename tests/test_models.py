import time

import pytest
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.plans import scoring, training
from lapwise.sources import dims

FEATURES = (
    "Year int, RoundNumber int, Driver string, Team string, Compound string, TrackType string, LapNumber double,"
    " TyreLife double, TyreLifeKM double, Stint double, IsWet int, AirTemp double, TrackTemp double,"
    " Humidity double, Rainfall int, TeamBaselinePace double, FieldBaselinePace double, RelativePace double,"
    " LapTimeSeconds double"
)


def feature_rows(spark, count):
    rows = [
        (2024, 1 + i % 5, f"D{i % 7}", ["Ferrari", "Haas"][i % 2], ["SOFT", "HARD"][i % 2], "Medium",
         float(i % 60), float(1 + i % 25), 5.0 * (1 + i % 25), 1.0, 0, 25.0, 35.0, 50.0, 0, 90.0, 91.0, -1.0,
         90.0 + 0.1 * (1 + i % 25) + i % 2)
        for i in range(count)
    ]
    return spark.createDataFrame(rows, FEATURES)


@pytest.fixture(scope="module")
def fitted(spark):
    return training.fit_lap_times(feature_rows(spark, 400), iterations=5)


def test_split_ignores_partitioning(spark):
    df = feature_rows(spark, 3000)
    keys = [*training.NATURAL_KEY, "TyreLife"]
    one = training.split_train_test(df.repartition(3), keys)
    two = training.split_train_test(df.repartition(7, "Driver"), keys)
    assert one.exceptAll(two).count() == 0
    assert 0.1 < one.where("is_test").count() / 3000 < 0.3
    assert one.where("is_test and is_validation").count() == 0


def test_fit_beats_the_median_and_counts_features(spark, fitted):
    assert fitted.rows == 400
    assert fitted.features == len(schemas.NUMERIC) + 7 + 2 + 2 + 1
    assert fitted.rmse < 0.9


def test_few_rows_fit_without_an_error_measure(spark):
    fit = training.fit_lap_times(feature_rows(spark, 40), iterations=2)
    assert fit.rows == 40 and fit.rmse is None
    assert training.fit_lap_times(feature_rows(spark, 400).where("Year < 0")) is None


def test_saved_model_scores_unseen_categories_and_defaults(spark, fitted, tmp_path):
    training.save_model(fitted.model, str(tmp_path / "model"))
    model = training.load_model(str(tmp_path / "model"))
    laps = spark.createDataFrame(
        [(15.0, 5.0, "SOFT", 1.0, "Ferrari", "D1", "Suzuka Circuit"), (15.0, 5.0, "ODD", 1.0, "New", "D99", "X")],
        "lap_number double, tyre_life_laps double, compound string, stint double, team string, driver string, track_name string",
    )
    args = (laps, dims.team_names(spark), dims.circuits(spark))
    scored = scoring.score_laps(model, *args).collect()
    assert len(scored) == 2 and all(80 < r["prediction"] < 110 for r in scored)
    assert {r["TeamBaselinePace"] for r in scored} == {100.0} and {r["AirTemp"] for r in scored} == {30.0}
    unseen = model.transform(scoring.scoring_features(*args)).where("Driver = 'D99'").select("DriverVector", "TrackTypeVector").collect()[0]
    assert unseen["DriverVector"].numNonzeros() == 0
    with pytest.raises(FileNotFoundError):
        training.load_model(str(tmp_path / "none"))


def test_a_model_is_replaced_only_by_a_whole_one(spark, fitted, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    training.save_model(fitted.model, path)
    uid = training.load_model(path).uid
    other = training.fit_lap_times(feature_rows(spark, 60), iterations=1).model
    write = other.write().save

    def stopped(where):
        write(where)
        raise RuntimeError("stopped before it was published")

    with monkeypatch.context() as patch:
        patch.setattr(type(other), "write", lambda self: type("Writer", (), {"save": staticmethod(stopped)}))
        with pytest.raises(RuntimeError):
            training.save_model(other, path)
    assert training.load_model(path).uid == uid
    for model in (other, fitted.model, other):
        training.save_model(model, path)
        assert training.load_model(path).uid == model.uid
    assert len(list((tmp_path / "model" / "published").glob("[0-9]*"))) == 2


def test_eras_are_fit_side_by_side(spark, tmp_path):
    """Stages of one era start before those of the other have ended; results are those of fits one by one."""
    rows = feature_rows(spark, 400)
    eras = rows.withColumn("era", F.lit("a")).unionByName(rows.where("LapNumber < 40").withColumn("era", F.lit("b")))
    coverage = spark.createDataFrame(
        [(e, 2022, 2025, "has_data", 1, ["x"], ["y"]) for e in "abc"],
        "era string, start_year int, end_year int, status string, rows long, loaded_events array<string>, failed_events array<string>",
    )
    pools, at_once, most = set(), [], []
    fit = training.fit_lap_times

    def watched(features, *args, **options):
        pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        at_once.append(1)
        most.append(len(at_once))
        time.sleep(1)
        try:
            return fit(features, *args, **options)
        finally:
            at_once.pop()

    training.fit_lap_times = watched
    try:
        runs = training.train_eras(spark, eras, coverage, "2024-01-01", str(tmp_path), iterations=2).collect()
    finally:
        training.fit_lap_times = fit
    assert pools == {"a", "b", "c"} and max(most) > 1
    told = {r["era"]: (r["status"], r["rows"], r["rmse"]) for r in runs}
    alone = fit(eras.where("era = 'b'"), iterations=2)
    assert told["b"] == ("trained", alone.rows, pytest.approx(alone.rmse, abs=1e-9)) and told["c"][0] == "no_data"


def test_laps_that_lack_an_input_are_predicted_as_if_it_were_the_median(spark, fitted):
    laps = spark.createDataFrame(
        [(1, 15.0, 5.0, None, "Ferrari"), (2, None, None, 1, "Ferrari"), (3, 15.0, 5.0, 1, None), (4, 15.0, 5.0, 1, "Ferrari")],
        "id int, lap_number double, tyre_life_laps double, stint int, team string",
    ).selectExpr("*", "'SOFT' AS compound", "'D1' AS driver", "'X' AS track_name")
    args = (dims.team_names(spark), dims.circuits(spark))
    told = {r["id"]: r for r in scoring.score_laps(fitted.model, laps, *args).collect()}
    assert {k: (r["missing"], r["LapNumber"]) for k, r in told.items()} == {
        1: ("Stint", 15.0), 2: ("LapNumber,TyreLife,TyreLifeKM", None), 3: ("", 15.0), 4: ("", 15.0),
    }
    assert told[1]["prediction"] == told[4]["prediction"]  # every training lap has stint 1
    medians = fitted.model.stages[2].surrogateDF.first().asDict()
    # Rows 0 to 399 of the fixture, less the test laps: ages spread over 1 to 25 laps.
    assert 11 <= medians["TyreLife"] <= 15 and medians["TyreLifeKM"] == 5.0 * medians["TyreLife"]
    full = scoring.scoring_features(laps.where("id = 4"), *args).drop("LapNumber", "TyreLife", "TyreLifeKM")
    by_hand = full.selectExpr("*", *[f"{medians[c]}D AS {c}" for c in ("LapNumber", "TyreLife", "TyreLifeKM")])
    assert fitted.model.transform(by_hand).first()["prediction"] == told[2]["prediction"]


def test_the_fit_does_not_depend_on_row_count_unless_asked(spark):
    rows = feature_rows(spark, 12_000)
    keys = [*training.NATURAL_KEY, "TyreLife"]
    plain = training.fit_lap_times(rows, keys, iterations=4)
    early = training.fit_lap_times(rows, keys, iterations=4, early_stop=True)
    assert plain.model.stages[-1].getNumTrees == 4
    assert early.model.stages[-1].getNumTrees <= 4
    assert plain.rmse < plain.spread
    again = training.fit_lap_times(rows.repartition(5, "Driver"), keys, iterations=4)
    assert abs(again.rmse - plain.rmse) < 1e-6


def test_each_lap_is_scored_by_its_era(spark, fitted):
    laps = spark.createDataFrame(
        [(2023, 15.0, 5.0, "SOFT", 1.0, "Haas", "D1", "X"), (2035, 15.0, 5.0, "SOFT", 1.0, "Haas", "D1", "X")],
        "year int, lap_number double, tyre_life_laps double, compound string, stint double, team string, driver string, track_name string",
    )
    scored = scoring.score_laps_by_era(
        {"ground_effect_2022_2025": fitted.model}, fitted.model, laps, dims.eras(spark),
        dims.team_names(spark), dims.circuits(spark),
    )
    assert sorted((r["year"], r["era"]) for r in scored.collect()) == [
        (2023, "ground_effect_2022_2025"), (2035, None),
    ]


def test_eras_can_be_picked(spark):
    assert [r["era"] for r in dims.eras(spark, "active").collect()] == ["active_aero_2026_2030"]
    with pytest.raises(ValueError):
        dims.eras(spark, "none")


@pytest.mark.parametrize("given,most,tasks", [(50, 250_000, 1), (1, 100, 4)])
def test_rows_are_dealt_by_their_number_before_they_are_fitted(spark, monkeypatch, given, most, tasks):
    seen, pipeline = [], training.lap_time_pipeline

    class Spy:
        def __init__(self, *args, **kwargs):
            self.pipeline = pipeline(*args, **kwargs)

        def fit(self, taken):
            seen.append(taken.rdd.getNumPartitions())
            return self.pipeline.fit(taken)

    monkeypatch.setattr(training, "lap_time_pipeline", Spy)
    monkeypatch.setattr(training, "MOST_TASK_ROWS", most)
    fit = training.fit_lap_times(feature_rows(spark, 400).repartition(given), [*training.NATURAL_KEY, "TyreLife"], 1)
    assert fit.rows == 400 and seen == [tasks]
