import pytest

from lapwise import schemas
from lapwise.operators import baselines, filters, lookups
from lapwise.plans import features, history
from lapwise.sources import dims, tables
from lapwise.functions.expressions import round_half_even
from pyspark.sql import functions as F


def laps_of(spark, rows, **fixed):
    """Laps from dicts over a plain default lap."""
    base = dict(
        Year=2024, RoundNumber=1, EventName="E1", Driver="VER", Team="Ferrari", LapNumber=1.0, Stint=1,
        Compound="SOFT", TyreLife=1.0, Time=100.0, LapTimeSeconds=90.0, IsAccurate=True, TrackStatus="1",
    )
    data = [tuple({**base, **fixed, **row}[f] for f in schemas.LAPS.names) for row in rows]
    return spark.createDataFrame(data, schemas.LAPS)


def weather_of(spark, rows):
    return spark.createDataFrame(rows, schemas.WEATHER)


SAMPLE = (2024, 1, 0.0, 1, 25.0, 35.0, 50.0, False, 1.0, 90.0)


def schedule_of(spark, rows):
    return spark.createDataFrame(rows, schemas.SCHEDULE)


def targets_of(spark, rows):
    return spark.createDataFrame(rows, schemas.TARGETS)


@pytest.fixture(scope="module")
def seasons(spark):
    rows = [(year, r, f"E{r}", f"{year}-0{r}-10") for year in (2023, 2024) for r in range(1, 8)]
    return schedule_of(spark, [*rows, (2024, 0, "Testing", "2024-01-01"), (2024, None, "Odd", "2024-01-01")])


def test_clean_laps(spark):
    rows = [{}, {"IsAccurate": False}, {"TrackStatus": "12"}, {"Compound": "UNKNOWN"}, {"Compound": None}]
    assert filters.clean_laps(laps_of(spark, rows)).count() == 1


def test_completed_events_skip_future_unparseable_and_unnamed(spark):
    schedule = schedule_of(spark, [
        (2024, 1, "A", "2024-03-02"), (2024, 2, "B", "2024-03-09"), (2024, 3, "C", "soon"),
        (2024, 4, "D", None), (2024, None, "E", "2024-01-01"), (2024, 5, None, "2024-01-01"),
    ])
    done = filters.completed_events(schedule, "2024-03-02")
    assert [r["EventName"] for r in done.collect()] == ["A"]


def test_team_names_pass_through_when_unknown(spark):
    df = spark.createDataFrame([("RB",), ("Kick Sauber",), ("Nobody",), (None,)], "Team string")
    named = lookups.normalize_team(df, dims.team_names(spark))
    assert sorted(r["Team"] or "" for r in named.collect()) == ["", "Audi", "Nobody", "Racing Bulls"]


def test_unlisted_track_takes_defaults(spark):
    df = spark.createDataFrame([("Suzuka Circuit", 2.0), ("Elsewhere", 2.0)], "EventName string, TyreLife double")
    rows = {r["EventName"]: r for r in lookups.add_track_features(df, dims.circuits(spark)).collect()}
    assert rows["Elsewhere"]["TrackType"] == "Medium" and rows["Elsewhere"]["TyreLifeKM"] == 10.0
    assert rows["Suzuka Circuit"]["TrackLengthKM"] == 5.807


def test_circuits_can_be_keyed_by_event(spark):
    bridge = spark.createDataFrame([("Japanese Grand Prix", "Suzuka Circuit")], "EventName string, circuit string")
    row = dims.circuits_by_event(dims.circuits(spark), bridge).collect()
    assert [tuple(r) for r in row] == [("Japanese Grand Prix", "Medium", 5.807)]


def test_baselines_use_laps_dropped_later_and_skip_missing_teams(spark):
    rows = [
        {"LapTimeSeconds": 90.0}, {"LapTimeSeconds": 92.0}, {"LapTimeSeconds": 96.0, "TyreLife": None},
        {"LapTimeSeconds": 80.0, "Team": None},
    ]
    found = baselines.pace_baselines(laps_of(spark, rows)).collect()
    named = [r for r in found if r["Team"]]
    assert {r["TeamBaselinePace"] for r in named} == {92.0}
    assert {r["FieldBaselinePace"] for r in found} == {91.0}
    assert {r["RelativePace"] for r in named} == {1.0}
    assert [r["TeamBaselinePace"] for r in found if not r["Team"]] == [None]


def test_lap_delta_is_missing_without_a_stint(spark):
    rows = [{"LapTimeSeconds": 91.0}, {"LapTimeSeconds": 90.0}, {"LapTimeSeconds": 70.0, "Stint": None}]
    deltas = [r["LapDelta"] for r in baselines.lap_delta(laps_of(spark, rows)).collect()]
    assert sorted(d for d in deltas if d is not None) == [0.0, 1.0] and deltas.count(None) == 1


def test_training_drops_laps_before_the_first_sample_or_fails_the_session(spark):
    laps = laps_of(spark, [{"Time": 50.0}, {"Time": 150.0}, {"Time": 150.0, "Stint": None}])
    weather = weather_of(spark, [(2024, 1, 100.0, 1, 25.0, 35.0, 50.0, True, 1.0, 90.0)])
    args = (laps, weather, dims.team_names(spark), dims.circuits(spark))
    rows = features.lap_features(*args).collect()
    assert len(rows) == 1 and rows[0]["IsWet"] == 1 and rows[0]["Rainfall"] == 1
    assert features.lap_features(*args, strict=True).count() == 0


def test_history_keeps_laps_without_weather_and_missing_drivers(spark):
    laps = laps_of(spark, [{"Driver": None}, {"Compound": "WET"}, {"LapTimeSeconds": None}, {"Team": None}])
    nothing = weather_of(spark, [(2023, 9, 0.0, 1, 1.0, 1.0, 1.0, True, 1.0, 1.0)])
    rows = history.history_laps(laps, nothing, dims.team_names(spark), dims.circuits(spark)).collect()
    assert sorted((r["Driver"], r["IsWet"], r["Rainfall"], r["AirTemp"]) for r in rows) == [
        ("None", 0, 0, None), ("VER", 1, 0, None),
    ]


def test_slices_weigh_recent_races_and_the_year_before(spark, seasons):
    targets = targets_of(spark, [(1, 2024, "E6", "VER", "RB", 50, "auto", 21.0)])
    races = history.target_races(targets, seasons)
    found = {(r["Year"], r["EventName"]): (r["weight"], r["source"]) for r in history.race_slices(races, seasons).collect()}
    assert found == {
        (2024, "E5"): (3.0, "prev_1_race"), (2024, "E4"): (2.5, "prev_2_race"), (2024, "E3"): (2.0, "prev_3_race"),
        (2024, "E2"): (1.0, "older_current_season"), (2024, "E1"): (1.0, "older_current_season"),
        (2023, "E6"): (2.5, "same_race_prev_year"),
    }


def test_fallback_takes_the_end_of_last_season_only_without_history(spark, seasons):
    targets = targets_of(spark, [
        (1, 2024, "E1", "VER", "RB", 50, "auto", 21.0), (2, 2024, "E2", "VER", "RB", 50, "auto", 21.0),
    ])
    races = history.target_races(targets, seasons)
    slices = history.race_slices(races, seasons)
    raced = spark.createDataFrame([(2024, "E1"), (2023, "E5")], "Year int, EventName string")
    rows = history.fallback_slices(races, slices, seasons, raced).collect()
    assert {r["target_round"] for r in rows} == {1}
    assert {(r["Year"], r["EventName"], r["weight"]) for r in rows} == {(2023, f"E{r}", 1.2) for r in range(3, 8)}


def test_target_never_in_its_own_history(spark, seasons):
    targets = targets_of(spark, [(r, 2024, f"E{r}", "VER", "RB", 50, "auto", 21.0) for r in range(1, 8)])
    races = history.target_races(targets, seasons)
    slices = history.race_slices(races, seasons)
    assert slices.where("Year = target_year and EventName = target_event").count() == 0


def test_unresolved_target_is_reported(spark, seasons):
    targets = targets_of(spark, [(1, 2024, "Nowhere", "VER", "RB", 50, None, None)])
    row = history.target_context(targets, seasons, dims.circuits(spark)).collect()[0]
    assert row["status"] == "unresolved" and row["track_length_km"] == 5.0


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.49999999999,), (0.0005,), (0.0015,), (1.2375,)], "x double")
    found = df.select(round_half_even(F.col("x")).alias("a"), round_half_even(F.col("x"), 3).alias("b")).collect()
    assert [r["a"] for r in found[:3]] == [2.0, 4.0, 2.0]
    assert [r["b"] for r in found[3:]] == [0.0, 0.002, 1.238]


def test_conform_fills_absent_columns_and_turns_nan_into_null(spark):
    import datetime

    df = spark.createDataFrame(
        [(2024, 1, "E1", datetime.timedelta(seconds=90.5), float("nan"), datetime.timedelta(minutes=2), True, "1")],
        "Year int, RoundNumber int, EventName string, LapTime interval day to second, TyreLife double,"
        " Time interval day to second, IsAccurate boolean, TrackStatus string",
    )
    row = tables.conform_laps(df).collect()[0]
    assert (row["LapTimeSeconds"], row["TyreLife"], row["Time"], row["Driver"]) == (90.5, None, 120.0, None)
    with pytest.raises(ValueError):
        tables.conform(df.drop("Year"), schemas.LAPS)


def test_sessions_round_trip_through_partitioned_files(spark, tmp_path):
    laps = laps_of(spark, [{}, {"RoundNumber": 2, "EventName": "E2"}])
    tables.write_sessions(laps, str(tmp_path / "laps"))
    read = tables.read_laps(spark, str(tmp_path / "laps"))
    weather = weather_of(spark, [SAMPLE, (2024, 2, *SAMPLE[2:])])
    race, its_weather = tables.load_session(read, weather, 2024, "E2")
    assert [r["EventName"] for r in race.collect()] == ["E2"]
    assert [r["RoundNumber"] for r in its_weather.collect()] == [2]


def test_profile_counts_nulls_and_distinct_values(spark):
    rows = tables.schema_profile(laps_of(spark, [{"Driver": None}, {}, {}])).collect()
    driver = next(r for r in rows if r["column_name"] == "Driver")
    assert (driver["row_count"], driver["null_count"], driver["distinct_values"]) == (3, 1, 1)


def test_targets_are_found_by_the_names_people_type(spark):
    schedule = schedule_of(spark, [
        (2024, 1, "Bahrain Grand Prix", "x"), (2024, 2, "São Paulo Grand Prix", "x"), (2024, 3, "Twin", "x"),
        (2024, 4, "TWIN Grand Prix", "x"), (2023, 9, "Bahrain Grand Prix", "x"),
    ])
    names = ["Bahrain", " bahrain GRAND PRIX", "sao paulo", "São Paulo Grand Prix", "2", "twin", "Grand", "9"]
    targets = targets_of(spark, [(i, 2024, n, "VER", "RB", 50, "auto", 21.0) for i, n in enumerate(names)])
    told = [
        (r["round_number"], r["status"]) for r in history.resolved_targets(targets, schedule).orderBy("target_id").collect()
    ]
    assert told == [(1, "resolved")] * 2 + [(2, "resolved")] * 3 + [(None, "ambiguous"), (None, "unresolved"), (None, "unresolved")]
    races = history.target_races(targets, schedule).orderBy("target_round").collect()
    assert [tuple(r) for r in races] == [(2024, 1, "Bahrain Grand Prix"), (2024, 2, "São Paulo Grand Prix")]


def test_names_are_found_without_accents_in_any_script(spark):
    events = ["Việt Nam Grand Prix", "Ōsaka Grand Prix", "Türkiye GRAND PRIX", "Ελλάδα", "Škoda Grand Prix"]
    schedule = schedule_of(spark, [(2024, n, event, "x") for n, event in enumerate(events, 1)])
    names = ["viet nam", "OSAKA", "turkiye grand prix", "ελλαδα", "skoda", ""]
    targets = targets_of(spark, [(i, 2024, n, "VER", "RB", 50, "auto", 21.0) for i, n in enumerate(names)])
    told = history.resolved_targets(targets, schedule).orderBy("target_id")
    assert [r["event_name"] for r in told.collect()] == [*events, None]
    assert dict(told.dtypes)["event_name"] == "string"


def test_laps_as_timed_become_seconds_to_the_millisecond(spark):
    raw = laps_of(spark, [{"LapTimeSeconds": 90.0625}, {"LapTimeSeconds": None}]).selectExpr(
        "*", "make_dt_interval(0, 0, 0, cast(LapTimeSeconds as decimal(18,6))) AS LapTime"
    ).drop("LapTimeSeconds")
    rows = tables.conform_laps(raw.withColumn("TyreLife", F.lit(float("nan")))).collect()
    assert [r["LapTimeSeconds"] for r in rows] == [90.063, None] and {r["TyreLife"] for r in rows} == {None}
