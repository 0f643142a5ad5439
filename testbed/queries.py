"""Registered queries: the engine over the test tables, flattened for comparison."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.functions import selection
from lapwise.functions.expressions import round_half_even
from lapwise.operators import baselines, filters, lookups
from lapwise.plans import degradation, features, history, planner, scoring, strategy, training
from lapwise.sources import dims, sliced
from lapwise.sources.documents import write_json
from lapwise.sources.incremental import SessionTable, Source
from lapwise.sources.staging import Staging
from lapwise.sources.tables import conform, conform_laps, load_session, schema_profile, sketched_profile, write_sessions
from lapwise.sources.tables import merged_profile as merge_profiles
from testbed.tables import LAP_KEYS, TEST_AS_OF, Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    REGISTRY[build.__name__] = run
    return run


def r6(value: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return round_half_even(column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def joined(value: str, by: str) -> Column:
    return F.array_join(F.col(value).cast("array<string>"), by)


# Shared steps ------------------------------------------------------------------------------------


def opened(spark: SparkSession) -> Staging:
    """Staging in the cluster's shared folder, or in a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return Staging(spark, None if named else f"{tempfile.mkdtemp(prefix='lapwise-')}/staged")


def feature_table(t: Tables) -> DataFrame:
    return features.lap_features(t.laps, t.weather, t.teams, t.tracks, keep=LAP_KEYS)


def era_laps(t: Tables, schedule: DataFrame) -> DataFrame:
    """Measured laps of the eras' completed races alone."""
    sessions = features.era_events(schedule, t.eras, TEST_AS_OF)
    return features.measured_laps(t.laps, t.weather, t.teams, t.tracks, LAP_KEYS, sessions)


def history_table(t: Tables, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    return history.history_laps(t.laps, t.weather, t.teams, t.tracks, needed(schedule, targets))


def needed(schedule: DataFrame, targets: DataFrame) -> DataFrame:
    return history.needed_sessions(history.target_races(targets, schedule), schedule)


def staged_schedule(t: Tables, staging: Staging) -> DataFrame:
    """The schedule alone, for what is done by era."""
    return staging.table(t.schedule, "schedule")


def staged_calendar(t: Tables, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Schedule and targets, both small and read by many steps."""
    return staged_schedule(t, staging), staging.table(t.targets, "targets")


def staged_counts(t: Tables, staging: Staging, schedule: DataFrame, targets: DataFrame) -> DataFrame:
    sessions = staging.table(needed(schedule, targets), "sessions")
    return staging.table(history.lap_counts(t.laps, t.weather, t.teams, sessions), "counts")


def planning(t: Tables, staging: Staging) -> planner.Planning:
    schedule, targets = staged_calendar(t, staging)
    counts = staged_counts(t, staging, schedule, targets)
    return planner.plan_targets(counts, schedule, targets, t.teams, t.tracks, staging)


def target_steps(t: Tables, staging: Staging):
    schedule, targets = staged_calendar(t, staging)
    counts = staged_counts(t, staging, schedule, targets)
    return counts, *planner.target_tables(counts, schedule, targets, t.teams, t.tracks, staging)


# Laps --------------------------------------------------------------------------------------------


@query
def clean_laps(t: Tables) -> DataFrame:
    return filters.clean_laps(t.laps).drop("IsAccurate", "TrackStatus")


@query
def asof_weather(t: Tables) -> DataFrame:
    laps = filters.clean_laps(t.laps).select(*LAP_KEYS, *schemas.SESSION, "Time")
    return features.with_weather(laps, t.weather)


@query
def asof_stored(t: Tables) -> DataFrame:
    """The same join over tables stored in common buckets."""
    laps = filters.clean_laps(t.laps).select(*LAP_KEYS, *schemas.SESSION, "Time")
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = sliced.store(laps, t.weather, f"lapwise_{uuid.uuid4().hex}", opened(t.spark).path("sliced"), buckets)
    return sliced.asof_stored(t.spark, stored)


@query
def normalize_team(t: Tables) -> DataFrame:
    laps = t.laps.select(*LAP_KEYS, F.col("Team").alias("alias"), "Team")
    return lookups.normalize_team(laps, t.teams)


@query
def track_features(t: Tables) -> DataFrame:
    laps = t.laps.select(*LAP_KEYS, "EventName", "TyreLife")
    return rounded(lookups.add_track_features(laps, t.tracks), "TyreLifeKM").drop("TyreLife")


@query
def wet_flag(t: Tables) -> DataFrame:
    laps = history.history_laps(t.laps, t.weather, t.teams, t.tracks)
    return laps.select(*LAP_KEYS, "Compound", "Rainfall", "IsWet")


@query
def pace_baselines(t: Tables) -> DataFrame:
    laps = features.session_laps(t.laps, t.teams).select(
        *LAP_KEYS, *schemas.SESSION, "Team", "LapTimeSeconds"
    )
    paces = baselines.pace_baselines(laps)
    names = ["FieldBaselinePace", "TeamBaselinePace", "RelativePace"]
    return rounded(paces, *names).select(*LAP_KEYS, "Team", *names)


@query
def lap_features(t: Tables) -> DataFrame:
    return rounded(
        feature_table(t), "TyreLifeKM", "TeamBaselinePace", "FieldBaselinePace", "RelativePace"
    )


# Eras --------------------------------------------------------------------------------------------


@query
def completed_events(t: Tables) -> DataFrame:
    return filters.completed_events(t.schedule, TEST_AS_OF)


@query
def era_features(t: Tables) -> DataFrame:
    schedule = staged_schedule(t, opened(t.spark))
    rows = features.era_features(features.complete_laps(era_laps(t, schedule)), schedule, t.eras, TEST_AS_OF)
    return rounded(rows, "TyreLifeKM", "TeamBaselinePace", "FieldBaselinePace", "RelativePace")


@query
def event_status(t: Tables) -> DataFrame:
    schedule = staged_schedule(t, opened(t.spark))
    return features.event_status(era_laps(t, schedule), schedule, t.eras, TEST_AS_OF)


@query
def era_coverage(t: Tables) -> DataFrame:
    schedule = staged_schedule(t, opened(t.spark))
    statuses = features.event_status(era_laps(t, schedule), schedule, t.eras, TEST_AS_OF)
    coverage = features.era_coverage(statuses, t.eras)
    return coverage.withColumns(
        {name: joined(name, ";") for name in ("loaded_events", "failed_events")}
    )


@query
def train_test_split(t: Tables) -> DataFrame:
    split = training.split_train_test(filters.clean_laps(t.laps), LAP_KEYS)
    return split.select(*LAP_KEYS, "is_test", "is_validation")


# History -----------------------------------------------------------------------------------------


@query
def target_context(t: Tables) -> DataFrame:
    context = history.target_context(t.targets, t.schedule, t.tracks)
    return context.select(
        "target_id", "year", "gp", "round_number", "event_name", "track_type", "track_length_km", "status"
    )


@query
def prior_races(t: Tables) -> DataFrame:
    return history.prior_races(history.target_races(t.targets, t.schedule), t.schedule)


@query
def race_slices(t: Tables) -> DataFrame:
    return history.race_slices(history.target_races(t.targets, t.schedule), t.schedule)


@query
def history_fallback(t: Tables) -> DataFrame:
    schedule, targets = staged_calendar(t, opened(t.spark))
    races = history.target_races(targets, schedule)
    slices = history.race_slices(races, schedule)
    raced = history.races_with_laps(history_table(t, schedule, targets))
    return history.fallback_slices(races, slices, schedule, raced)


@query
def weighted_history(t: Tables) -> DataFrame:
    staging = opened(t.spark)
    schedule, targets = staged_calendar(t, staging)
    laps = staging.table(history_table(t, schedule, targets), "history")
    races = history.target_races(targets, schedule)
    slices = history.history_slices(races, schedule, history.races_with_laps(laps))
    rows = history.weighted_history(laps, staging.table(slices, "slices"), keep=LAP_KEYS)
    return rounded(rows, "TyreLifeKM")


def _per_entrant(t: Tables) -> tuple[DataFrame, DataFrame]:
    staging = opened(t.spark)
    schedule, targets = staged_calendar(t, staging)
    counts = history.lap_counts(t.laps, t.weather, t.teams, staging.table(needed(schedule, targets), "sessions"))
    entrants = staging.table(history.entrant_counts(counts, t.tracks), "entrants")
    races = history.target_races(targets, schedule)
    slices = history.history_slices(races, schedule, history.races_with_laps(entrants))
    return races, history.entrant_history(entrants, staging.table(slices, "slices"), t.tracks)


@query
def race_condition(t: Tables) -> DataFrame:
    return rounded(history.race_condition(*_per_entrant(t)), "wet_share")


@query
def wet_experience(t: Tables) -> DataFrame:
    _, profiles, _ = target_steps(t, opened(t.spark))
    return rounded(profiles.select("target_id", "wet_experience_km"), "wet_experience_km")


@query
def scope_level(t: Tables) -> DataFrame:
    _, profiles, _ = target_steps(t, opened(t.spark))
    return profiles.select("target_id", *schemas.TARGET_RACE, "driver", "team", "level")


@query
def refreshed_counts(t: Tables) -> DataFrame:
    """Counts by session, derived from the races until 1997 and brought up to date when the others arrive."""
    staging = opened(t.spark)

    def source(name: str, schema) -> Source:  # times as given, not held to milliseconds
        return Source(staging.path(name), lambda spark, path: conform(spark.read.parquet(path), schema))

    sources = {"laps": source("laps", schemas.LAPS), "weather": source("weather", schemas.WEATHER)}
    counts = SessionTable(
        t.spark, staging.path("counts"), lambda laps, weather: history.session_lap_counts(laps, weather, t.teams)
    )
    write_sessions(t.weather, sources["weather"].path)
    for arrived in (F.col("Year") <= 1997, F.col("Year") >= 1998):
        write_sessions(t.laps.where(arrived), sources["laps"].path, only_present=True)
        counts.refresh(sources)
    return counts.read()


#: Distinct values up to here are compared as numbers, beyond by the sketch's error.
FEW_VALUES = 500


@query
def merged_profile(t: Tables) -> DataFrame:
    """Profile of the laps by season, from sketches stored by race as the races arrive."""
    staging = opened(t.spark)
    path = staging.path("laps")
    sources = {"laps": Source(path, lambda spark, where: conform(spark.read.parquet(where), schemas.LAPS))}
    profiles = SessionTable(t.spark, staging.path("profiles"), lambda laps: sketched_profile(laps))
    for arrived in (F.col("Year") <= 1997, F.col("Year") >= 1998):
        write_sessions(t.laps.select(*schemas.LAPS.names).where(arrived), path, only_present=True)
        profiles.refresh(sources)
    told = merge_profiles(profiles.read(), ["Year"])
    laps = sources["laps"].read(t.spark, path)
    names = [c for c in schemas.LAPS.names if c not in schemas.SESSION]
    counts = laps.groupBy("Year").agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in names])
    exact = counts.unpivot("Year", names, "column_name", "true_values")
    error = F.abs(F.col("distinct_values") - F.col("true_values")) / F.greatest("true_values", F.lit(1))
    return told.join(exact, ["Year", "column_name"]).select(
        "Year", "column_name", "row_count", "null_count",
        F.when(F.col("true_values") <= FEW_VALUES, F.col("distinct_values")).alias("few_values"),
        (error < 0.03).alias("is_close"),
    )


# Degradation -------------------------------------------------------------------------------------


@query
def lap_delta(t: Tables) -> DataFrame:
    laps = features.session_laps(t.laps, t.teams).dropna(subset=schemas.HISTORY_REQUIRED)
    deltas = baselines.lap_delta(laps)
    return rounded(deltas, "StintBaseline", "LapDelta").select(*LAP_KEYS, "StintBaseline", "LapDelta")


@query
def wls_degradation(t: Tables) -> DataFrame:
    counts, _, scoped = target_steps(t, opened(t.spark))
    lines = degradation.fit_lines(degradation.tyre_age_sums(counts, t.tracks), scoped)
    return rounded(lines.select(*degradation.FIT, "slope", "intercept", "sample_size"), "slope", "intercept")


@query
def fresh_lap_weighted_median(t: Tables) -> DataFrame:
    staging = opened(t.spark)
    counts, _, scoped = target_steps(t, staging)
    lines = staging.table(degradation.fit_lines(degradation.tyre_age_sums(counts, t.tracks), scoped), "lines")
    medians = degradation.fresh_laps(degradation.lap_time_counts(counts, t.tracks), scoped, lines)
    return rounded(medians, "fresh_lap_time_sec")


@query
def compound_models(t: Tables) -> DataFrame:
    models = planning(t, opened(t.spark)).models
    return rounded(models, "slope_sec_per_km", "intercept_sec", "window_km", "fresh_lap_time_sec")


@query
def overstay_table(t: Tables) -> DataFrame:
    return planning(t, opened(t.spark)).overstay


# Strategy ----------------------------------------------------------------------------------------


def _flat_plans(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        "target_id", "stops", joined("compounds", "-").alias("compounds"),
        joined("stint_laps", "-").alias("stint_laps"), *names,
    )


def _candidates(t: Tables) -> DataFrame:
    plan = planning(t, opened(t.spark))
    return strategy.candidate_plans(plan.models, plan.profiles, dims.stint_sequences(t.spark))


@query
def candidate_plans(t: Tables) -> DataFrame:
    return _flat_plans(_candidates(t).withColumn("stops", F.col("stints") - 1))


@query
def score_plans(t: Tables) -> DataFrame:
    return _flat_plans(strategy.score_plans(_candidates(t)), "predicted_total_time_sec")


@query
def best_plans(t: Tables) -> DataFrame:
    return _flat_plans(planning(t, opened(t.spark)).best, "predicted_total_time_sec", "rank")


def _flat_document(name: str) -> list[Column]:
    """What a plan document says, in plain columns."""
    plans = F.col(f"{name}.phase_3_best_strategies")
    overstay = F.col(f"{name}.phase_3_overstay_delta")
    lines = F.transform(
        plans,
        lambda p: F.concat_ws(
            " ", F.array_join(p["compounds"], "-"), F.array_join(p["stint_laps"].cast("array<string>"), "-")
        ),
    )
    last = F.transform(F.map_values(overstay), lambda rows: F.element_at(rows, -1)["cumulative_delta_sec"])
    return [
        F.col(f"{name}.target.*"),
        F.col(f"{name}.phase_1_history_rows").alias("history_rows"),
        F.col(f"{name}.phase_2_wet_experience_km").alias("wet_experience_km"),
        F.coalesce(F.size(F.map_keys(F.col(f"{name}.phase_2_compound_models"))), F.lit(0)).alias("models"),
        F.array_join(lines, "; ").alias("plans"),
        F.array_min(F.transform(plans, lambda p: p["predicted_total_time_sec"])).alias("best_time_sec"),
        F.coalesce(F.array_join(F.array_sort(F.map_keys(overstay)), "; "), F.lit("")).alias("overstay"),
        F.array_max(last).alias("last_cumulative_sec"),
    ]


@query
def plan_document(t: Tables) -> DataFrame:
    """Written as JSON lines, read back with the document's schema, flattened."""
    staging = opened(t.spark)
    documents = planner.plan_documents(planning(t, staging))
    path = staging.path("documents")
    write_json(documents, path)
    read = t.spark.read.schema(documents.schema).json(path)
    return read.select("target_id", "status", *_flat_document("document"))


@query
def pace_quantiles(t: Tables) -> DataFrame:
    """Quartiles and tails of seconds per kilometre, which are not rounded, by season and compound."""
    laps = filters.clean_laps(t.laps).select("Year", "Compound", "EventName", "LapTimeSeconds")
    paced = lookups.add_track(laps, t.tracks).withColumn("pace", F.col("LapTimeSeconds") / F.col("TrackLengthKM"))
    wanted = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    return rounded(selection.exact_quantiles(paced, ["Year", "Compound"], "pace", wanted, opened(t.spark)), *wanted)


# Models ------------------------------------------------------------------------------------------


ONE_RACE = (1997, "Event 05")


def _saved_model(t: Tables, path: str):
    """The model of all races, fit, saved to ``path`` and loaded from its files."""
    fit = training.fit_lap_times(feature_table(t), LAP_KEYS, always_split=True, early_stop=True)
    training.save_model(fit.model, path)
    return training.load_model(path)


@query
def lap_time_model(t: Tables) -> DataFrame:
    """A model per era.  ``better_than_mean``: its error on the test laps is below that of their mean."""
    staging = opened(t.spark)
    schedule = staged_schedule(t, staging)
    measured = staging.table(era_laps(t, schedule), "measured")
    statuses = features.event_status(measured, schedule, t.eras, TEST_AS_OF)
    coverage = staging.table(features.era_coverage(statuses, t.eras), "coverage")
    of_eras = features.era_features(features.complete_laps(measured), schedule, t.eras, TEST_AS_OF)
    runs = training.train_eras(
        t.spark, of_eras, coverage, TEST_AS_OF, staging.path("models"), LAP_KEYS, early_stop=True
    )
    write_json(runs, staging.path("era_training_metadata"))
    return t.spark.read.schema(runs.schema).json(staging.path("era_training_metadata")).select(
        "era", "status", "start_year", "end_year", "as_of", "rows", "features",
        (F.col("rmse") < F.col("spread")).alias("better_than_mean"),
    )


def _all_laps_to_score(t: Tables, *more: Column) -> DataFrame:
    return t.laps.select(
        *more, *LAP_KEYS, F.col("LapNumber").alias("lap_number"), F.col("TyreLife").alias("tyre_life_laps"),
        F.col("Compound").alias("compound"), F.col("Stint").alias("stint"), F.col("Team").alias("team"),
        F.col("Driver").alias("driver"), F.col("EventName").alias("track_name"),
    )


def _one_lap_per_target(t: Tables) -> DataFrame:
    return t.targets.select(
        "target_id", F.lit(15.0).alias("lap_number"), F.lit(5.0).alias("tyre_life_laps"),
        F.lit("SOFT").alias("compound"), F.lit(1).alias("stint"), "team", "driver",
        F.col("gp").alias("track_name"),
    )


@query
def score_laps(t: Tables) -> DataFrame:
    """Every lap with the model's inputs, what it lacks, and whether it has a prediction."""
    model = _saved_model(t, opened(t.spark).path("lap_time_model"))
    scored = scoring.score_laps(model, _all_laps_to_score(t), t.teams, t.tracks)
    predicted = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return rounded(scored, "TyreLifeKM").select(
        *LAP_KEYS, "track_name", *schemas.CATEGORICAL, *schemas.NUMERIC, "missing", predicted.alias("has_prediction")
    )


@query
def score_laps_by_era(t: Tables) -> DataFrame:
    """Every lap scored once by the model of its era.  Two eras overlap, and one has no model."""
    eras = t.eras.unionByName(dims.literal_table(t.spark, [("middle", 1997, 1999)], t.eras.columns))
    staging = opened(t.spark)
    era = F.when(F.col("Year") <= 1997, "early").otherwise("middle")
    table = staging.table(feature_table(t).withColumn("era", era), "features")
    nothing = F.array().cast("array<string>")
    coverage = eras.where(F.col("era").isin("early", "middle")).select(
        "*", F.lit(0).alias("rows"), F.lit("has_data").alias("status"), nothing.alias("loaded_events"), nothing.alias("failed_events")
    )
    runs = training.train_eras(t.spark, table, coverage, TEST_AS_OF, staging.path("models"), LAP_KEYS)
    models = {row["era"]: training.load_model(row["model_path"]) for row in runs.select("era", "model_path").collect()}
    laps = _all_laps_to_score(t, F.col("Year").alias("year"))
    scored = scoring.score_laps_by_era(models, models["middle"], laps, eras, t.teams, t.tracks)
    return scored.select(*LAP_KEYS, "year", "era", "missing", F.col("prediction").isNotNull().alias("has_prediction"))


@query
def one_race_model(t: Tables) -> DataFrame:
    """A model of one race alone; only its laps and weather are read."""
    laps, weather = load_session(t.laps, t.weather, *ONE_RACE)
    rows = features.lap_features(laps, weather, t.teams, t.tracks, keep=LAP_KEYS)
    fit = training.fit_lap_times(rows, LAP_KEYS, always_split=True)
    return t.spark.createDataFrame(
        [(*ONE_RACE, fit.rows, fit.features, fit.rmse is not None)],
        "Year int, EventName string, rows long, features int, has_rmse boolean",
    )


@query
def one_driver_model(t: Tables) -> DataFrame:
    """A model of one driver's laps in one race: below 50 laps, all are fitted and no error is measured."""
    laps, weather = load_session(t.laps, t.weather, *ONE_RACE)
    first = laps.agg(F.min("Driver").alias("Driver"))
    rows = features.lap_features(laps, weather, t.teams, t.tracks, keep=LAP_KEYS).join(first, "Driver")
    fit = training.fit_lap_times(rows, LAP_KEYS)
    return t.spark.createDataFrame(
        [(*ONE_RACE, fit.rows, fit.features, fit.rmse is not None)],
        "Year int, EventName string, rows long, features int, has_rmse boolean",
    )


@query
def lap_and_plan(t: Tables) -> DataFrame:
    """A predicted lap and a plan for every target, in one document, flattened."""
    staging = opened(t.spark)
    model = _saved_model(t, staging.path("lap_time_model"))
    predictions = scoring.score_laps(model, _one_lap_per_target(t), t.teams, t.tracks)
    documents = planner.plan_documents(planning(t, staging))
    both = planner.laps_and_plans(predictions, documents)
    return both.select(
        "target_id", "status", F.col("document.lap_time_prediction_sec").isNotNull().alias("has_prediction"),
        *_flat_document("document.strategy"),
    )


@query
def schema_profile_of_inputs(t: Tables) -> DataFrame:
    """Laps, weather and schedule, every distinct value counted."""
    tables = {"laps": t.laps.select(*schemas.LAPS.names), "weather": t.weather, "schedule": t.schedule}
    parts = [
        schema_profile(df, exact=True).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


REGISTRY["schema_profile"] = REGISTRY.pop("schema_profile_of_inputs")


@query
def ingested_laps(t: Tables) -> DataFrame:
    """Laps as a timing source gives them, lap times as intervals and gaps as NaN, conformed."""
    gap = F.when(F.col("l_partkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("TyreLife"))
    lap_time = F.make_dt_interval(secs=F.col("LapTimeSeconds").cast("decimal(18,6)"))
    raw = t.laps.withColumns({"TyreLife": gap, "LapTime": lap_time}).drop("LapTimeSeconds")
    return conform_laps(raw)
