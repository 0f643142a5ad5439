"""Lap features for the lap-time models."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.functions.expressions import event_key, wet_flag
from lapwise.operators.asof import asof_backward
from lapwise.operators.baselines import pace_baselines, session_paces
from lapwise.operators.filters import clean_laps, completed_events
from lapwise.operators.lookups import add_track_features, normalize_team
from lapwise.sources.tables import in_sessions


def with_weather(
    laps: DataFrame,
    weather: DataFrame,
    fields: Sequence[str] = schemas.WEATHER_FIELDS,
    **options,
) -> DataFrame:
    """Laps with the weather as of the end of each lap."""
    return asof_backward(
        laps, weather, by=schemas.SESSION, on="Time", fields=fields, tie="seq", **options
    )


def session_laps(laps: DataFrame, teams: DataFrame) -> DataFrame:
    """Clean laps with team names."""
    return normalize_team(clean_laps(laps), teams)


def measured_laps(
    laps: DataFrame,
    weather: DataFrame,
    teams: DataFrame,
    tracks: DataFrame,
    keep: Sequence[str] = (),
    sessions: DataFrame | None = None,
) -> DataFrame:
    """One row per clean lap: session key, ``keep``, categoricals, numeric features, lap time, and
    ``Matched``, whether a weather sample came before the lap's end.

    Baselines use every clean lap.  Look-ups come after the as-of join, so its shuffle carries only
    what the laps bring.  With ``sessions`` (Year, RoundNumber) only those races are read and joined.
    """
    if sessions is not None:
        wanted = in_sessions(sessions)
        laps, weather = laps.where(wanted), weather.where(wanted)
    sampled = weather.withColumn("Matched", F.lit(True))
    clean = clean_laps(laps)
    joined = pace_baselines(
        normalize_team(with_weather(clean, sampled, [*schemas.WEATHER_FEATURES, "Matched"]), teams),
        session_paces(session_laps(laps, teams)),
    )
    featured = (
        add_track_features(joined, tracks)
        .withColumn("IsWet", wet_flag(F.col("Compound"), F.col("Rainfall")))
        .withColumn("Rainfall", F.col("Rainfall").cast("int"))
    )
    return featured.select(
        *schemas.SESSION, "EventName", *keep, *schemas.CATEGORICAL, *schemas.NUMERIC, schemas.TARGET,
        F.coalesce("Matched", F.lit(False)).alias("Matched"),
    )


def complete_laps(measured: DataFrame, strict: bool = False) -> DataFrame:
    """The measured laps that have every feature and a time.  ``strict`` drops all laps of a session
    with a lap before its first weather sample."""
    complete = measured.dropna(subset=[*schemas.NUMERIC, schemas.TARGET]).drop("Matched")
    if strict:
        broken = measured.where(~F.col("Matched")).select(*schemas.SESSION).distinct()
        complete = complete.join(broken, schemas.SESSION, "left_anti")
    return complete


def lap_features(
    laps: DataFrame,
    weather: DataFrame,
    teams: DataFrame,
    tracks: DataFrame,
    keep: Sequence[str] = (),
    strict: bool = False,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """One row per usable lap: session key, ``keep``, categoricals, numeric features, lap time."""
    return complete_laps(measured_laps(laps, weather, teams, tracks, keep, sessions), strict)


def era_events(schedule: DataFrame, eras: DataFrame, as_of) -> DataFrame:
    """era, Year, RoundNumber, EventName of the races run by ``as_of``; eras may overlap."""
    seasons = eras.select(
        "era", F.explode(F.sequence(F.col("start_year"), F.col("end_year"))).alias("Year")
    )
    return (
        completed_events(schedule, as_of)
        .join(seasons, "Year")
        .select("era", *schemas.SESSION, "EventName")
    )


def era_features(features: DataFrame, schedule: DataFrame, eras: DataFrame, as_of) -> DataFrame:
    """Features of the completed races of each era.  Encoding comes later, over all of them."""
    events = era_events(schedule, eras, as_of).select("era", *schemas.RACE)
    return features.join(events, schemas.RACE)


def event_status(measured: DataFrame, schedule: DataFrame, eras: DataFrame, as_of) -> DataFrame:
    """One row per completed race of an era: its clean laps, those before the first weather sample, those
    with every feature, and whether it could be used.

    ``measured`` comes from ``measured_laps`` and is read once.  ``status`` is loaded, empty (laps, none
    usable) or no_laps.
    """
    usable = F.lit(True)
    for name in [*schemas.NUMERIC, schemas.TARGET]:
        usable &= F.col(name).isNotNull()
    counts = measured.groupBy(*schemas.RACE).agg(
        F.count(F.lit(1)).alias("clean_laps"), F.count_if(~F.col("Matched")).alias("unmatched_laps"),
        F.count_if(usable).alias("usable_laps"),
    )
    counted = (
        era_events(schedule, eras, as_of)
        .join(counts, schemas.RACE, "left")
        .fillna(0, ["clean_laps", "unmatched_laps", "usable_laps"])
    )
    return counted.select(
        "era", *schemas.SESSION, "EventName", "clean_laps", "unmatched_laps", "usable_laps",
        F.when(F.col("usable_laps") > 0, "loaded")
        .when(F.col("clean_laps") > 0, "empty")
        .otherwise("no_laps")
        .alias("status"),
    )


def era_coverage(statuses: DataFrame, eras: DataFrame) -> DataFrame:
    """Per era: status, row count and the ordered lists of loaded and failed races.

    The lists are as long as the calendar, whatever the number of laps.
    """
    loaded = F.col("status") == "loaded"
    order = [F.col("Year"), F.col("RoundNumber")]
    key = event_key(F.col("Year"), F.col("EventName"))
    failure = event_key(F.col("Year"), F.col("EventName"), F.col("status"))
    lists = statuses.groupBy("era").agg(
        F.sum("usable_laps").alias("rows"),
        F.array_sort(F.collect_list(F.when(loaded, F.struct(*order, key.alias("key"))))).alias("_ok"),
        F.array_sort(F.collect_list(F.when(~loaded, F.struct(*order, failure.alias("key"))))).alias("_bad"),
    )
    nothing = F.array().cast("array<string>")
    return eras.join(lists, "era", "left").select(
        "era", "start_year", "end_year",
        F.when(F.col("rows") > 0, "has_data").otherwise("no_data").alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce(F.col("_ok.key"), nothing).alias("loaded_events"),
        F.coalesce(F.col("_bad.key"), nothing).alias("failed_events"),
    )
