"""Weighted pre-race history for any number of target races at once."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.functions.expressions import wet_flag
from lapwise.operators.filters import clean_laps
from lapwise.operators.lookups import add_track, add_track_features, normalize_team
from lapwise.plans.features import with_weather
from lapwise.sources.tables import in_sessions, season_schedule

# Slice weights and lengths.
RECENT_WEIGHTS = [3.0, 2.5, 2.0]
OLDER_WEIGHT = 1.0
SAME_RACE_WEIGHT = 2.5
FALLBACK_WEIGHT = 1.2
FALLBACK_RACES = 5
WET_SHARE = 0.25
#: Compares names without case and accents, in any script.
FOLDED = "UNICODE_CI_AI"


def race_key(name: Column) -> Column:
    """A race's name as people type it: without case, accents, outer blanks and "Grand Prix"."""
    return F.collate(F.trim(F.regexp_replace(name, r"(?i)\s+grand prix\s*$", "")), FOLDED)


def resolved_targets(targets: DataFrame, schedule: DataFrame) -> DataFrame:
    """Targets with round_number, event_name and status.

    A race is found in its season by its name, as ``race_key`` sees it, or by its round number.
    ``status`` is resolved, ambiguous (several races of the season answer to the name) or unresolved.
    """
    races = season_schedule(schedule).select(
        F.col("Year").alias("year"), F.struct("RoundNumber", "EventName").alias("_race"),
        F.explode(F.array(
            race_key(F.col("EventName")), F.collate(F.col("RoundNumber").cast("string"), FOLDED)
        )).alias("_key"),
    )
    answers = races.groupBy("year", "_key").agg(
        F.count_distinct("_race").alias("_n"), F.min("_race").alias("_race")
    )
    one = F.col("_n") == 1
    return (
        targets.withColumn("_key", race_key(F.col("gp"))).join(answers, ["year", "_key"], "left")
        .withColumns({
            "round_number": F.when(one, F.col("_race.RoundNumber")),
            "event_name": F.when(one, F.col("_race.EventName")),
            "status": F.when(one, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("unresolved"),
        })
        .drop("_key", "_n", "_race")
    )


def target_context(targets: DataFrame, schedule: DataFrame, tracks: DataFrame) -> DataFrame:
    """Targets with round, event, status, track type and length."""
    return (
        add_track(resolved_targets(targets, schedule), tracks, on="event_name")
        .withColumnRenamed("TrackType", "track_type")
        .withColumnRenamed("TrackLengthKM", "track_length_km")
    )


def target_races(targets: DataFrame, schedule: DataFrame) -> DataFrame:
    """target_year, target_round, target_event: each race that has a target, once."""
    return resolved_targets(targets, schedule).where("status = 'resolved'").select(
        F.col("year").alias("target_year"), F.col("round_number").alias("target_round"),
        F.col("event_name").alias("target_event"),
    ).distinct()


def prior_races(races: DataFrame, schedule: DataFrame) -> DataFrame:
    """Earlier races of the target's season; ``recency`` 1 is the last one."""
    season = season_schedule(schedule).select("Year", "RoundNumber", "EventName")
    newest_first = Window.partitionBy(*schemas.TARGET_RACE).orderBy(F.col("RoundNumber").desc())
    return (
        races.join(
            season,
            (F.col("Year") == F.col("target_year")) & (F.col("RoundNumber") < F.col("target_round")),
        )
        .withColumn("recency", F.row_number().over(newest_first))
    )


def race_slices(races: DataFrame, schedule: DataFrame) -> DataFrame:
    """target race, Year, EventName, weight, source: the three latest races, older ones, and the
    same race a year before (whether or not it was held)."""
    recent = F.col("recency") <= len(RECENT_WEIGHTS)
    weights = F.array(*[F.lit(w) for w in RECENT_WEIGHTS])
    earlier = prior_races(races, schedule).select(
        *races.columns, "Year", "EventName",
        F.when(recent, F.get(weights, F.col("recency") - 1))
        .otherwise(F.lit(OLDER_WEIGHT)).alias("weight"),
        F.when(recent, F.format_string("prev_%d_race", F.col("recency")))
        .otherwise(F.lit("older_current_season")).alias("source"),
    )
    year_before = races.select(
        *races.columns,
        (F.col("target_year") - 1).alias("Year"),
        F.col("target_event").alias("EventName"),
        F.lit(SAME_RACE_WEIGHT).alias("weight"),
        F.lit("same_race_prev_year").alias("source"),
    )
    return earlier.unionByName(year_before)


def fallback_slices(races: DataFrame, slices: DataFrame, schedule: DataFrame, raced: DataFrame) -> DataFrame:
    """For target races none of whose slices has a lap: the last races of the season before.

    ``raced`` lists the (Year, EventName) that have history laps.
    """
    served = slices.join(raced, schemas.RACE, "left_semi")
    late_first = Window.partitionBy("Year").orderBy(F.col("RoundNumber").desc())
    tail = (
        season_schedule(schedule)
        .withColumn("_place", F.row_number().over(late_first))
        .where(F.col("_place") <= FALLBACK_RACES)
        .select("Year", "EventName")
    )
    return (
        races.join(served, schemas.TARGET_RACE, "left_anti")
        .join(tail, F.col("Year") == F.col("target_year") - 1)
        .select(
            *races.columns, "Year", "EventName",
            F.lit(FALLBACK_WEIGHT).alias("weight"),
            F.lit("fallback_prev_season_tail").alias("source"),
        )
    )


def needed_sessions(races: DataFrame, schedule: DataFrame) -> DataFrame:
    """Year, RoundNumber of every race that the targets' history can come from: their slices and, as
    the fallback may be needed, the end of the season before.  A few dozen per target race."""
    slices = race_slices(races, schedule)
    nowhere = slices.select(*schemas.RACE).limit(0)
    wanted = slices.unionByName(fallback_slices(races, slices, schedule, nowhere)).select(*schemas.RACE)
    return season_schedule(schedule).join(wanted, schemas.RACE, "left_semi").select(*schemas.SESSION).distinct()


def history_slices(races: DataFrame, schedule: DataFrame, raced: DataFrame) -> DataFrame:
    """Slices of every target race, with the fallback where it applies."""
    slices = race_slices(races, schedule)
    return slices.unionByName(fallback_slices(races, slices, schedule, raced))


def wet_flagged_laps(
    laps: DataFrame, weather: DataFrame, teams: DataFrame, fields: Sequence[str],
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Usable laps with team names, the weather ``fields`` and the wet flag.

    With ``sessions`` (Year, RoundNumber) only those races are read and joined.  Rows that lack a required value go before the shuffle, not after it, and look-ups come after.
    """
    if sessions is not None:
        wanted = in_sessions(sessions)
        laps, weather = laps.where(wanted), weather.where(wanted)
    usable = (
        clean_laps(laps)
        .withColumn("Driver", F.coalesce(F.col("Driver").cast("string"), F.lit("None")))
        .dropna(subset=schemas.HISTORY_REQUIRED)
    )
    joined = normalize_team(with_weather(usable, weather, fields), teams)
    rain = F.coalesce("Rainfall", F.lit(False)).cast("int")
    return joined.withColumns({"Rainfall": rain, "IsWet": wet_flag(F.col("Compound"), F.col("Rainfall"))})


def history_laps(
    laps: DataFrame, weather: DataFrame, teams: DataFrame, tracks: DataFrame,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """History laps of the sessions (all, if not given), computed once for all slices."""
    flagged = wet_flagged_laps(laps, weather, teams, schemas.WEATHER_FIELDS, sessions)
    return add_track_features(flagged, tracks)


def races_with_laps(history: DataFrame) -> DataFrame:
    return history.select(*schemas.RACE).distinct()


def weighted_history(history: DataFrame, slices: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """target race x history lap, with DataWeight and DataSource.

    Its size is laps x slices by nature.  The plans below never build it: they aggregate the laps
    first and join slices after.
    """
    picked = slices.select(
        *schemas.TARGET_RACE, *schemas.RACE,
        F.col("weight").alias("DataWeight"), F.col("source").alias("DataSource"),
    )
    return history.join(picked, schemas.RACE).select(
        *schemas.TARGET_RACE, *schemas.HISTORY_COLUMNS, *keep, "DataWeight", "DataSource"
    )


def lap_counts(
    laps: DataFrame, weather: DataFrame, teams: DataFrame, sessions: DataFrame | None = None
) -> DataFrame:
    """History laps as counted values: the one table every degradation step reads.

    A single shuffle with map-side combine; laps alike in all that matters become one row, so a
    race, driver or stint with a third of all laps does not stay a third of the work.  Of the
    weather only rain matters here, and what follows from the race (track, length) is looked up
    on the sums.
    """
    return count_laps(wet_flagged_laps(laps, weather, teams, ["Rainfall"], sessions))


def count_laps(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*by, *schemas.STINT, "TyreLife", "LapTimeSeconds", "IsWet").agg(
        F.count(F.lit(1)).alias("n")
    )


def session_lap_counts(laps: DataFrame, weather: DataFrame, teams: DataFrame) -> DataFrame:
    """``lap_counts`` with the round: rows that depend on their session alone, for ``SessionTable``."""
    return count_laps(wet_flagged_laps(laps, weather, teams, ["Rainfall"]), ["RoundNumber"])


def entrant_counts(counts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Laps, wet laps and wet km per race, driver and team."""
    totals = counts.groupBy(*schemas.RACE, "Driver", "Team").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("IsWet")).alias("n_wet")
    )
    return add_track(totals, tracks).withColumn("wet_km", F.col("n_wet") * F.col("TrackLengthKM"))


def entrant_history(entrants: DataFrame, slices: DataFrame, tracks: DataFrame) -> DataFrame:
    """target race x driver x team: rows, wet rows, and wet km this season on the target's kind of
    track."""
    context = add_track(slices, tracks, on="target_event").select(
        *schemas.TARGET_RACE, *schemas.RACE, F.col("TrackType").alias("_target_type")
    )
    similar = (F.col("Year") == F.col("target_year")) & (F.col("TrackType") == F.col("_target_type"))
    return (
        context.join(entrants, schemas.RACE)
        .groupBy(*schemas.TARGET_RACE, "Driver", "Team")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_wet").alias("n_wet"),
            F.sum(F.when(similar, F.col("wet_km")).otherwise(F.lit(0.0))).alias("wet_experience_km"),
        )
    )


def race_condition(races: DataFrame, per_entrant: DataFrame) -> DataFrame:
    """Per target race: history rows, wet share and the condition inferred from it.

    Without history the share is 0 and the race is dry.
    """
    totals = per_entrant.groupBy(*schemas.TARGET_RACE).agg(
        F.sum("n").alias("n"), F.sum("n_wet").alias("n_wet")
    )
    share = F.coalesce(F.try_divide(F.col("n_wet").cast("double"), F.col("n")), F.lit(0.0))
    return races.join(totals, schemas.TARGET_RACE, "left").select(
        *races.columns,
        F.coalesce("n", F.lit(0)).alias("history_rows"),
        share.alias("wet_share"),
        F.when(share >= WET_SHARE, "wet").otherwise("dry").alias("inferred_condition"),
    )


def target_profiles(
    context: DataFrame, races: DataFrame, per_entrant: DataFrame, teams: DataFrame
) -> DataFrame:
    """Targets with history rows, race condition, wet experience and scope level.

    The scope is chosen for the whole target, before compounds: the driver in this team, else the
    team, else everyone.  ``level`` is NULL without history.
    """
    per_team = per_entrant.groupBy(*schemas.TARGET_RACE, "Team").agg(F.sum("n").alias("team_rows"))
    named = (
        normalize_team(context, teams, "team")
        .withColumnRenamed("year", "target_year")
        .withColumnRenamed("round_number", "target_round")
    )
    race = [*schemas.TARGET_RACE]
    joined = (
        named.join(
            per_entrant.select(
                *race, F.col("Driver").alias("driver"), F.col("Team").alias("team"),
                F.col("n").alias("driver_rows"), "wet_experience_km",
            ),
            [*race, "driver", "team"], "left",
        )
        .join(per_team.withColumnRenamed("Team", "team"), [*race, "team"], "left")
        .join(race_condition(races, per_entrant).drop("target_event"), race, "left")
    )
    return joined.select(
        "target_id", *race, "gp", "event_name", "status", "driver", "team", "track_type", "track_length_km",
        "race_laps",
        F.coalesce("pit_loss_sec", F.lit(21.0)).alias("pit_loss_sec"),
        F.when(F.coalesce("condition", F.lit("auto")) != "auto", F.col("condition"))
        .otherwise(F.coalesce("inferred_condition", F.lit("dry"))).alias("condition"),
        F.coalesce("history_rows", F.lit(0)).alias("history_rows"),
        F.coalesce("wet_experience_km", F.lit(0.0)).alias("wet_experience_km"),
        F.when(F.col("driver_rows") > 0, "driver")
        .when(F.col("team_rows") > 0, "team")
        .when(F.col("history_rows") > 0, "all").alias("level"),
    )
