"""From laps, weather, schedule and targets to strategy documents."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwise.functions.expressions import round_half_even
from lapwise.plans import degradation, history, strategy
from lapwise.sources.staging import Staging


@dataclass(frozen=True)
class Planning:
    """The tables of one planning job; each can be read on its own."""

    profiles: DataFrame
    lines: DataFrame
    medians: DataFrame
    models: DataFrame
    best: DataFrame
    overstay: DataFrame


def target_tables(
    counts: DataFrame,
    schedule: DataFrame,
    targets: DataFrame,
    teams: DataFrame,
    tracks: DataFrame,
    staging: Staging,
) -> tuple[DataFrame, DataFrame]:
    """(profiles, scoped slices), the two tables that tie targets to history; both staged.

    ``schedule`` and ``targets`` are read several times; stage them if they are costly to make.
    """
    races = history.target_races(targets, schedule)
    entrants = staging.table(history.entrant_counts(counts, tracks), "entrants")
    slices = staging.table(
        history.history_slices(races, schedule, history.races_with_laps(entrants)), "slices"
    )
    per_entrant = staging.table(history.entrant_history(entrants, slices, tracks), "per_entrant")
    context = history.target_context(targets, schedule, tracks)
    profiles = staging.table(
        history.target_profiles(context, races, per_entrant, teams), "profiles"
    )
    scoped = staging.table(degradation.scoped_slices(profiles, slices, tracks), "scoped")
    return profiles, scoped


def plan_targets(
    counts: DataFrame,
    schedule: DataFrame,
    targets: DataFrame,
    teams: DataFrame,
    tracks: DataFrame,
    staging: Staging,
    strict: bool = False,
    max_stops: int = strategy.MAX_STOPS,
    top_k: int = strategy.TOP_K,
) -> Planning:
    """Plans for every target.

    ``counts`` is a staged ``history.lap_counts`` table, the only large table here: it is read once for
    entrants, once for tyre ages and once for lap times, each time by the columns needed.  All
    later tables are small and staged, so no step plans or repeats the ones before it.
    """
    profiles, scoped = target_tables(counts, schedule, targets, teams, tracks, staging)
    lines = staging.table(
        degradation.fit_lines(degradation.tyre_age_sums(counts, tracks), scoped, strict), "lines"
    )
    medians = degradation.fresh_laps(degradation.lap_time_counts(counts, tracks), scoped, lines)
    models = staging.table(degradation.compound_models(profiles, lines, medians), "models")
    return Planning(
        profiles, lines, medians, models,
        strategy.fastest_plans(models, profiles, max_stops, top_k), degradation.overstay_table(models, profiles),
    )


def _or_empty_map(column: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(column), F.create_map().cast(df.schema[column].dataType))


def plan_documents(planning: Planning) -> DataFrame:
    """target_id, status, document: one nested plan per target.

    ``status`` is ok, unresolved, ambiguous, no_history or no_models.  Lists are ordered and bounded: five compounds, ten
    extra laps, ``top_k`` plans.
    """
    models = planning.models.groupBy("target_id").agg(
        F.map_from_entries(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "Compound",
                        F.struct(
                            "slope_sec_per_km", "intercept_sec", "window_km", "window_laps",
                            "fresh_lap_time_sec", "sample_size",
                        ),
                    )
                )
            )
        ).alias("_models")
    )
    extra = F.struct("extra_lap", "incremental_delta_sec", "cumulative_delta_sec")
    overstay = (
        planning.overstay.groupBy("target_id", "Compound")
        .agg(F.sort_array(F.collect_list(extra)).alias("_rows"))
        .groupBy("target_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("Compound", "_rows")))).alias("_overstay"))
    )
    plan = F.struct("rank", "compounds", "stint_laps", "stops", "predicted_total_time_sec")
    best = planning.best.groupBy("target_id").agg(F.sort_array(F.collect_list(plan)).alias("_best"))
    joined = (
        planning.profiles.join(models, "target_id", "left")
        .join(best, "target_id", "left")
        .join(overstay, "target_id", "left")
    )
    target = F.struct(
        F.col("target_year").alias("year"), F.col("gp").alias("grand_prix"), "event_name", "driver",
        "team", "track_type", "track_length_km", "race_laps",
        F.col("condition").alias("race_condition"),
    )
    without_rank = F.transform(
        "_best", lambda p: F.struct(p["compounds"].alias("compounds"), p["stint_laps"].alias("stint_laps"),
                                    p["stops"].alias("stops"),
                                    p["predicted_total_time_sec"].alias("predicted_total_time_sec"))
    )
    document = F.struct(
        target.alias("target"),
        F.col("history_rows").alias("phase_1_history_rows"),
        _or_empty_map("_models", joined).alias("phase_2_compound_models"),
        round_half_even(F.col("wet_experience_km"), 3).alias("phase_2_wet_experience_km"),
        F.coalesce(without_rank, F.array().cast(
            "array<struct<compounds:array<string>,stint_laps:array<int>,stops:int,"
            "predicted_total_time_sec:double>>"
        )).alias("phase_3_best_strategies"),
        _or_empty_map("_overstay", joined).alias("phase_3_overstay_delta"),
    )
    status = (
        F.when(F.col("status") != "resolved", F.col("status"))
        .when(F.col("history_rows") == 0, "no_history")
        .when(F.col("_models").isNull(), "no_models")
        .otherwise("ok")
    )
    return joined.select("target_id", status.alias("status"), document.alias("document"))


def laps_and_plans(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """One document per lap to predict: its lap time and its target's plan."""
    return predictions.join(documents, "target_id", "left").select(
        "target_id", "status",
        F.struct(
            F.col("prediction").alias("lap_time_prediction_sec"), F.col("document").alias("strategy")
        ).alias("document"),
    )
