"""Tyre-wear models per compound, and the cost of staying out too long.

Models are fit once per (target race, scope, compound), never once per target, and always from
counted laps: sums over a race are taken before that race is paired with its target races.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.functions.expressions import clamp_at_zero, round_half_even
from lapwise.functions.weighted import all_moments, line, point_moments, weighted_median
from lapwise.operators.lookups import add_track, add_track_features
from lapwise.sources.dims import WET_COMPOUNDS

# Fixed values of the wear model.
DEFAULT_SLOPE = 0.03
MIN_FIT_ROWS = 6
MIN_SAME_TRACK_ROWS = 12
LAP_DELTA_WINDOW_SEC = 1.2
FLAT_SLOPE = 1e-6
MAX_WET_REDUCTION = 0.2
WET_REDUCTION_KM = 2000.0
FRESH_LAPS = 2
OVERSTAY_LAPS = 10

SCOPE = ["level", "scope_driver", "scope_team"]
FIT = [*schemas.TARGET_RACE, *SCOPE, "Compound"]


def _scope_struct(level: str):
    driver = F.col("Driver") if level == "driver" else F.lit("")
    team = F.lit("") if level == "all" else F.col("Team")
    return F.struct(
        F.lit(level).alias("level"), driver.alias("scope_driver"), team.alias("scope_team")
    )


def _to_scopes(df: DataFrame, *by: str) -> DataFrame:
    """Each row once for its driver, once for its team and once for everyone.

    Rows are dealt out by race, compound and ``by`` before.  A sum by these and the scope then stays in its
    partition, so a row crosses the network once and not once for each level.
    """
    levels = F.array(*[_scope_struct(level) for level in ("driver", "team", "all")])
    return df.repartition(*schemas.RACE, "Compound", *by).select("*", F.inline(levels))


def tyre_age_sums(counts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per race, scope, compound and tyre age: rows, rows with a lap delta, and their delta sum.

    A stint's fastest lap is found on rows already summed per stint and tyre age.  The delta sum is
    sum(lap time) - rows x fastest, so no lap is ever joined to its baseline.  Laps without a stint
    have no delta but count as rows.
    """
    per_age = counts.groupBy(*schemas.STINT, "TyreLife").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("LapTimeSeconds")).alias("_time"),
        F.min("LapTimeSeconds").alias("_fastest"),
    )
    fastest = F.min("_fastest").over(Window.partitionBy(*schemas.STINT))
    has_delta = F.col("Stint").isNotNull()
    per_stint = per_age.withColumn("_base", fastest).select(
        *schemas.RACE, "Driver", "Team", "Compound", "TyreLife", "n",
        F.when(has_delta, F.col("n")).otherwise(F.lit(0)).alias("n_delta"),
        F.when(has_delta, F.col("_time") - F.col("n") * F.col("_base")).otherwise(F.lit(0.0)).alias("delta_sum"),
    )
    sums = _to_scopes(per_stint, "TyreLife").groupBy(*schemas.RACE, *SCOPE, "Compound", "TyreLife").agg(
        F.sum("n").alias("n"), F.sum("n_delta").alias("n_delta"), F.sum("delta_sum").alias("delta_sum")
    )
    return add_track_features(sums, tracks)


def lap_time_counts(counts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per race, scope, compound, tyre freshness and lap time: rows."""
    fresh = (F.col("TyreLife") <= FRESH_LAPS).alias("fresh")
    per_scope = (
        _to_scopes(counts.select(*schemas.RACE, "Driver", "Team", "Compound", fresh, "LapTimeSeconds", "n"), "LapTimeSeconds")
        .groupBy(*schemas.RACE, *SCOPE, "Compound", "fresh", "LapTimeSeconds")
        .agg(F.sum("n").alias("n"))
    )
    return add_track(per_scope, tracks)


def scoped_slices(profiles: DataFrame, slices: DataFrame, tracks: DataFrame) -> DataFrame:
    """The slices of every scope some target needs, with the target's track type."""
    level = F.col("level")
    scopes = profiles.where(level.isNotNull()).select(
        *schemas.TARGET_RACE, "level",
        F.when(level == "driver", F.col("driver")).otherwise(F.lit("")).alias("scope_driver"),
        F.when(level != "all", F.col("team")).otherwise(F.lit("")).alias("scope_team"),
    ).distinct()
    typed = add_track(slices, tracks, on="target_event").select(
        *schemas.TARGET_RACE, *schemas.RACE, "weight", F.col("TrackType").alias("target_type")
    )
    return scopes.join(typed, schemas.TARGET_RACE)


def fit_lines(tyre_ages: DataFrame, scoped: DataFrame, strict: bool = False) -> DataFrame:
    """Line, tyre-age quantiles and row count per target race, scope and compound.

    Both row sets, all tracks and the target's kind of track, are summed in one pass and the
    choice is made on the sums.  The line comes from centred moments, merged point by point; a target has a
    point per slice and tyre age, however many laps there are.  ``strict`` makes one lap without a delta zero the line, else such
    laps are left out of the fit.
    """
    same = F.col("TrackType") == F.col("target_type")
    fresh = F.col("TyreLife") <= FRESH_LAPS
    age = F.col("TyreLifeKM")
    terms = {
        "rows": F.col("n"),
        "deltas": F.col("n_delta"),
        "fresh": F.when(fresh, F.col("n")).otherwise(F.lit(0)),
    }
    # The weight multiplies residuals, so it enters the sums squared.
    point = point_moments(age, F.col("delta_sum") / F.col("n_delta"), F.col("weight") * F.col("weight") * F.col("n_delta"))
    points = F.when(F.col("n_delta") > 0, F.struct(point.alias("moments"), same.alias("same")))
    measures = [F.array_sort(F.collect_list(points)).alias("points")]
    for prefix, chosen in (("a_", F.lit(True)), ("s_", same)):
        kept = F.when(chosen, age)
        measures += [F.sum(F.when(chosen, t)).alias(prefix + name) for name, t in terms.items()]
        measures += [
            F.min(kept).alias(prefix + "least"),
            F.max(kept).alias(prefix + "most"),
            F.percentile(kept, F.array(F.lit(0.75), F.lit(0.9)), F.col("n")).alias(prefix + "ages"),
        ]
    sums = (
        tyre_ages.join(scoped, [*schemas.RACE, *SCOPE])
        .groupBy(*FIT)
        .agg(*measures)
        .withColumn("same_track", F.coalesce(F.col("s_rows") >= MIN_SAME_TRACK_ROWS, F.lit(False)))
    )
    pick = {
        name: F.when(F.col("same_track"), F.col("s_" + name)).otherwise(F.col("a_" + name))
        for name in [*terms, "least", "most", "ages"]
    }
    used = F.filter("points", lambda p: ~F.col("same_track") | p["same"])
    chosen = sums.select(
        *FIT, "same_track", all_moments(F.transform(used, lambda p: p["moments"])).alias("total"),
        *[column.alias(name) for name, column in pick.items()],
    )
    slope, intercept = line(F.col("total"))
    fitted = (F.col("rows") >= MIN_FIT_ROWS) & (F.col("most") > F.col("least"))
    unusable = F.lit(strict) & (F.col("deltas") < F.col("rows"))
    return chosen.select(
        *FIT, "same_track", (F.col("fresh") > 0).alias("fresh_only"),
        F.when(~fitted, F.lit(DEFAULT_SLOPE)).when(unusable, F.lit(0.0))
        .otherwise(clamp_at_zero(slope)).alias("slope"),
        F.when(~fitted | unusable, F.lit(0.0)).otherwise(clamp_at_zero(intercept)).alias("intercept"),
        F.col("ages")[0].alias("age_q75"),
        F.col("ages")[1].alias("age_q90"),
        F.col("rows").alias("sample_size"),
    )


def fresh_laps(lap_times: DataFrame, scoped: DataFrame, lines: DataFrame) -> DataFrame:
    """Weighted median lap on fresh tyres per target race, scope and compound.

    Only rows a fit wants are paired with target races: laps on the chosen tracks, and fresh ones
    unless there are none.
    """
    wanted = lines.select(*FIT, "same_track", "fresh_only").join(
        scoped, [*schemas.TARGET_RACE, *SCOPE]
    )
    same = F.col("TrackType") == F.col("target_type")
    times = lap_times.join(wanted, [*schemas.RACE, *SCOPE, "Compound"]).where(
        (~F.col("same_track") | same) & (~F.col("fresh_only") | F.col("fresh"))
    )
    # Weights come in tenths.
    tenths = F.round(F.col("weight") * 10).cast("long")
    return weighted_median(times, FIT, "LapTimeSeconds", F.col("n") * tenths, "fresh_lap_time_sec")


def compound_models(
    profiles: DataFrame,
    lines: DataFrame,
    medians: DataFrame,
    lap_delta_window_sec: float = LAP_DELTA_WINDOW_SEC,
) -> DataFrame:
    """One row per target and compound: slope, intercept, window, fresh lap, sample size.

    Wet experience belongs to the target's driver and team, so it applies after the shared fit.
    """
    scoped = profiles.where(F.col("level").isNotNull()).select(
        "target_id", *schemas.TARGET_RACE, "level",
        F.when(F.col("level") == "driver", F.col("driver")).otherwise(F.lit("")).alias("scope_driver"),
        F.when(F.col("level") != "all", F.col("team")).otherwise(F.lit("")).alias("scope_team"),
        "track_length_km", "wet_experience_km",
    )
    reduction = F.least(F.lit(MAX_WET_REDUCTION), F.col("wet_experience_km") / F.lit(WET_REDUCTION_KM))
    slope = F.when(
        F.col("Compound").isin(WET_COMPOUNDS) & (F.col("wet_experience_km") > 0),
        F.col("slope") * (F.lit(1.0) - reduction),
    ).otherwise(F.col("slope"))
    by_slope = F.try_divide(F.lit(lap_delta_window_sec), F.col("slope_sec_per_km"))
    window = F.least(
        F.when(F.col("slope_sec_per_km") > FLAT_SLOPE, by_slope).otherwise(F.col("age_q75")),
        F.col("age_q90"),
    )
    laps = round_half_even(F.col("window_km") / F.col("track_length_km"))
    return (
        scoped.join(lines, [*schemas.TARGET_RACE, *SCOPE])
        .join(medians, FIT)
        .withColumn("slope_sec_per_km", slope)
        .withColumn("window_km", window)
        .select(
            "target_id", "Compound", "slope_sec_per_km",
            F.col("intercept").alias("intercept_sec"),
            "window_km",
            F.greatest(F.lit(1.0), laps).alias("window_laps"),
            "fresh_lap_time_sec",
            F.col("sample_size").cast("double").alias("sample_size"),
        )
    )


def overstay_table(
    models: DataFrame, profiles: DataFrame, max_extra_laps: int = OVERSTAY_LAPS
) -> DataFrame:
    """target, compound, extra_lap: added seconds of that lap and of all extra laps so far.

    The running total is added lap by lap inside the row, which needs no window.
    """
    per_lap = F.col("slope_sec_per_km") * F.col("track_length_km")
    running = F.aggregate(
        F.sequence(F.lit(1), F.col("extra_lap")), F.lit(0.0),
        lambda total, lap: total + F.col("_per_lap") * lap,
    )
    return (
        models.join(profiles.select("target_id", "track_length_km"), "target_id")
        .select(
            "target_id", "Compound", per_lap.alias("_per_lap"),
            F.explode(F.sequence(F.lit(1), F.lit(max_extra_laps))).alias("extra_lap"),
        )
        .select(
            "target_id", "Compound", "extra_lap",
            round_half_even(F.col("_per_lap") * F.col("extra_lap"), 3).alias("incremental_delta_sec"),
            round_half_even(running, 3).alias("cumulative_delta_sec"),
        )
    )
