"""Lap-time prediction for a table of laps to score."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise import schemas
from lapwise.functions.expressions import wet_flag
from lapwise.operators.lookups import add_track_features, normalize_team

# What a lap to score gets for conditions it does not give.
DEFAULTS = {
    "air_temp": 30.0,
    "track_temp": 40.0,
    "humidity": 50.0,
    "rainfall": False,
    "wind_speed": 2.0,
    "team_baseline_pace": 100.0,
    "field_baseline_pace": 100.0,
}

RENAMED = {
    "driver": "Driver", "team": "Team", "lap_number": "LapNumber", "tyre_life_laps": "TyreLife",
    "compound": "Compound", "stint": "Stint", "air_temp": "AirTemp", "track_temp": "TrackTemp",
    "humidity": "Humidity", "team_baseline_pace": "TeamBaselinePace",
    "field_baseline_pace": "FieldBaselinePace",
}


def scoring_features(to_score: DataFrame, teams: DataFrame, tracks: DataFrame) -> DataFrame:
    """The model's columns beside the given ones.  Wind has a default but is no feature."""
    given = [c for c in to_score.columns if c not in schemas.TO_SCORE.names]
    filled = to_score.fillna({k: v for k, v in DEFAULTS.items() if k in to_score.columns})
    for name, value in DEFAULTS.items():
        if name not in to_score.columns:
            filled = filled.withColumn(name, F.lit(value))
    named = filled.select(
        *given, "track_name", F.col("rainfall").cast("int").alias("Rainfall"),
        *[F.col(old).alias(new) for old, new in RENAMED.items()],
    )
    return (
        add_track_features(normalize_team(named, teams), tracks, on="track_name")
        .withColumn("IsWet", wet_flag(F.col("Compound"), F.col("Rainfall")))
        .withColumn("RelativePace", F.col("TeamBaselinePace") - F.col("FieldBaselinePace"))
        .select(*given, "track_name", *schemas.CATEGORICAL, *schemas.NUMERIC)
    )


def score_laps(
    model: PipelineModel, to_score: DataFrame, teams: DataFrame, tracks: DataFrame
) -> DataFrame:
    """``to_score`` features with ``prediction``, the lap time in seconds.  No shuffle.

    A row that lacks a numeric input is predicted with the training rows' median in its place, and ``missing``
    names what it lacks, comma-separated.  ``missing`` is empty for the others.
    """
    features = scoring_features(to_score, teams, tracks)
    lacking = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in schemas.NUMERIC])
    return model.transform(features.withColumn("missing", lacking)).select(*features.columns, "prediction", "missing")


def score_laps_by_era(
    models: dict[str, PipelineModel],
    default: PipelineModel,
    to_score: DataFrame,
    eras: DataFrame,
    teams: DataFrame,
    tracks: DataFrame,
    year: str = "year",
) -> DataFrame:
    """Each lap scored once, by the model of its year's era, or by ``default`` if that has none.

    Where eras overlap, a year belongs to the one that starts first.
    """
    seasons = (
        eras.select("start_year", "era", F.explode(F.sequence(F.col("start_year"), F.col("end_year"))).alias(year))
        .groupBy(year).agg(F.min(F.struct("start_year", "era")).alias("_first"))
        .select(year, F.col("_first.era").alias("era"))
    )
    rows = to_score.join(seasons, year, "left").withColumn(
        "era", F.when(F.col("era").isin(list(models)), F.col("era"))
    )
    parts = [score_laps(default, rows.where(F.col("era").isNull()), teams, tracks)]
    parts += [
        score_laps(model, rows.where(F.col("era") == era), teams, tracks)
        for era, model in models.items()
    ]
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored
