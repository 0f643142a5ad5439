"""Per-group baselines put back on the laps.

Every baseline is an aggregate with map-side combine, joined back, rather than a window over the
laps: a window would pull a hot session or stint into one task, while the join either broadcasts
the small aggregate or, when that is too large, splits the hot key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.schemas import SESSION, STINT


def session_paces(laps: DataFrame) -> DataFrame:
    """Year, RoundNumber, Team, TeamBaselinePace, FieldBaselinePace: exact median lap times.

    Laps first collapse to (session, team, lap time) counts.  Lap times come in milliseconds, so a
    group keeps at most 1000 values per second of its spread, however many laps it has, and that
    is what the medians below hold in memory.  Laps without a team count for the field only.
    """
    counts = laps.groupBy(*SESSION, "Team", "LapTimeSeconds").agg(F.count(F.lit(1)).alias("_n"))
    median = F.percentile("LapTimeSeconds", F.lit(0.5), F.col("_n"))
    teams = counts.groupBy(*SESSION, "Team").agg(median.alias("TeamBaselinePace"))
    field = counts.groupBy(*SESSION).agg(median.alias("FieldBaselinePace"))
    return teams.join(field, SESSION).withColumn(
        "TeamBaselinePace", F.when(F.col("Team").isNotNull(), F.col("TeamBaselinePace"))
    )


def pace_baselines(laps: DataFrame, paces: DataFrame | None = None) -> DataFrame:
    """Adds FieldBaselinePace, TeamBaselinePace and RelativePace = team - field."""
    paces = session_paces(laps) if paces is None else paces
    right = paces.select(
        *[F.col(c).alias(f"_{c}") for c in [*SESSION, "Team"]], "TeamBaselinePace", "FieldBaselinePace"
    )
    match = [F.col(c) == F.col(f"_{c}") for c in SESSION]
    match.append(F.col("Team").eqNullSafe(F.col("_Team")))
    return (
        laps.join(right, match, "left")
        .drop(*[f"_{c}" for c in [*SESSION, "Team"]])
        .withColumn("RelativePace", F.col("TeamBaselinePace") - F.col("FieldBaselinePace"))
    )


def lap_delta(laps: DataFrame) -> DataFrame:
    """Adds StintBaseline (fastest lap of the stint) and LapDelta.

    A lap with a missing stint key has neither: a plain equality join never matches it.
    """
    fastest = laps.groupBy(*STINT).agg(F.min("LapTimeSeconds").alias("StintBaseline"))
    return laps.join(fastest, STINT, "left").withColumn(
        "LapDelta", F.col("LapTimeSeconds") - F.col("StintBaseline")
    )
