"""Dimension look-ups: a miss keeps the row and takes the default.

The dimension's key must be unique.  No join is forced: Spark broadcasts the dimension where its
own size check allows, else it shuffles and splits skewed keys.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.sources.dims import DEFAULT_TRACK_KM, DEFAULT_TRACK_TYPE


def normalize_team(df: DataFrame, teams: DataFrame, column: str = "Team") -> DataFrame:
    """Team alias -> team name; an unknown name passes through."""
    names = teams.select(F.col("alias").alias("_alias"), F.col("team").alias("_name"))
    return (
        df.join(names, F.col(column) == F.col("_alias"), "left")
        .withColumn(column, F.coalesce("_name", column))
        .drop("_alias", "_name")
    )


def add_track(df: DataFrame, tracks: DataFrame, on: str = "EventName") -> DataFrame:
    """Adds TrackType and TrackLengthKM; an unlisted track is medium speed and 5 km."""
    known = tracks.select(
        F.col("name").alias("_name"), F.col("track_type").alias("_type"), F.col("length_km").alias("_km")
    )
    return (
        df.join(known, F.col(on) == F.col("_name"), "left")
        .withColumn("TrackType", F.coalesce("_type", F.lit(DEFAULT_TRACK_TYPE)))
        .withColumn("TrackLengthKM", F.coalesce("_km", F.lit(DEFAULT_TRACK_KM)))
        .drop("_name", "_type", "_km")
    )


def add_track_features(df: DataFrame, tracks: DataFrame, on: str = "EventName") -> DataFrame:
    """``add_track`` plus tyre age in km."""
    return add_track(df, tracks, on).withColumn(
        "TyreLifeKM", F.col("TyreLife") * F.col("TrackLengthKM")
    )
