"""Parquet tables: typed reads, session loads, partitioned writes, profiles."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapwise import schemas
from lapwise.functions.expressions import duration_seconds


def _missing_as_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL, once: Spark sorts NaN last and aggregates do not skip it."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its types; an absent nullable column becomes NULL.

    Interval columns become seconds and NaN becomes NULL.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        if field.name not in present:
            if not field.nullable:
                raise ValueError(f"column {field.name} is missing")
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif isinstance(present[field.name], T.DayTimeIntervalType):
            columns.append(duration_seconds(F.col(field.name)).alias(field.name))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return _missing_as_null(df.select(*columns))


def conform_laps(df: DataFrame) -> DataFrame:
    """Laps as recorded (``LapTime`` an interval) or already in seconds."""
    if "LapTimeSeconds" not in df.columns and "LapTime" in df.columns:
        df = df.withColumn("LapTimeSeconds", F.col("LapTime"))
    # Timing is in milliseconds; holding to that bounds the distinct values that medians and the
    # as-of join look at.
    return conform(df, schemas.LAPS).withColumns(
        {name: F.round(name, 3) for name in ("Time", "LapTimeSeconds")}
    )


def read_laps(spark: SparkSession, path: str) -> DataFrame:
    return conform_laps(spark.read.parquet(path))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), schemas.WEATHER).withColumn("Time", F.round("Time", 3))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), schemas.SCHEDULE)


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), schemas.TARGETS)


def load_session(
    laps: DataFrame, weather: DataFrame, year: int, event: str
) -> tuple[DataFrame, DataFrame]:
    """Laps and weather of one race.

    Tables are partitioned by session, so the event's rounds are looked up first, from its season,
    and both tables are then read by session.
    """
    season = laps.where(F.col("Year") == year)
    found = season.where(F.col("EventName") == event).select("RoundNumber").distinct().collect()
    rounds = F.col("RoundNumber").isin([row["RoundNumber"] for row in found])
    race = season.where(rounds & (F.col("EventName") == event))
    return race, weather.where((F.col("Year") == year) & rounds)


def in_sessions(sessions: DataFrame) -> Column:
    """Whether a row belongs to one of the given sessions (Year, RoundNumber).

    Sessions are races of the calendar, a few dozen a season however many laps they have, so they are
    collected here and become a filter; on tables partitioned by session it selects the files to read.
    """
    rounds: dict[int, list[int]] = {}
    for row in sessions.select(*schemas.SESSION).distinct().sort(*schemas.SESSION).collect():
        rounds.setdefault(row["Year"], []).append(row["RoundNumber"])
    found = F.lit(False)
    for year, numbers in rounds.items():
        found |= (F.col("Year") == year) & F.col("RoundNumber").isin(numbers)
    return found


def write_sessions(
    df: DataFrame, path: str, max_rows_per_file: int = 5_000_000, only_present: bool = False
) -> None:
    """One folder per session, so race and season filters prune files.

    ``only_present`` replaces the sessions that ``df`` has and leaves the others as they are.

    Rows are rebalanced by session: adaptive execution gathers small sessions and divides a session
    that holds a third of the rows among many tasks.  Long files are cut by row count.
    """
    (
        df.hint("rebalance", *schemas.SESSION)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_present else "static")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy(*schemas.SESSION)
        .parquet(path)
    )


def season_schedule(schedule: DataFrame) -> DataFrame:
    """Championship rounds only: test events have round 0 or none."""
    return schedule.where(F.col("RoundNumber") > 0)


def schema_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """column_name, data_type, row_count, null_count and the number of distinct values.

    One pass, one row per task to the final aggregate, with ``distinct_values`` an estimate.  With
    ``exact`` they are counted, which shuffles every column's distinct values.
    """
    measures = [F.count(F.lit(1)).alias("row_count")]
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        measures.append(F.count_if(column.isNull()).alias(f"n{i}"))
        count = F.count_distinct if exact else F.approx_count_distinct
        measures.append(count(column).alias(f"d{i}"))
    entries = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("row_count"),
            F.col(f"n{i}").alias("null_count"),
            F.col(f"d{i}").alias("distinct_values"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return df.agg(*measures).select(F.inline(F.array(*entries)))


#: Size of a sketch as a power of two: an error of 0.8 percent in at most 8 KB.
SKETCH_POWER = 14


def sketched_profile(df: DataFrame, by: Sequence[str] = schemas.SESSION) -> DataFrame:
    """``by``, column_name, data_type, row_count, null_count and a sketch of the distinct values of every other column.

    Rows are small whatever the number of laps and can be stored, by session for a growing table
    (``incremental.SessionTable`` builds those of changed sessions alone); ``merged_profile`` adds them up.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    measures = [F.count(F.lit(1)).alias("row_count")]
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        counted = column if field.dataType.typeName() == "binary" else column.cast("string")
        measures += [F.count_if(column.isNull()).alias(f"n{i}"), F.hll_sketch_agg(counted, SKETCH_POWER).alias(f"d{i}")]
    entries = [
        F.struct(
            F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("data_type"), "row_count",
            F.col(f"n{i}").alias("null_count"), F.col(f"d{i}").alias("sketch"),
        )
        for i, field in enumerate(fields)
    ]
    return df.groupBy(*by).agg(*measures).select(*by, F.inline(F.array(*entries)))


def merged_profile(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of everything that ``sketched_profile`` rows cover, whole or for each ``by`` (a season, say).

    As ``schema_profile`` of the rows themselves, with ``distinct_values`` from the union of the sketches.
    """
    return profiles.groupBy(*by, "column_name", "data_type").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
