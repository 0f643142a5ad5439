"""Row filters.  All push down to the Parquet scan."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.sources.dims import VALID_COMPOUNDS

GREEN = "1"


def clean_laps(laps: DataFrame) -> DataFrame:
    """Accurate laps under green on one of the five compounds."""
    return laps.where(
        F.col("IsAccurate") & (F.col("TrackStatus") == GREEN) & F.col("Compound").isin(VALID_COMPOUNDS)
    )


def completed_events(schedule: DataFrame, as_of: date | str) -> DataFrame:
    """Races run by ``as_of``.  A date that is missing or does not parse counts as not run yet."""
    day = F.col("EventDate").try_cast("date")
    return schedule.where(
        F.col("RoundNumber").isNotNull()
        & F.col("EventName").isNotNull()
        & (day <= F.lit(str(as_of)).cast("date"))
    )
