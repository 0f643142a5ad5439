"""Column expressions.  All of them stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapwise.sources.dims import WET_COMPOUNDS


def round_half_even(value: Column, places: int = 0) -> Column:
    """Half-to-even rounding on doubles, far cheaper than the decimal route of ``bround``.

    Six more places are settled first, so a tie blurred by the order in which partitions were
    summed is still a tie, and the result does not depend on that order.
    """
    scale = float(10**places)
    near = F.rint(value * F.lit(scale * 1e6)) / F.lit(1e6)
    return F.rint(near) if places == 0 else F.rint(near) / F.lit(scale)


def clamp_at_zero(value: Column) -> Column:
    """max(0, value), where a missing value counts as 0."""
    return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def wet_flag(compound: Column, rainfall: Column) -> Column:
    """1 on a wet-weather tyre or in rain, else 0; unknown rain is no rain."""
    wet_tyre = F.coalesce(compound.isin(WET_COMPOUNDS), F.lit(False))
    return (wet_tyre | F.coalesce(rainfall.cast("boolean"), F.lit(False))).cast("int")


def duration_seconds(value: Column) -> Column:
    """Seconds in a day-time interval, whatever the session time zone."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, zero + value) / F.lit(1e6)


def event_key(*parts: Column) -> Column:
    """``year:event`` and, for failures, ``year:event:reason``."""
    return F.concat_ws(":", *[part.cast("string") for part in parts])
