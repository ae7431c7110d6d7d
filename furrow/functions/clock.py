"""UTC clock columns and local periods of the day.

Times in the library are ``timestamp_ntz`` columns that hold UTC, so results
do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_clock(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Turn an instant column into its UTC clock reading; clock columns stay."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn(ts, F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch))


def local_clock(ts: Column, zone: str) -> Column:
    """Local clock reading of a UTC clock column."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def seconds_of_day(clock: Column) -> Column:
    return F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)


def period_starts(limits) -> list[int]:
    """Start seconds of the periods cut by ``HH:MM`` limits; the day's end closes the last."""
    if not limits:
        raise ValueError("period limits are empty")
    cuts = []
    for limit in limits:
        hours, minutes = str(limit).split(":")
        if not (0 <= int(hours) < 24 and 0 <= int(minutes) < 60):
            raise ValueError(f"bad period limit {limit!r}")
        cuts.append(int(hours) * 3600 + int(minutes) * 60)
    if cuts != sorted(cuts):
        raise ValueError("period limits must ascend")
    return [0, *cuts]


def period_index(clock: Column, limits) -> Column:
    """0-based period of a local clock column: half-open, so a limit starts the next."""
    starts = period_starts(limits)
    second = seconds_of_day(clock)
    return sum((F.when(second >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0)).cast("int")
