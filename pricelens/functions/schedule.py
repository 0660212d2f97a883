"""What an hour of the day means for the run loop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_ZONE = "Asia/Yerevan"

COLLECT, FULL, NEW_ONLY, IDLE = "collect", "full", "new_only", "idle"

# Fixed values. Local hours: collect and forget at 6, full report at 9, new alerts 10 to 23.
COLLECT_HOUR, FULL_HOUR, FIRST_HOUR, LAST_HOUR = 6, 9, 10, 23


def local_time(ts: Column, zone: str = TIME_ZONE) -> Column:
    """Wall-clock time of a UTC instant in the business time zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def run_class(ts: Column, zone: str = TIME_ZONE) -> Column:
    return class_of_local(local_time(ts, zone))


def class_of_local(local: Column) -> Column:
    hour = F.hour(local)
    return (
        F.when(hour == COLLECT_HOUR, F.lit(COLLECT))
        .when(hour == FULL_HOUR, F.lit(FULL))
        .when(hour.between(FIRST_HOUR, LAST_HOUR), F.lit(NEW_ONLY))
        .otherwise(F.lit(IDLE))
    )
