"""Calendar columns. Epoch seconds are UTC; local columns are wall-clock timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def local_time(epoch, tz: str = C.LOCAL_TZ) -> Column:
    """Epoch seconds to the wall clock of ``tz`` (session zone must be UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(_col(epoch)), tz)


def utc_date(epoch) -> Column:
    """UTC date of epoch seconds."""
    return F.to_date(F.timestamp_seconds(_col(epoch)))


def with_local_times(df: DataFrame, start="start", end="end", tz: str = C.LOCAL_TZ) -> DataFrame:
    """Add arrival ``localtime`` and departure ``l_localtime``."""
    return df.withColumns({"localtime": local_time(start, tz), "l_localtime": local_time(end, tz)})


def calendar_parts(when) -> dict[str, Column]:
    """Hour, month, year, weekday (Monday 0), ISO week and date of a timestamp."""
    when = _col(when)
    return {
        "hour": F.hour(when), "month": F.month(when), "year": F.year(when),
        "weekday": F.weekday(when), "week": F.weekofyear(when), "date": F.to_date(when),
    }


def time_bin(hour) -> Column:
    """Morning, afternoon or evening; a NULL hour counts as evening."""
    hour = _col(hour)
    return (
        F.when((hour >= C.MORNING_HOUR) & (hour < C.AFTERNOON_HOUR), "morning")
        .when((hour >= C.AFTERNOON_HOUR) & (hour < C.EVENING_HOUR), "afternoon")
        .otherwise("evening")
    )


def day_type(weekday) -> Column:
    """Weekday or weekend from a Monday-0 weekday number."""
    return F.when(_col(weekday) >= 5, "weekend").otherwise("weekday")


def lenient_timestamp(text) -> Column:
    """Parse a timestamp string; what cannot be parsed becomes NULL."""
    return F.try_to_timestamp(_col(text))


def tick_epochs(start, end, minutes: int = C.TICK_MINUTES) -> Column:
    """Array of epoch seconds from ``start`` to at most ``end`` in absolute steps."""
    start, end = _col(start), _col(end)
    return F.when(end >= start, F.sequence(start, end, F.lit(minutes * 60).cast("bigint")))
