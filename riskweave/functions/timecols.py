"""Time arithmetic on TIMESTAMP_NTZ columns that hold UTC.

Nothing here looks at the session time zone, so a result does not depend on who runs the job.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import constants as K

_DAY, _HOUR, _MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of an NTZ timestamp, as BIGINT."""
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (
        F.unix_date(ts.cast("date")).cast("long") * _DAY
        + F.hour(ts).cast("long") * _HOUR
        + F.minute(ts).cast("long") * _MINUTE
        + seconds
    )


def expires_at(timestamp: Column, ttl_hours: Column) -> Column:
    return timestamp + F.make_dt_interval(F.lit(0), ttl_hours)


def is_live(at: Column, expiry: Column) -> Column:
    """A signal is live strictly before its expiry instant."""
    return at < expiry


def effective_time(timestamp: Column, arrival: Column) -> Column:
    """The publisher's clock, never ahead of the moment the row arrived."""
    return F.least(timestamp, arrival)


def latest_tolerated(arrival: Column) -> Column:
    return arrival + F.make_dt_interval(mins=F.lit(K.MAX_CLOCK_SKEW_MINUTES))


def ntz(literal: str) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


def utc_from_offset_text(text: Column) -> Column:
    """Parse ISO text that carries an offset to UTC; text without an offset gives NULL."""
    pattern = r"\A(.+?)(Z|[+-]\d{2}:\d{2})\z"
    wall = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    offset = F.regexp_extract(text, pattern, 2)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    hours = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0))
    return wall.try_cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(0), sign * hours, sign * minutes
    )
