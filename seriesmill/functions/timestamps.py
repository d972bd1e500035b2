"""Display timestamps such as ``2025-01-10 18:22 UTC (2025-01-10 12:22 -06)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three text forms and the offset assumed when none is shown.
EXPLICIT_UTC = r"(?i)(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})\s+UTC"
LOCAL_WITH_OFFSET = r"\((\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})\s+([+-]\d{2})\)"
PLAIN_CLOCK = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2})"
ASSUMED_OFFSET_HOURS = -6


def _clock(text: Column) -> Column:
    """UTC instant of a minute-precision clock text, null if it is no real time."""
    tidy = F.regexp_replace(text, r"\s+", " ")
    zoned = F.concat(tidy, F.lit(" +00:00"))  # whatever the session's zone is
    return F.when(tidy != "", F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd HH:mm XXX")))


def _shift(instant: Column, offset_hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(instant) - offset_hours.cast("long") * F.lit(3_600_000_000))


def parse_display_timestamp(text: Column) -> Column:
    """Struct (utc, method): explicit UTC, then local clock + offset, then an assumed offset."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    utc = _clock(F.regexp_extract(raw, EXPLICIT_UTC, 1))
    offset = F.regexp_extract(raw, LOCAL_WITH_OFFSET, 2)
    local = _shift(_clock(F.regexp_extract(raw, LOCAL_WITH_OFFSET, 1)), offset.try_cast("int"))
    naive = _shift(_clock(F.regexp_extract(raw, PLAIN_CLOCK, 1)), F.lit(ASSUMED_OFFSET_HOURS))
    method = (
        F.when(utc.isNotNull(), F.lit("explicit_utc"))
        .when(local.isNotNull(), F.concat(F.lit("explicit_offset_"), offset))
        .when(naive.isNotNull(), F.lit("display_clock_assumed_-06"))
    )
    return F.struct(F.coalesce(utc, local, naive).alias("utc"), method.alias("method"))
