"""Times as transcripts write them (ISO with an offset) and as people read them (the session's time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last second of the year 9999.
LAST_SECOND = 253_402_300_799


def instant(raw: Column) -> Column:
    """The time that a text with an offset names; null for all else."""
    return F.when(raw.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d.*([Zz]|[+-]\d\d(:?\d\d)?)$"), F.try_to_timestamp(F.upper(raw)))


def zone(ts: Column) -> Column:
    """The zone's short name and offset: AEST(UTC+10), IST(UTC+05:30); the offset alone where the zone has no name."""
    offset, name = F.date_format(ts, "xxx"), F.date_format(ts, "z")
    hours = F.regexp_extract(offset, "^[+-](\\d\\d)", 1).cast("int").cast("string")
    short = F.when(offset.endswith(":00"), F.concat(F.substring(offset, 1, 1), hours)).otherwise(offset)
    marker = F.concat(F.lit("(UTC"), short, F.lit(")"))
    return F.when(name.rlike("^([+-]|(GMT|UTC)[+-])"), marker).otherwise(F.concat(name, marker))


def shown(raw: Column, millis: bool = False) -> Column:
    """A time in the session's zone with its marker; a dash for none; what is no time stands as it is, marked."""
    ts = instant(raw)
    text = F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss" + (".SSS" if millis else "")), F.lit(" "), zone(ts))
    return F.coalesce(text, F.concat(raw, F.lit(" (unparsed)")), F.lit("\u2014"))


def epoch_ms(raw: Column) -> Column:
    return F.unix_millis(instant(raw))


def local_iso(raw: Column) -> Column:
    """The time in the session's zone, as ISO with an offset."""
    return F.date_format(instant(raw), "yyyy-MM-dd'T'HH:mm:ssxxx")


def utc_of_seconds(seconds: Column) -> Column:
    """Seconds since 1970 as ISO in UTC; null past the year 9999."""
    ts = F.to_utc_timestamp(F.timestamp_seconds(F.when(seconds.between(0, LAST_SECOND), seconds)), F.current_timezone())
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def closed_ms(value: Column) -> Column:
    """When a checkpoint closed: the sum of its members startTime and totalDuration, if both are numbers of at least 0."""
    of = lambda key: F.when(F.get_json_object(value, f"$.{key}").try_cast("double") >= 0, F.get_json_object(value, f"$.{key}").try_cast("double"))
    return F.floor(of("startTime") + of("totalDuration")).cast("long")


def expired(expires: Column, now: Column) -> Column:
    """Whether a deadline has come; a time that can't be read never has."""
    return F.coalesce(instant(expires) <= instant(now), F.lit(False))


def latest(*raw: Column) -> Column:
    """The latest of several ISO times; null if there is none."""
    return F.greatest(*raw) if len(raw) > 1 else raw[0]
