"""Dates of vintage systems as Catalyst expressions; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAC_EPOCH, Y2K = 2082844800, 946684800


def mac_timestamp(seconds: Column) -> Column:
    """Seconds since 1904; 0 is no date."""
    return F.when(seconds != 0, F.timestamp_seconds(seconds.cast("long") - MAC_EPOCH))


def mac_seconds(when: Column) -> Column:
    return F.coalesce(F.unix_timestamp(when.cast("timestamp")) + MAC_EPOCH, F.lit(0))


def y2k_timestamp(seconds: Column) -> Column:
    """Signed seconds since 2000."""
    return F.timestamp_seconds(seconds.cast("long") + Y2K)


def prodos_timestamp(date: Column, time: Column, hours: int = 0xFF, minutes: int = 0xFF) -> Column:
    """Packed ProDOS date and time: years under 40 are 20xx, month and day are clamped, a day past
    the month's end rolls over; 0 is no date. Directories mask hours with 1F and minutes with 3F."""
    part = lambda x, shift, mask: F.shiftright(x.cast("int"), shift).bitwiseAND(F.lit(mask))
    year = part(date, 9, 127)
    year = F.when(year < 40, year + 2000).otherwise(year + 1900)
    month = F.greatest(F.least(part(date, 5, 15), F.lit(12)), F.lit(1))
    day = F.greatest(part(date, 0, 31), F.lit(1))
    start = F.make_date(year, month, F.lit(1)).cast("timestamp")
    seconds = (day - 1) * 86400 + F.least(part(time, 8, hours), F.lit(23)) * 3600 + F.least(part(time, 0, minutes), F.lit(59)) * 60
    return F.when(date != 0, F.timestamp_seconds(F.unix_timestamp(start) + seconds))


def iso(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def newer_than(when: Column, as_of: Column, days: int) -> Column:
    return when > as_of - F.expr(f"INTERVAL {int(days)} DAYS")
