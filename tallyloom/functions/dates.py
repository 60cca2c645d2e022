"""Date and time functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: format elements of the source dialect and their Java letters
_ELEMENTS = {
    "YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE",
    "DY": "EEE", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS",
    "AM": "a", "PM": "a",
}


def java_pattern(fmt: str) -> str:
    """``MM/DD/YYYY HH24:MI:SS`` as ``MM/dd/yyyy HH:mm:ss``."""
    names = sorted(_ELEMENTS, key=len, reverse=True)
    return re.sub("|".join(names), lambda m: _ELEMENTS[m.group(0)], fmt)


def now(as_of: str | None = None) -> Column:
    """SYSDATE: one value per query; ``as_of`` pins it."""
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def today(as_of: str | None = None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def to_date(c: Column, fmt: str, java: bool = False) -> Column:
    """TO_DATE / parseDate: timestamp, NULL when the text does not fit."""
    return F.try_to_timestamp(c, F.lit(fmt if java else java_pattern(fmt)))


def to_char(c: Column, fmt: str, java: bool = False) -> Column:
    return F.date_format(c, fmt if java else java_pattern(fmt))


def part(c: Column, field: str) -> Column:
    """Year, Month, Day, Hour, Minute, Second."""
    return {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    }[field.lower()](c)


def weekday(c: Column, first: int = 1) -> Column:
    """Day of week with ``first`` (1 = Sunday) as day 1."""
    return F.pmod(F.dayofweek(c) - F.lit(first), F.lit(7)) + 1


def make(y: Column, m: Column, d: Column) -> Column:
    """Date/DateSerial(y, m, d) with overflow: month 13 is January of the next year, day 0 the day before."""
    months = (y * 12 + m - 1).cast("int")
    start = F.make_date(F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)) + 1, F.lit(1))
    return F.date_add(start, (d - 1).cast("int"))


def to_day(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """CDate(s) / DateValue(s)."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def diff(unit: str, start: Column, end: Column) -> Column:
    """Interval crossings: days, month borders or year borders between the dates."""
    if unit == "d":
        return F.datediff(end, start)
    years = F.year(end) - F.year(start)
    if unit == "yyyy":
        return years
    if unit == "m":
        return years * 12 + F.month(end) - F.month(start)
    raise ValueError("unit must be d, m or yyyy")


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Completed days, months or years, negative backwards.

    A month is complete when the day of month and the time of day it began at are reached: from 31 January none is complete
    before March, and from 29 February no year before 1 March.
    """
    if unit == "d":
        return F.datediff(end, start)
    if unit not in ("m", "yyyy"):
        raise ValueError("unit must be d, m or yyyy")

    def into_month(c: Column) -> Column:
        return F.dayofmonth(c) * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    borders, left = diff("m", start, end), into_month(end) - into_month(start)
    whole = borders - F.when((borders > 0) & (left < 0), 1).when((borders < 0) & (left > 0), -1).otherwise(0)
    if unit == "m":
        return whole.cast("int")
    return (F.signum(whole) * F.floor(F.abs(whole) / 12)).cast("int")


def add(unit: str, c: Column, n: Column | int) -> Column:
    """Date plus days, months (end of month kept valid) or years."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "d":
        return F.date_add(c, n)
    if unit == "m":
        return F.add_months(c, n)
    if unit == "yyyy":
        return F.add_months(c, n * 12)
    raise ValueError("unit must be d, m or yyyy")


def compare(a: Column, b: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """-1, 0 or 1 by the formatted text of both dates."""
    x, y = F.date_format(a, fmt), F.date_format(b, fmt)
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(x < y, -1).when(x > y, 1).otherwise(0)


def is_date(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).isNotNull()


# fixed value: day serial of 1970-01-01
EPOCH_SERIAL = 2_440_587


def serial_to_date(n: Column) -> Column:
    """Julian day serial to date."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - EPOCH_SERIAL).cast("int"))


def packed_to_timestamp(n: Column) -> Column:
    """Day serial in the low 32 bits, seconds of the day in the high 32; an impossible time becomes midnight."""
    day = serial_to_date(n.bitwiseAND(F.lit(0xFFFFFFFF)))
    seconds = F.shiftrightunsigned(n, 32)
    real = F.when(seconds >= 86_400, F.lit(0)).otherwise(seconds)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + real)


def seconds_to_time(n: Column) -> Column:
    """Seconds of the day as ``HH:mm:ss``."""
    s = F.pmod(n, F.lit(86_400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
