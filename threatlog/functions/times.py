"""Reading the time texts found in logs, as wall-clock ``TIMESTAMP_NTZ`` columns.

Every reader gives NULL for text it does not understand.  Common layouts are rewritten
to ISO form and cast, which Spark does without a formatter object per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import EPOCH_MILLIS_ABOVE

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_NUMBERS = "01  02  03  04  05  06  07  08  09  10  11  12"
_ZONE = r"(Z|[+-]\d{2}:?\d{2})"


def month_number(name: Column) -> Column:
    """Two-digit month of a three-letter English name, NULL for anything else."""
    at = F.instr(F.lit(_MONTHS), F.lower(name))
    known = (F.length(name) == 3) & (at > 0) & (F.pmod(at - 1, F.lit(4)) == 0)
    return F.when(known, F.substring(F.lit(_NUMBERS), at, F.lit(2)))


def as_wall_clock(text: Column) -> Column:
    """ISO-like text without a zone to a wall-clock time."""
    return text.try_cast("timestamp_ntz")


def access_time(text: Column) -> Column:
    """``20/May/2026:17:00:00 +0000``; the zone is required and the wall clock kept."""
    usual = text.rlike(r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$")
    fixed = F.concat(
        F.substring(text, 8, 4), F.lit("-"), month_number(F.substring(text, 4, 3)), F.lit("-"),
        F.substring(text, 1, 2), F.lit(" "), F.substring(text, 13, 8),
    )
    known = text.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2} " + _ZONE + "$")
    return F.when(usual, as_wall_clock(fixed)).when(
        known, clock_of_slashed_date(F.substring_index(text, " ", 1))
    )


def clock_of_slashed_date(text: Column) -> Column:
    """``20/May/2026:17:00:00`` without a zone."""
    date = F.substring_index(text, ":", 1)
    year = F.substring_index(date, "/", -1)
    month = month_number(F.substring_index(F.substring_index(date, "/", 2), "/", -1))
    day = F.substring_index(date, "/", 1)
    clock = F.substr(text, F.length(date) + F.lit(2))
    return as_wall_clock(F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock))


def yearless_time(text: Column, year: int) -> Column:
    """``May 20 17:00:00`` in the given year; any run of blanks between the parts."""
    parts = F.split(text, r"(?U)\s+")
    return as_wall_clock(
        F.concat(F.lit(f"{year:04d}-"), month_number(parts[0]), F.lit("-"), parts[1], F.lit(" "), parts[2])
    )


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of ``Z``, ``+0530`` or ``-05:30``."""
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    return F.when(zone == "Z", F.lit(0)).when(zone.startswith("-"), -minutes).otherwise(minutes)


def json_time(text: Column) -> Column:
    """A JSON time field: epoch seconds, epoch milliseconds or one of five ISO-like layouts.

    Epoch numbers become the wall clock of the session time zone.
    """
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))
    micros = F.when(number > EPOCH_MILLIS_ABOVE, number * 1000).otherwise(number * 1000000)
    epoch = F.timestamp_micros(F.round(micros).try_cast("bigint")).cast("timestamp_ntz")
    iso = text.rlike(
        r"^\d{4}-\d{1,2}-\d{1,2}(?:T\d{1,2}:\d{1,2}:\d{1,2}(?:(?:\.\d{1,6})?Z|[+-]\d{2}:?\d{2})?"
        r"| \d{1,2}:\d{1,2}:\d{1,2})$"
    )
    wall = F.regexp_extract(text, r"^[0-9-]+[T ][0-9:.]+", 0)
    return F.when(number.isNotNull(), epoch).when(iso, as_wall_clock(wall))


def json_offset_minutes(text: Column) -> Column:
    """Offset of an ISO time; a closing ``Z`` is only a letter of the layout there, so it gives NULL."""
    zone = F.regexp_extract(text, r"T[0-9:]+([+-]\d{2}:?\d{2})$", 1)
    return F.when(zone != "", offset_minutes(zone))


def iso_text(ts: Column, offset: Column | None = None) -> Column:
    """ISO text of a wall-clock time: micros only when not zero, offset only when known."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    text = F.when(micros == "000000", text).otherwise(F.concat(text, F.lit("."), micros))
    if offset is None:
        return text
    sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(offset)
    zone = F.concat(
        sign,
        F.lpad((size / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    return F.concat(text, F.coalesce(zone, F.lit("")))


def hour_number(ts: Column) -> Column:
    """Hours since 1970 of a wall-clock time, without going through a time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 24 + F.hour(ts)


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, without going through a time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.extract(F.lit("SECOND"), ts) * 1000000
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60000000 + seconds.cast("bigint")


def wall_clock(micros: Column) -> Column:
    """The reverse of :func:`wall_micros`."""
    days = F.floor(micros / 86400000000)
    seconds = ((micros - days * 86400000000) / 1000000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)
