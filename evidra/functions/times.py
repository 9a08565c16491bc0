"""Times as Columns: micro- and nanosecond numbers, and the text forms met in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{name}`)")
    return F.unix_micros(F.col(name).cast("timestamp"))


def from_micros(c: str) -> Column:
    """The zone-less timestamp of a column of microseconds."""
    return F.expr(f"timestampadd(MICROSECOND, `{c}`, {EPOCH})")


def show_seconds(c: str) -> Column:
    """A column of microseconds as `yyyy-MM-dd HH:mm:ss`."""
    return F.date_format(from_micros(c), "yyyy-MM-dd HH:mm:ss")


def day_number(text: Column) -> Column:
    """Days since 1970 of a date in one of the forms y-m-d, y/m/d, y.m.d, yyyymmdd, d.m.y; null if it is none or doesn't exist."""
    t = F.trim(text)
    ymd, dmy = r"^(\d{4})([-/.]?)(\d{2})\2(\d{2})$", r"^(\d{2})\.(\d{2})\.(\d{4})$"
    iso = (
        F.when(t.rlike(ymd), F.regexp_replace(t, ymd, "$1-$3-$4"))
        .when(t.rlike(dmy), F.regexp_replace(t, dmy, "$3-$2-$1"))
    )
    return F.unix_date(iso.try_cast("date"))


def day_in_form(text: Column, form: Column) -> Column:
    """Days since 1970 of a date that is written in the form of that name (see `functions.forms`); null if it doesn't exist or the form is no date. A slashed date of unknown order is read day first."""
    part = lambda by, *order: F.concat_ws("-", *(F.get(F.split(text, by), F.lit(i)) for i in order))
    iso = (
        F.when(form == "date_ymd", text)
        .when(form == "date_compact", F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        .when(form == "date_dmy", part(r"\.", 2, 1, 0))
        .when(form == "date_slash_ymd", F.replace(text, F.lit("/"), F.lit("-")))
        .when(form.isin("date_slash_dmy", "date_slash"), part("/", 2, 1, 0))
        .when(form == "date_slash_mdy", part("/", 2, 0, 1))
    )
    return F.unix_date(iso.try_cast("date"))


#: A time of day, `HH:mm[:ss[.f]]`.
TIME = r"^\s*([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:[.,](\d{1,9})\d*)?)?Z?\s*$"


def nanos_of_day(text: Column) -> Column:
    """Nanoseconds since midnight of `HH:mm[:ss[.f]]`, up to nine digits of fraction; null if it is no time."""
    t = F.trim(text)
    number = lambda at, size: F.coalesce(F.substring(t, at, size).try_cast("long"), F.lit(0))
    seconds = number(1, 2) * 3600 + number(4, 2) * 60 + number(7, 2)
    fraction = F.when(F.length(t) > 9, F.rpad(F.regexp_replace(F.substring(t, 10, 9), r"\D", ""), 9, "0").cast("long")).otherwise(0)
    return F.when(t.rlike(TIME), seconds * 1_000_000_000 + fraction)
