"""Calendar columns derived from timestamps, dates and yyyymmdd keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogon.functions.money import integer_div

# Spanish month names (1..12), ISO weekday names (1 = Monday .. 7 =
# Sunday) and the day parts with the first hour of each.
MONTH_NAMES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio",
    "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
DAY_NAMES = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")
DAYPARTS = ((0, "madrugada"), (6, "manana"), (12, "tarde"), (18, "noche"))


# A zone behind the time of day: Z, +hh:mm, -hhmm, or a zone name.
_OFFSET = r"\d:\d{1,2}(:\d{1,2}(\.\d+)?)?\s*(Z|z|UTC.*|GMT.*|[+-]\d.*|[A-Za-z]+/[A-Za-z_]+)\s*$"


def local_timestamp(df: DataFrame, name: str) -> Column:
    """Wall-clock timestamp of a column that may be text or a timestamp.

    Text with an offset (or Z) is an instant and is shown in the session's time zone;
    text without one is taken as it stands. Text that is no timestamp becomes NULL
    (instead of failing the job under ANSI).
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        has_offset = F.col(name).rlike(_OFFSET)
        return F.when(
            has_offset, F.col(name).try_cast("timestamp").cast("timestamp_ntz")
        ).otherwise(F.col(name).try_cast("timestamp_ntz"))
    return F.col(name)


def local_date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).try_cast("date")
    return F.to_date(name)


def date_key(when: Column) -> Column:
    """yyyymmdd as INT."""
    return (F.year(when) * 10000 + F.month(when) * 100 + F.dayofmonth(when)).cast("int")


def date_of_key(key: Column) -> Column:
    return F.make_date(year_of_key(key), month_of_key(key), F.pmod(key, F.lit(100)))


def year_of_key(key: Column) -> Column:
    return integer_div(key, F.lit(10000)).cast("int")


def month_of_key(key: Column) -> Column:
    return F.pmod(integer_div(key, F.lit(100)), F.lit(100)).cast("int")


def quarter_label(month: Column) -> Column:
    return F.concat(F.lit("Q"), integer_div(month + 2, F.lit(3)).cast("string"))


def month_label(year: Column, month: Column) -> Column:
    # format_string prints NULL arguments, so they are kept out of it
    return F.when(month.isNotNull(), F.format_string("%04d-%02d", year, month))


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month)


def iso_weekday(day: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(day) + 1


def day_name(iso_day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), iso_day)


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def daypart(hour: Column) -> Column:
    label = F.lit(None).cast("string")
    for first_hour, name in DAYPARTS:
        label = F.when(hour >= first_hour, F.lit(name)).otherwise(label)
    return label
