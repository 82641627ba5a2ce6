"""Date parsing and periods. Rules that depend on the clock take it as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutflow.functions.numbers import tenths_text, whole_text


def flexible_date(text: Column) -> Column:
    """``dd.MM.yyyy``, ``MM.yyyy`` or ``yyyy`` (first day of what is left open); null otherwise."""
    t = F.trim(text)
    return F.coalesce(
        F.when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(t, "dd.MM.yyyy")),
        F.when(t.rlike(r"^\d{2}\.\d{4}$"), F.try_to_date(F.concat(F.lit("01."), t), "dd.MM.yyyy")),
        F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(F.lit("01.01."), t), "dd.MM.yyyy")),
    )


def first_date(text: Column) -> Column:
    """The first ``dd.MM.yyyy`` in a text."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("")), "dd.MM.yyyy")


def year_of_text(text: Column) -> Column:
    return F.substring(text, 1, 4).try_cast("int")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_week_key(day: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def anniversary(day: Column, as_of: Column) -> Column:
    """The day's anniversary in the year of ``as_of``; 29 February counts as the 28th."""
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.make_date(F.year(as_of), F.month(day), F.when(leap, 28).otherwise(F.dayofmonth(day)))


def near_anniversary(day: Column, as_of: Column, days: int = 60) -> Column:
    return F.abs(F.datediff(anniversary(day, as_of), as_of)) <= days


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400.0


def age_text(days: Column) -> Column:
    return (
        F.when(days.isNull(), "never")
        .when(days < 1, F.concat(whole_text(days * 24), F.lit(" hours")))
        .when(days < 30, F.concat(whole_text(days), F.lit(" days")))
        .when(days < 365, F.concat(tenths_text(days / 30), F.lit(" months")))
        .otherwise(F.concat(tenths_text(days / 365), F.lit(" years")))
    )
