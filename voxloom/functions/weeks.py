"""ISO weeks and rolling review windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import strip


def iso_year_of(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week_of(day: Column) -> Column:
    return F.extract(F.lit("WEEK"), day)


def week_monday(year: Column, week: Column) -> Column:
    """4 January always lies in week 1."""
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, (week - 1) * 7)


def week_sunday(year: Column, week: Column) -> Column:
    return F.date_add(week_monday(year, week), 6)


def window_start(year: Column, week: Column, weeks: int = 10) -> Column:
    """First day of the review window: the Sunday `weeks` weeks before the week's own Sunday."""
    return F.date_sub(week_sunday(year, week), 7 * weeks)


def window_end(year: Column, week: Column) -> Column:
    """Last day of the review window; it counts until midnight."""
    return week_sunday(year, week)


def max_iso_week(year: Column) -> Column:
    """28 December always lies in the last week of its ISO year."""
    return iso_week_of(F.make_date(year, F.lit(12), F.lit(28)))


def format_iso_week(year: Column, week: Column) -> Column:
    return F.format_string("%d-W%02d", year, week)


def parse_iso_week(df: DataFrame, text: str) -> DataFrame:
    """Add `iso_year`, `iso_week` and `reason` (NULL when the text names an existing week)."""
    shape = r"^(\d{4})-W(\d{1,2})$"
    trimmed = strip(F.col(text))
    year = F.regexp_extract(trimmed, shape, 1).try_cast("int")
    week = F.regexp_extract(trimmed, shape, 2).try_cast("int")
    reason = (
        F.when(year.isNull() | week.isNull(), "bad format")
        .when(~week.between(1, 53), "week out of range")
        .when((year < 1) | (week > max_iso_week(year)), "no such week in year"))
    out = df.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.withColumns({"iso_year": F.when(ok, year), "iso_week": F.when(ok, week)})


def own_week(df: DataFrame, date: str = "date") -> DataFrame:
    """Add the ISO year and week a row's own date lies in."""
    return df.withColumns({"iso_year": iso_year_of(F.col(date)), "iso_week": iso_week_of(F.col(date))})


def assign_windows(df: DataFrame, date: str = "date", weeks: int = 10) -> DataFrame:
    """One row per review window a row lies in, with the window's ISO year and week.

    A window runs from Sunday to Sunday, both included, so a row lies in `weeks` windows and
    one dated on a Sunday in one more. The windows are computed from the date: no join.
    """
    day = F.col(date).cast("date")
    next_sunday = F.date_add(F.date_trunc("week", F.col(date)).cast("date"), 6)
    sundays = F.sequence(next_sunday, F.date_add(day, 7 * weeks), F.expr("interval 7 days"))
    out = df.withColumn("_sunday", F.explode(sundays))
    return out.withColumns(
        {"iso_year": iso_year_of(F.col("_sunday")), "iso_week": iso_week_of(F.col("_sunday"))}).drop("_sunday")
