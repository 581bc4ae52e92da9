"""Issue calendar and clock times (P10 to P13). Issues run from Saturday to Friday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of the day before which a start belongs to the night of the printed day before.
NIGHT_ENDS = 360
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
FRENCH_DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def valid_date(text: Column) -> Column:
    """A ``YYYY-MM-DD`` text as a date; null if it doesn't come back as written."""
    d = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.date_format(d, "yyyy-MM-dd") == text, d)


def minutes(clock: Column) -> Column:
    """P10: ``HH:MM`` as minutes; null for any other text."""
    ok = clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.substring(clock, 1, 2).try_cast("int") * 60 + F.substring(clock, 4, 2).try_cast("int"))


def duration_label(m: Column) -> Column:
    """P10: minutes as ``h h mm``."""
    return F.format_string("%d h %02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def is_night(start_min: Column) -> Column:
    """Before six in the morning."""
    return start_min < NIGHT_ENDS


def civil_date(grid_date: Column, start_min: Column) -> Column:
    """The civil date of a start printed under ``grid_date``."""
    return F.date_add(grid_date, F.when(is_night(start_min), 1).otherwise(0))


def grid_date(civil: Column, start_min: Column) -> Column:
    """The printed day of a civil start."""
    return F.date_sub(civil, F.when(is_night(start_min), 1).otherwise(0))


def issue_from(day: Column) -> Column:
    """The Saturday that begins the issue of a day."""
    return F.date_sub(F.next_day(day, "SAT"), 7)


def week_of_saturday(saturday: Column) -> Column:
    """The id of an issue: ISO week of the Monday in it."""
    monday = F.date_add(saturday, 2)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), monday).cast("string"), F.lit("-S"), F.lpad(F.weekofyear(monday).cast("string"), 2, "0"))


def saturday_of_week(week: Column) -> Column:
    """The Saturday that begins the issue of a week id."""
    year, number = F.substring(week, 1, 4).try_cast("int"), F.substring(week, 7, 2).try_cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in ISO week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    return F.date_add(monday, (number - 1) * 7 - 2)


def target_saturday(day: Column) -> Column:
    """The day itself if it is a Saturday, else the next one."""
    return F.next_day(F.date_sub(day, 1), "SAT")


def week_dates(saturday: Column) -> Column:
    """The seven dates of an issue."""
    return F.sequence(saturday, F.date_add(saturday, 6))


def weekday_name(day: Column) -> Column:
    """The French name of a day."""
    return F.element_at(F.array(*map(F.lit, FRENCH_DAYS)), F.weekday(day) + 1)


def range_label(saturday: Column) -> Column:
    """``du 3 au 9 février 2024``; month and year are repeated where they differ."""
    friday = F.date_add(saturday, 6)
    month = lambda d: F.element_at(F.array(*map(F.lit, FRENCH_MONTHS)), F.month(d))
    day = lambda d: F.day(d).cast("string")
    same_year = F.year(saturday) == F.year(friday)
    first = F.when(same_year & (F.month(saturday) == F.month(friday)), day(saturday)).when(same_year, F.concat_ws(" ", day(saturday), month(saturday))).otherwise(
        F.concat_ws(" ", day(saturday), month(saturday), F.year(saturday).cast("string"))
    )
    return F.concat_ws(" ", F.lit("du"), first, F.lit("au"), day(friday), month(friday), F.year(friday).cast("string"))


def paris(instant: Column) -> tuple[Column, Column]:
    """Paris date and minute of an instant (the session runs in UTC)."""
    local = F.from_utc_timestamp(instant, "Europe/Paris")
    return local.cast("date"), F.hour(local) * 60 + F.minute(local)
