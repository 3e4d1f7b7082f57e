"""Calendar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three renderings of a date.
DATE_STYLES = {"iso": "yyyy-MM-dd", "long": "d MMMM yyyy", "us": "MM/dd/yyyy"}


def iso_monday(year: Column, week: Column) -> Column:
    """The Monday of an ISO week: weeks start on Monday, and week 1 holds 4 January."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week - 1) * 7).cast("int"))


def period_end(start: Column, days: Column, inclusive: Column) -> Column:
    """The last day of a period; ``inclusive``: its start is day 1, else the day after is."""
    return F.date_add(start, (days - F.when(inclusive, 1).otherwise(0)).cast("int"))


def coverage_end(start: Column, months: Column, more_days: Column) -> Column:
    """Months later, on the month's last day where the day does not exist, and then some days."""
    return F.date_add(F.add_months(start, months), more_days.cast("int"))


def business_day_after(start: Column, n: Column, holidays: list[date], count_start: Column | bool = False) -> Column:
    """The day on which ``n`` working days are reached, not counting Saturdays, Sundays and holidays.

    ``count_start``: a start that is a working day is the first. ``n`` of none left gives the start.
    """
    free = F.array(*map(F.lit, holidays)) if holidays else F.array().cast("array<date>")
    works = lambda d: (F.weekday(d) < 5) & ~F.array_contains(free, d)
    first = F.lit(count_start) if isinstance(count_start, bool) else count_start
    left = n - F.when(first & works(start), 1).otherwise(0)
    # n working days and all holidays fit in this many days
    days = F.sequence(F.date_add(start, 1), F.date_add(start, (F.greatest(left, F.lit(0)) * 7 / 5).cast("int") + 2 * len(holidays) + 9))
    return F.when(left <= 0, start).otherwise(F.get(F.filter(days, works), (left - 1).cast("int")))


def render_date(d: Column, style: Column) -> Column:
    """A date as text: iso, long (9 March 2026) or us (03/09/2026); null for another style."""
    return F.coalesce(*(F.when(style == name, F.date_format(d, pattern)) for name, pattern in DATE_STYLES.items()))
