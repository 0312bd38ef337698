"""Calendar arithmetic as column expressions.

Every bound may be a `date`, an ISO text or a `Column` (for instance a scalar
subquery), so a plan never has to be run just to learn a date.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F


def as_date(value) -> Column:
    """`date`, 'yyyy-MM-dd' text or Column as a DATE column; of a point in time its day."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, datetime):
        value = value.date()
    return F.lit(value if isinstance(value, date) else date.fromisoformat(value))


def month_start(value) -> Column:
    return F.trunc(as_date(value), "MM")


def month_end(value) -> Column:
    return F.last_day(as_date(value))


def months_before(value, months: int) -> Column:
    return F.add_months(as_date(value), -months)


def days_before(value, days: int) -> Column:
    return F.date_sub(as_date(value), days)


def month_ceil(value) -> Column:
    """First month start on or after the date."""
    return F.trunc(F.add_months(F.date_sub(as_date(value), 1), 1), "MM")


def year_start(value) -> Column:
    return F.trunc(as_date(value), "YEAR")


def year_month(column) -> Column:
    """'yyyy-MM' text of a date."""
    return F.date_format(column, "yyyy-MM")


def month_of_year_month(text) -> Column:
    """First day of a 'yyyy-MM' text; null where it is not one."""
    return F.try_to_date(text if isinstance(text, Column) else F.lit(text), "yyyy-MM")


def month_of_comp(column) -> Column:
    """First day of a yyyyMM number; null where it is not one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.try_to_date(column.cast("string"), "yyyyMM")


def text_to_date(column, fmt: str = "yyyy-MM-dd") -> Column:
    """Dirty text to DATE; null where it does not parse."""
    return F.try_to_date(column, fmt)


def day_label(column) -> Column:
    return F.date_format(column, "dd-MM-yyyy")


def month_label(column) -> Column:
    return F.date_format(column, "MM/yyyy")
