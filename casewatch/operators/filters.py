"""Projections and filters that keep the raw column on the left of a
comparison, so bounds reach the file scan and prune partitions."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casewatch.contracts import CaseSchema
from casewatch.functions import dates as D


def sorted_columns(df: DataFrame) -> DataFrame:
    """Columns in alphabetical order."""
    return df.select(*sorted(df.columns))


def relabel(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Rename the columns that have a label; the others keep their name."""
    return df.withColumnsRenamed({c: labels[c] for c in df.columns if c in labels})


def filter_by(df: DataFrame, condition, **bounds) -> DataFrame:
    """Rows that meet a condition on bounds, passed to it as columns by name.

    A bound may be a scalar subquery. Named once, it is planned once however
    often the condition uses it; the optimizer puts it, or a literal, back into
    the comparisons, so they still reach the scan.
    """
    named = {f"_{name}": D.as_date(value) for name, value in bounds.items()}
    return df.withColumns(named).filter(condition(*[F.col(name) for name in named])).drop(*named)


def within(column: str, start, end) -> Column:
    return (F.col(column) >= D.as_date(start)) & (F.col(column) <= D.as_date(end))


def between_dates(df: DataFrame, column: str, start, end) -> DataFrame:
    """Both bounds included; rows without a date drop."""
    return filter_by(df, lambda a, b: within(column, a, b), start=start, end=end)


def latest(df: DataFrame, column: str) -> Column:
    """Largest value of a column as a scalar subquery.

    The value is computed inside the plan that uses it and then handed to that
    plan's scan as a literal: no job on the driver and no join.
    """
    return df.agg(F.max(column)).scalar()


def notified_between(df: DataFrame, s: CaseSchema, start, end) -> DataFrame:
    """Cases notified in a period; reads only its months of a partitioned table."""
    rows = between_dates(df, s.notified_on, start, end)
    if s.month is None:
        return rows
    return filter_by(rows, lambda a, b: within(s.month, F.trunc(a, "MM"), b), start=start, end=end)


def notified_in(s: CaseSchema, start, end) -> Column:
    """The same as a condition."""
    inside = within(s.notified_on, start, end)
    return inside if s.month is None else inside & within(s.month, D.month_start(start), end)


def notified_in_month(df: DataFrame, s: CaseSchema, year_month: str | None = None) -> DataFrame:
    """Cases of one 'yyyy-MM' month, by default that of the latest notification."""
    if year_month is None:
        start = D.month_start(latest_notified(df, s))
    else:
        start = D.as_date(year_month + "-01")
    return notified_between(df, s, start, F.last_day(start))


def latest_notified(df: DataFrame, s: CaseSchema) -> Column:
    """Latest notification date; of a partitioned table the last month tells it."""
    if s.month is not None:
        df = df.filter(F.col(s.month) == latest(df, s.month))
    return latest(df, s.notified_on)


def in_month(df: DataFrame, column: str, year_month: str | None = None) -> DataFrame:
    """Rows of one 'yyyy-MM' month, by default the month of the latest date."""
    anchor = latest(df, column) if year_month is None else date.fromisoformat(year_month + "-01")
    value = F.col(column)
    return filter_by(
        df, lambda a: (value >= a) & (value < F.add_months(a, 1)), start=D.month_start(anchor)
    )


def in_year(df: DataFrame, columns, anchor) -> DataFrame:
    """Rows with any of the dates in the calendar year of `anchor`."""

    def inside(start):
        end = F.add_months(start, 12)
        return reduce(lambda a, b: a | b, [(F.col(c) >= start) & (F.col(c) < end) for c in columns])

    return filter_by(df, inside, start=D.year_start(anchor))


def stays_overlapping(entry: str, exit: str, start, end) -> Column:
    """Stay enters in the period, leaves in it, or spans it.

    A stay without an exit is therefore counted in its entry period only.
    """
    start, end = D.as_date(start), D.as_date(end)
    spans = (F.col(entry) <= start) & (F.col(exit) >= end)
    return within(entry, start, end) | within(exit, start, end) | spans


def with_codes(df: DataFrame, column: str, codes) -> DataFrame:
    """Rows whose code is in a list, or in a one-column DataFrame of codes."""
    if isinstance(codes, DataFrame):
        return df.join(codes.toDF("_code"), F.col(column) == F.col("_code"), "left_semi")
    return df.filter(F.col(column).isin(list(codes)))


def fill_numbers(df: DataFrame, value: int = 0) -> DataFrame:
    """Null numbers become `value`; text and dates are left alone."""
    numeric = [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    return df.fillna(value, subset=numeric) if numeric else df


NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
