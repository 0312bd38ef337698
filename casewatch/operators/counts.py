"""Case counts per period and place, and series helpers.

A series is a DataFrame of (`month` or `day` DATE, `n` BIGINT), one row per
period that has cases: calendar-sized, whatever the size of the case table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from casewatch.contracts import CASES, CaseSchema
from casewatch.functions import dates as D, rates as R
from casewatch.operators import filters as P


def cases_per_month(
    df: DataFrame, as_of, start=None, end=None, s: CaseSchema = CASES
) -> DataFrame:
    """Cases per month in [start, end], by default the 12 months up to `as_of`.

    Both ends count, so the default window can touch 13 months.
    """
    end = D.as_date(as_of if end is None else end)
    start = D.months_before(end, 12) if start is None else start
    return (
        P.notified_between(df, s, start, end)
        .groupBy(D.month_start(F.col(s.notified_on)).alias("month"))
        .agg(F.count("*").alias("n"))
        .orderBy("month")
    )


def cases_per_day(df: DataFrame, start=None, end=None, s: CaseSchema = CASES) -> DataFrame:
    """Cases per day in [start, end], by default the 30 days up to the latest."""
    end = P.latest_notified(df, s) if end is None else D.as_date(end)
    start = D.days_before(end, 30) if start is None else start
    return (
        P.notified_between(df, s, start, end)
        .groupBy(F.col(s.notified_on).alias("day"))
        .agg(F.count("*").alias("n"))
        .orderBy("day")
    )


def cases_per_state(df: DataFrame, start=None, end=None, population=None, s: CaseSchema = CASES):
    """Cases per known state, most first; all time unless a period is given.

    `population` (state, population) adds cases per 100,000 inhabitants.
    """
    for column in filter(None, (s.notified_on, s.month)):
        if start is not None:
            first = D.as_date(start) if column == s.notified_on else D.month_start(start)
            df = df.filter(F.col(column) >= first)
        if end is not None:
            df = df.filter(F.col(column) <= D.as_date(end))
    counts = (
        df.dropna(subset=[s.state])
        .groupBy(F.col(s.state).alias("state"))
        .agg(F.count("*").alias("n"))
    )
    if population is not None:
        per_100k = R.percent_half_even(F.col("n") * 1000, F.col("population"))
        counts = counts.join(population, "state", "left").withColumn("per_100k", per_100k)
    return counts.orderBy(F.desc("n"), "state")


def variation_rate(df: DataFrame, as_of: date, s: CaseSchema = CASES) -> DataFrame:
    """Change of the last full month against the same month a year earlier.

    The ratio is rounded before it becomes a percentage, so the result is in
    whole percents. One pass counts both months; no comparison cases gives null.
    """
    current, earlier = compared_months(as_of)
    in_current, in_earlier = P.notified_in(s, *current), P.notified_in(s, *earlier)
    counts = df.filter(in_current | in_earlier).agg(
        F.count_if(in_current).alias("cases_current"),
        F.count_if(in_earlier).alias("cases_comparison"),
    )
    return counts.withColumn("variation_rate", variation(F.col("cases_current"), F.col("cases_comparison")))


def compared_months(as_of: date):
    """First and last day of the last full month, and of the same month a year earlier."""
    month = as_of.replace(day=1)
    firsts = (D.months_before(month, 1), D.months_before(month, 13))
    return [(first, F.last_day(first)) for first in firsts]


def variation(current, comparison):
    """Change in percent of two counts, rounded to whole percents."""
    change = R.round_half_even(R.ratio(current - comparison, comparison))
    return F.round(change * 100, 2)


def tail_sum(series: DataFrame, n: int = 7, period: str = "day", unit: str = "rows") -> DataFrame:
    """Sum of the last `n` rows of a series, or of its last `n` calendar days."""
    if unit == "days":
        first = F.date_sub(P.latest(series, period), n - 1)
        tail = series.filter(F.col(period) >= first)
    else:
        tail = series.orderBy(F.desc(period)).limit(n)
    return tail.agg(F.sum("n").alias("n"))


def last_value(series: DataFrame, period: str = "month") -> DataFrame:
    """Newest period of a series and its count."""
    return series.agg(F.max(period).alias(period), F.max_by("n", period).alias("n"))


def series_bounds(series: DataFrame, days: int = 30, period: str = "day") -> DataFrame:
    """First and last date, peak, and whether the series stops short of `days`."""
    return series.agg(
        F.min(period).alias("first"), F.max(period).alias("last"), F.max("n").alias("peak")
    ).withColumn("stops_short", F.col("last") < F.date_add("first", days))


def fill_daily_gaps(series: DataFrame, days: int = 30) -> DataFrame:
    """Every day from the first to the first + `days`, 0 where there is no row.

    Days past that range are cut. An empty series stays empty.
    """
    calendar = series.agg(F.min("day").alias("first")).select(
        F.explode(F.sequence("first", F.date_add("first", days))).alias("day")
    )
    return (
        calendar.join(series, "day", "left")
        .select("day", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        .orderBy("day")
    )
