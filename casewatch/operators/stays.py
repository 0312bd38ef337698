"""Interval overlap of ICU stays with months, and the indicators built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewatch.contracts import BEDS, CASES, BedSchema, CaseSchema
from casewatch.functions import dates as D, rates as R
from casewatch.operators import filters as P

ONE_MONTH = "interval 1 month"


def month_calendar(df: DataFrame, start, end) -> DataFrame:
    """Month starts in [start, end]; a month `start` falls inside of is left out.

    `df` only lends its session, so bounds may be scalar subqueries.
    """
    bounds = df.sparkSession.range(1).select(
        D.month_ceil(start).alias("first"), D.month_start(end).alias("last")
    )
    months = F.sequence("first", F.greatest("first", "last"), F.expr(ONE_MONTH))
    return bounds.select("last", F.explode(months).alias("month")).filter("month <= last").select("month")


def overlap_count(df: DataFrame, start, end, s: CaseSchema = CASES) -> DataFrame:
    """Stays per month that enter in it, leave in it or span it.

    Each stay is expanded to its own months and counted by key, which equals
    testing every stay against every month but needs no range join. Both ends
    are clamped to the asked period, so a mistyped exit year adds no rows.
    """
    stays = df.select(
        F.col(s.icu_in).alias("entry"),
        F.col(s.icu_out).alias("exit"),
        D.month_ceil(start).alias("first"),
        D.month_start(end).alias("last"),
    )
    ends = [D.month_start(F.col("entry")), D.month_start(F.col("exit"))]
    asked = [F.when(m.between(F.col("first"), F.col("last")), m) for m in ends]
    own = F.array_distinct(F.array_compact(F.array(*asked)))
    lo, hi = F.greatest(ends[0], "first"), F.least(ends[1], "last")
    spanned = F.when(lo <= hi, F.sequence(lo, hi, F.expr(ONE_MONTH)))
    counts = (
        stays.filter(P.stays_overlapping("entry", "exit", F.col("first"), F.last_day("last")))
        .select(F.explode(F.when(F.col("exit") >= F.col("entry"), spanned).otherwise(own)).alias("month"))
        .groupBy("month")
        .agg(F.count("*").alias("n"))
    )
    return month_calendar(df, start, end).join(counts, "month", "left").select(
        "month", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def stays_in_period(df: DataFrame, start, end, s: CaseSchema = CASES) -> DataFrame:
    """Cases with a stay overlapping one period."""
    touching = lambda a, b: P.stays_overlapping(s.icu_in, s.icu_out, a, b)
    return P.filter_by(df, touching, start=start, end=end)


def icu_admission_rate(df: DataFrame, start=None, end=None, s: CaseSchema = CASES) -> DataFrame:
    """ICU stays per 100 notified cases, per month of [start, end].

    Stays are counted over whole months and all cases, not only those notified
    in the period, so the rate may exceed 100. Without a period it covers the
    month of the latest notification. A month without cases has no rate.
    """
    end = P.latest_notified(df, s) if end is None else D.as_date(end)
    start = D.month_start(end) if start is None else D.as_date(start)
    cases = (
        P.notified_between(df, s, start, end)
        .groupBy(D.month_start(F.col(s.notified_on)).alias("month"))
        .agg(F.count("*").alias("cases"))
    )
    admitted = overlap_count(df, start, end, s).withColumnRenamed("n", "admitted_icu")
    rate = R.percent_half_even(F.col("admitted_icu"), F.col("cases"))
    return (
        P.fill_numbers(cases.join(admitted, "month", "full"))
        .select(
            D.year_month("month").alias("year_month"),
            "cases",
            "admitted_icu",
            rate.alias("icu_admission_rate"),
        )
        .orderBy("year_month")
    )


def pivot_bed_class(df: DataFrame, s: CaseSchema = CASES) -> DataFrame:
    """Cases per state with one column per bed class, 0 where there are none.

    The classes are known, so conditional counts do the pivot in one shuffle and
    every column exists whatever the data holds.
    """
    counts = [F.count_if(F.col(s.bed_class) == c).alias(c) for c in s.bed_classes]
    return df.groupBy(F.col(s.state).alias("state")).agg(*counts)


def icu_occupancy_by_state(
    cases: DataFrame, beds: DataFrame, as_of=None, s: CaseSchema = CASES, b: BedSchema = BEDS
) -> DataFrame:
    """ICU patients of the month to date per 100 beds, per state and bed class.

    `cases` has the case features, `beds` the beds per state and month, of which
    the newest month up to `as_of`, or the latest notification, counts. Rates stop at 100; a state without either side drops.
    """
    last = P.latest_notified(cases, s) if as_of is None else D.as_date(as_of)
    stays = P.in_year(cases, [s.icu_in, s.icu_out], last)
    patients = pivot_bed_class(stays_in_period(stays, D.month_start(last), last, s), s)
    known = beds.filter(F.col(b.month) <= last)  # an inventory of a later month was not known then
    newest = known.filter(F.col(b.month) == P.latest(known, b.month))
    rows = patients.join(beds_by_class(newest, b), "state")
    return rows.select(D.month_label(D.month_start(last)).alias("month"), "state", *occupancy_rates(s)).orderBy("state")


CLASSES = ("adult", "pediatric", "neonatal")


def beds_by_class(beds: DataFrame, b: BedSchema = BEDS) -> DataFrame:
    """State and beds of each class, under the names that `occupancy_rates` reads."""
    sums = zip((b.sum_adult, b.sum_pediatric, b.sum_neonatal), CLASSES)
    return beds.select(F.col(b.state).alias("state"), *[F.col(c).alias(f"{name}_beds") for c, name in sums])


def occupancy_rates(s: CaseSchema = CASES) -> list[Column]:
    """Patients per 100 beds of each class and of all, from one row per state with both."""
    patients = {name: F.col(c) for c, name in zip((s.adult, s.pediatric, s.neonatal), CLASSES)}
    beds = {name: F.col(f"{name}_beds") for name in CLASSES}
    rates = [R.capped_percent(patients[c], beds[c]).alias(f"{c}_rate") for c in CLASSES]
    return [*rates, R.capped_percent(sum(patients.values()), sum(beds.values())).alias("total_rate")]


def stays_of_last_month(cases: DataFrame, last: Column, s: CaseSchema = CASES) -> DataFrame:
    """Stays of the month of `last` per state, in one pass.

    `admitted` counts those that touch the month; `patients` and the bed classes those that touch
    its days up to `last` and begin or end in its year, as `icu_occupancy_by_state` wants.
    """
    touching = lambda a, b: P.stays_overlapping(s.icu_in, s.icu_out, a, b)
    last_day, first = F.col("_last"), D.month_start(F.col("_last"))
    known = cases.withColumn("_last", D.as_date(last)).filter(touching(first, F.last_day(last_day)))
    year = D.year_start(last_day)
    of_year = [(F.col(c) >= year) & (F.col(c) < F.add_months(year, 12)) for c in (s.icu_in, s.icu_out)]
    to_date = F.coalesce(touching(first, last_day) & (of_year[0] | of_year[1]), F.lit(False))
    known = known.select(F.col(s.state).alias("state"), F.col(s.bed_class).alias("_class"), to_date.alias("_to_date"))
    return known.groupBy("state").agg(
        F.count("*").alias("admitted"),
        F.count_if("_to_date").alias("patients"),
        *[F.count_if(F.col("_to_date") & (F.col("_class") == c)).alias(c) for c in s.bed_classes],
    )
