"""The daily situation report as one-row plans.

The case table is read three times, whatever the number of values: for the latest day, for totals
per day, state and month, and for the stays of the last month. Totals come together in one row of
arrays, which are as long as the calendar and the list of states; all values are expressions
over that row. Nothing passes through the driver.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from casewatch.contracts import BEDS, CASES, BedSchema, CaseSchema
from casewatch.functions import dates as D, rates as R
from casewatch.operators import counts as N, filters as P, stays as S


def known_by(cases: DataFrame, as_of: date, s: CaseSchema = CASES) -> DataFrame:
    """Cases not notified after a day; a case without a date stays."""
    for column in filter(None, (s.notified_on, s.month)):
        day = F.col(column)
        cases = cases.filter(day.isNull() | (day <= D.as_date(as_of)))
    return cases


def one_row(session) -> DataFrame:
    return session.range(0, 1, 1, 1)


def totals(cases: DataFrame, s: CaseSchema = CASES) -> DataFrame:
    """Totals of cases in one row: `days` and `states` with their cases, and `months`, per state,
    with those of known key and the vaccinated ones. Each is an array in order, nulls left out.
    """
    sums = ("n", "keyed", "covid", "flu")
    pairs = cases.groupBy(F.col(s.notified_on).alias("day"), F.col(s.state).alias("state")).agg(
        F.count("*").alias("n"),
        F.count(s.key).alias("keyed"),
        F.sum(s.vaccinated_covid).alias("covid"),
        F.sum(s.vaccinated_flu).alias("flu"),
    )
    sets = (
        pairs.withColumn("month", D.month_start(F.col("day")))
        .groupingSets([["day"], ["state"], ["month", "state"]], "day", "month", "state")
        .agg(F.grouping_id().alias("_set"), *[F.sum(c).alias(c) for c in sums])
    )

    def listed(of_set: int, known: str, *columns: str):
        fit = (F.col("_set") == of_set) & F.col(known).isNotNull()
        return F.array_sort(F.collect_list(F.when(fit, F.struct(*columns))))

    # the bits of a set tell which of day, month and state it adds up over
    return sets.agg(
        listed(0b011, "day", "day", "n").alias("days"),
        listed(0b110, "state", "state", "n").alias("states"),
        listed(0b100, "month", "month", "state", *sums).alias("months"),
    )


def stays_and_beds(cases: DataFrame, beds: DataFrame, s: CaseSchema, b: BedSchema) -> DataFrame:
    """In one row the stays that touch the last month, `admitted`, and the occupancy per state."""
    last = P.latest_notified(cases, s)
    stays = S.stays_of_last_month(cases, last, s)
    by_month = beds.filter(F.col(b.month) <= last).groupBy(b.month).agg(F.collect_list(F.struct(*beds.columns)).alias("rows"))
    newest = by_month.agg(F.max_by("rows", b.month).alias("rows")).select(F.inline("rows"))
    sides = stays.join(S.beds_by_class(newest, b).withColumn("_beds", F.lit(True)), "state", "left")
    record = F.struct("state", *S.occupancy_rates(s))
    fit = (F.col("patients") > 0) & F.col("_beds")
    return sides.agg(
        F.coalesce(F.sum("admitted"), F.lit(0).cast("bigint")).alias("admitted"),
        F.array_sort(F.collect_list(F.when(fit, record))).alias("occupancy"),
    )


class Values:
    """Report values as expressions over a row of `totals`."""

    def __init__(self, as_of: date):
        self.as_of = as_of
        self.latest, self.recent, self.of_year = F.col("latest"), F.col("recent"), F.col("of_year")

    def named(self, row: DataFrame) -> DataFrame:
        """The row with what several values start from: the latest day and the days of two periods."""
        row = row.withColumn("latest", F.try_element_at("days", F.lit(-1))["day"])  # null without cases; days are in order
        recent = F.filter("days", lambda d: d["day"] >= D.days_before(self.latest, 30))
        return row.withColumns({"recent": recent, "of_year": self._between(D.months_before(self.as_of, 12), self.as_of)})

    def _between(self, start, end) -> Column:
        return F.filter("days", lambda d: d["day"].between(D.as_date(start), D.as_date(end)))

    @staticmethod
    def cases(days: Column) -> Column:
        return F.aggregate(days, F.lit(0).cast("bigint"), lambda total, d: total + d["n"])

    def last_seven_days(self) -> Column:
        return F.when(F.size(self.recent) > 0, self.cases(F.slice(F.reverse(self.recent), 1, 7)))

    def last_month(self) -> Column:
        """Cases of the newest month with any in the year up to the report."""
        last = D.month_start(F.try_element_at(self.of_year, F.lit(-1))["day"])
        return F.when(F.size(self.of_year) > 0, self.cases(F.filter(self.of_year, lambda d: D.month_start(d["day"]) == last)))

    def per_month(self) -> Column:
        months = F.array_distinct(F.transform(self.of_year, lambda d: D.month_start(d["day"])))
        in_month = lambda m: F.filter(self.of_year, lambda d: D.month_start(d["day"]) == m)
        return F.transform(months, lambda m: F.struct(m.alias("month"), self.cases(in_month(m)).alias("n")))

    def per_day(self) -> Column:
        """Every day of the 30 after the first of the recent ones, 0 where there are no cases."""
        first = F.get(self.recent, F.lit(0))["day"]
        days = F.when(first.isNotNull(), F.sequence(first, F.date_add(first, 30)))
        found = lambda day: self.cases(F.filter(self.recent, lambda d: d["day"] == day))
        rows = F.transform(days, lambda day: F.struct(day.alias("day"), found(day).alias("n")))
        return F.coalesce(rows, F.array().cast("array<struct<day:date,n:bigint>>"))

    def per_state(self) -> Column:
        ordered = F.array_sort(F.transform("states", lambda r: F.struct((-r["n"]).alias("fall"), r["state"].alias("state"))))
        return F.transform(ordered, lambda r: F.struct(F.upper(r["state"]).alias("state"), (-r["fall"]).alias("n")))

    def variation(self) -> Column:
        return N.variation(*[self.cases(self._between(*month)) for month in N.compared_months(self.as_of)])

    def of_latest_month(self) -> Column:
        return self.cases(F.filter("days", lambda d: d["day"] >= D.month_start(self.latest)))

    def _of_latest(self) -> Column:
        """Totals per state of the month of the latest day."""
        return F.filter("months", lambda m: m["month"] == D.month_start(self.latest))

    @staticmethod
    def _vaccinated(state, total: Column, covid: Column, flu: Column) -> Column:
        return F.struct(
            *state,
            total.alias("total_notifications"),
            covid.alias("vaccinated_covid"),
            flu.alias("vaccinated_flu"),
            R.percent_half_up(covid, total).alias("rate_vaccinated_covid"),
            R.percent_half_up(flu, total).alias("rate_vaccinated_flu"),
        )

    def vaccination(self) -> Column:
        """One record of the latest month; none without cases."""
        rows = self._of_latest()

        def added(c: str) -> Column:  # null where none of the rows has a value, as a sum
            known = F.array_compact(F.transform(rows, lambda r: r[c]))
            return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, n: a + n))

        record = self._vaccinated([D.year_month(self.latest).alias("year_month")], *map(added, ("keyed", "covid", "flu")))
        return F.array_compact(F.array(F.when(self.latest.isNotNull(), record)))

    def vaccination_per_state(self) -> Column:
        """Records of the latest month, highest rate against COVID first."""
        month = D.year_month(self.latest).alias("year_month")
        records = F.transform(
            self._of_latest(),
            lambda r: self._vaccinated([month, r["state"].alias("state")], r["keyed"], r["covid"], r["flu"]),
        )
        rate = lambda r: -r["rate_vaccinated_covid"]
        keyed = F.transform(
            records,
            lambda r: F.struct(rate(r).isNull().alias("a"), rate(r).alias("b"), r["state"].isNull().alias("c"), r["state"].alias("d"), r.alias("r")),
        )
        return F.transform(F.array_sort(keyed), lambda k: k["r"])


def _metrics(v: Values) -> list[Column]:
    admitted = F.when(v.latest.isNotNull(), F.col("stays.admitted"))
    month = D.month_label(D.month_start(v.latest)).alias("month")
    occupancy = F.transform("stays.occupancy", lambda r: F.struct(month, *[r[c].alias(c) for c in OCCUPANCY]))
    return [
        D.day_label(v.latest).alias("last_notification"),
        F.lit(v.as_of).alias("report_date"),
        v.last_seven_days().alias("cases_last_seven_days"),
        v.last_month().alias("total_cases_month"),
        occupancy.alias("icu_occupancy"),
        v.variation().alias("variation_rate"),
        D.year_month(v.latest).alias("last_month"),
        admitted.alias("icu_admission_count"),
        R.percent_half_even(admitted, v.of_latest_month()).alias("icu_admission_rate"),
        v.vaccination().alias("vaccination"),
    ]


def _series(v: Values) -> list[Column]:
    return [
        v.per_month().alias("cases_per_month"),
        v.per_day().alias("cases_per_day"),
        v.per_state().alias("cases_per_state"),
        v.vaccination_per_state().alias("vaccination_per_state"),
    ]


OCCUPANCY = ("state", "adult_rate", "pediatric_rate", "neonatal_rate", "total_rate")


def _values(cases, beds, as_of: date, s: CaseSchema, b: BedSchema, *kinds) -> DataFrame:
    """One row of the values of some kinds; the pass over stays and beds is a scalar subquery."""
    cases = known_by(cases, as_of, s)
    values = Values(as_of)
    row = values.named(totals(cases, s))
    if beds is not None:
        stays = stays_and_beds(cases, beds, s, b)
        row = row.withColumn("stays", stays.select(F.struct("*")).scalar())
    return row.select(*[column for kind in kinds for column in kind(values)])


def report_metrics(
    cases: DataFrame, beds: DataFrame, as_of: date, s: CaseSchema = CASES, b: BedSchema = BEDS
) -> DataFrame:
    """Ten named values of the report of a day, from cases notified up to it.

    `cases` has the case features, `beds` the beds, one row per state and month.
    """
    return _values(cases, beds, as_of, s, b, _metrics)


def report_series(cases: DataFrame, as_of: date, s: CaseSchema = CASES) -> DataFrame:
    """Data of the four charts of the report, each as an array of records."""
    return _values(cases, None, as_of, s, BEDS, _series)


def report(
    cases: DataFrame, beds: DataFrame, as_of: date, s: CaseSchema = CASES, b: BedSchema = BEDS
) -> DataFrame:
    """Metrics and series in one row, from the same passes."""
    return _values(cases, beds, as_of, s, b, _metrics, _series)


def report_context(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side; of two columns with a name the later wins."""
    wholes = [part.select(F.struct("*")).scalar().alias(f"_{i}") for i, part in enumerate(parts)]
    owner = {name: i for i, part in enumerate(parts) for name in part.columns}
    rows = one_row(parts[0].sparkSession).select(*wholes)
    return rows.select(*[F.col(f"_{i}.{name}") for name, i in owner.items()])
