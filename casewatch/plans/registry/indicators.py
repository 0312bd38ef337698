"""Counts, rates and report values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casewatch.operators import counts as N, filters as P, stays as S, vaccination as V
from casewatch.operators.features import beds_per_state_month, with_case_features
from casewatch.plans import report as Rep
from casewatch.plans.fixtures import (
    AS_OF, BED_FEATURES_SQL, BEDS_SQL, CASES_SQL, FEATURES_SQL, STATE_CASES_SQL,
    load, load_beds, load_cases, text_dates,
)
from casewatch.plans.registry import query

MONTH_TEXT = "cast(cast(date_trunc('month', notified_on) as date) as varchar)"
STAY_IN = """((icu_in >= {a} and icu_in <= {b}) or (icu_out >= {a} and icu_out <= {b})
   or (icu_in <= {a} and icu_out >= {b}))"""
DAILY_SQL = """daily as (select notified_on as day, count(*) as n from cases
  where notified_on >= (select max(notified_on) from cases) - 30 group by 1)"""


def feature_cases(spark, sf_dir, state=False):
    return with_case_features(load_cases(spark, sf_dir, state))


def bed_features(spark, sf_dir):
    return beds_per_state_month(load_beds(spark, sf_dir), AS_OF.year * 100)


@query(f"""with {CASES_SQL} select {MONTH_TEXT} as month, count(*) as n from cases
where notified_on between date '2000-07-31' and date '2001-07-31' group by 1""")
def cases_per_month(spark, sf_dir):
    """Monthly counts of the twelve months up to the day."""
    return text_dates(N.cases_per_month(load_cases(spark, sf_dir), AS_OF))


@query(f"""with {CASES_SQL}, {DAILY_SQL} select cast(day as varchar) as day, n from daily""")
def cases_per_day(spark, sf_dir):
    """Daily counts of the thirty days up to the latest notification."""
    return text_dates(N.cases_per_day(load_cases(spark, sf_dir)))


@query(f"""with {STATE_CASES_SQL} select state, count(*) as n from cases
where state is not null group by 1""")
def cases_per_state(spark, sf_dir):
    """All cases per known state."""
    return N.cases_per_state(load_cases(spark, sf_dir, state=True))


@query(f"""with {STATE_CASES_SQL}, pop as (select n_name as state, count(*) as population
  from customer join nation on c_nationkey = n_nationkey group by 1)
select state, n, population, round_even(n * 1000 / (population * 1e0) * 100, 2) as per_100k
from (select state, count(*) as n from cases where state is not null
  and notified_on between date '2001-07-01' and date '2001-07-31' group by 1) left join pop using (state)""")
def cases_per_state_and_population(spark, sf_dir):
    """Cases of the month per 100,000 inhabitants; customers stand for people."""
    cases = load_cases(spark, sf_dir, state=True)
    customer = load(spark, sf_dir, "customer").select("c_nationkey")
    nation = load(spark, sf_dir, "nation")
    per_key = customer.groupBy("c_nationkey").agg(F.count("*").alias("population"))
    population = per_key.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("state"), "population"
    )
    return N.cases_per_state(cases, AS_OF.replace(day=1), AS_OF, population)


@query(f"""with {CASES_SQL}, ab as (select
  count(*) filter (notified_on between date '2001-06-01' and date '2001-06-30') as a,
  count(*) filter (notified_on between date '2000-06-01' and date '2000-06-30') as b from cases)
select a as cases_current, b as cases_comparison,
  round(round_even((a - b) * 1e0 / nullif(b, 0), 2) * 100, 2) as variation_rate from ab""")
def variation_rate(spark, sf_dir):
    """Last full month against the same month a year earlier."""
    return N.variation_rate(load_cases(spark, sf_dir), AS_OF)


@query(f"""with {CASES_SQL}, {DAILY_SQL} select cast(sum(n) as bigint) as n
from (select * from daily order by day desc limit 7)""")
def tail_sum(spark, sf_dir):
    """Cases of the last seven days that have any."""
    return N.tail_sum(N.cases_per_day(load_cases(spark, sf_dir)))


@query(f"""with {CASES_SQL}, {DAILY_SQL} select cast(sum(n) as bigint) as n
from daily where day > (select max(day) from daily) - 7""")
def tail_sum_days(spark, sf_dir):
    """Cases of the last seven calendar days."""
    return N.tail_sum(N.cases_per_day(load_cases(spark, sf_dir)), unit="days")


@query(f"""with {CASES_SQL}, m as (select date_trunc('month', notified_on) as month, count(*) as n
  from cases where notified_on between date '2000-07-31' and date '2001-07-31' group by 1)
select cast(cast(month as date) as varchar) as month, n from m order by month desc limit 1""")
def last_value(spark, sf_dir):
    """Newest month of the series and its count."""
    return text_dates(N.last_value(N.cases_per_month(load_cases(spark, sf_dir), AS_OF)))


@query(f"""with {CASES_SQL}, {DAILY_SQL} select cast(min(day) as varchar) as first,
  cast(max(day) as varchar) as last, max(n) as peak, max(day) < min(day) + 30 as stops_short from daily""")
def series_bounds(spark, sf_dir):
    """Span and peak of the daily series."""
    return text_dates(N.series_bounds(N.cases_per_day(load_cases(spark, sf_dir))))


@query(f"""with {CASES_SQL}, daily as (select notified_on as day, count(*) as n from cases
  where outcome = 2 and icu_in is not null and notified_on between date '2001-06-15' and date '2001-07-31' group by 1),
cal as (select unnest(generate_series((select min(day) from daily)::timestamp,
  (select min(day) + 30 from daily)::timestamp, interval 1 day))::date as day)
select cast(cal.day as varchar) as day, coalesce(n, 0) as n from cal left join daily using (day)""")
def fill_daily_gaps(spark, sf_dir):
    """Sparse daily series made dense over its first thirty days."""
    deaths = load_cases(spark, sf_dir).filter("outcome = 2 and icu_in is not null")
    series = N.cases_per_day(deaths, "2001-06-15", AS_OF)
    return text_dates(N.fill_daily_gaps(series))


@query(f"""with {CASES_SQL}, months as (select unnest(generate_series(timestamp '1995-01-01',
  timestamp '2001-07-01', interval 1 month))::date as m)
select cast(m as varchar) as month, count(case_id) as n from months left join cases
on {STAY_IN.format(a="m", b="last_day(m)")} group by 1""")
def overlap_count(spark, sf_dir):
    """ICU stays touching each month of the whole history."""
    return text_dates(S.overlap_count(load_cases(spark, sf_dir), "1995-01-01", AS_OF))


@query(f"""with {CASES_SQL} select case_id, cast(icu_in as varchar) as icu_in, cast(icu_out as varchar) as icu_out
from cases where {STAY_IN.format(a="date '2001-07-01'", b="date '2001-07-31'")}""")
def stays_in_period(spark, sf_dir):
    """Cases with an ICU stay in the month to date."""
    stays = S.stays_in_period(load_cases(spark, sf_dir), AS_OF.replace(day=1), AS_OF)
    return text_dates(stays.select("case_id", "icu_in", "icu_out"))


@query(f"""with {CASES_SQL}, months as (select unnest(generate_series(timestamp '1999-02-01',
  timestamp '2001-07-01', interval 1 month))::date as m),
adm as (select m, count(case_id) as admitted from months left join cases
  on {STAY_IN.format(a="m", b="last_day(m)")} group by 1),
c as (select cast(date_trunc('month', notified_on) as date) as m, count(*) as cases from cases
  where notified_on between date '1999-01-15' and date '2001-07-31' group by 1)
select strftime(m, '%Y-%m') as year_month, coalesce(cases, 0) as cases,
  coalesce(admitted, 0) as admitted_icu,
  round_even(coalesce(admitted, 0) / nullif(cases * 1e0, 0) * 100, 2) as icu_admission_rate
from c full join adm using (m)""")
def icu_admission_rate(spark, sf_dir):
    """ICU stays per 100 cases; the partial first month has no stays counted."""
    return S.icu_admission_rate(load_cases(spark, sf_dir), "1999-01-15", AS_OF)


@query(f"""with {CASES_SQL}, l as (select max(notified_on) as d from cases),
b as (select cast(date_trunc('month', d) as date) as m, d from l),
adm as (select m, count(case_id) as admitted from b left join cases
  on {STAY_IN.format(a="m", b="last_day(m)")} group by 1),
c as (select m, count(*) as cases from cases, b where notified_on between m and d group by 1)
select strftime(m, '%Y-%m') as year_month, coalesce(cases, 0) as cases,
  coalesce(admitted, 0) as admitted_icu,
  round_even(coalesce(admitted, 0) / nullif(cases * 1e0, 0) * 100, 2) as icu_admission_rate
from c full join adm using (m)""")
def icu_admission_rate_latest(spark, sf_dir):
    """The same for the month of the latest notification."""
    return S.icu_admission_rate(load_cases(spark, sf_dir))


@query("""select strftime(unnest(generate_series(timestamp '1995-02-01', timestamp '2001-08-01',
  interval 1 month)), '%Y-%m-%d') as month where (select min(o_orderdate) from orders) is not null""")
def month_calendar(spark, sf_dir):
    """Whole months between two dates, the second the latest of the table."""
    cases = load_cases(spark, sf_dir)
    return text_dates(S.month_calendar(cases, "1995-01-02", P.latest(cases, "notified_on")))


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL} select state,
  count(*) filter (bed_class = 'adult') as adult,
  count(*) filter (bed_class = 'pediatric') as pediatric,
  count(*) filter (bed_class = 'neonatal') as neonatal from feats group by 1""")
def pivot_bed_class(spark, sf_dir):
    """Cases per state, one column per bed class."""
    return S.pivot_bed_class(feature_cases(spark, sf_dir, state=True))


OCCUPANCY_RATE = """case when {b} = 0 and {p} > 0 then 100e0
  when round_even({p} / nullif({b} * 1e0, 0) * 100, 2) > 100 then 100e0
  else round_even({p} / nullif({b} * 1e0, 0) * 100, 2) end"""
OCCUPANCY_SQL = f"""patients as (select state,
    count(*) filter (bed_class = 'adult') as a, count(*) filter (bed_class = 'pediatric') as p,
    count(*) filter (bed_class = 'neonatal') as n
  from feats where (year(icu_in) = 2001 or year(icu_out) = 2001)
    and {STAY_IN.format(a="date '2001-07-01'", b="date '2001-07-31'")} group by 1),
occupancy as (select '07/2001' as month, state,
    {OCCUPANCY_RATE.format(p="a", b="adult")} as adult_rate,
    {OCCUPANCY_RATE.format(p="p", b="pediatric")} as pediatric_rate,
    {OCCUPANCY_RATE.format(p="n", b="neonatal")} as neonatal_rate,
    {OCCUPANCY_RATE.format(p="(a + p + n)", b="(adult + pediatric + neonatal)")} as total_rate
  from patients join bed_feats using (state)
  where beds_month = (select max(beds_month) from bed_feats))"""


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL}, {BEDS_SQL}, {BED_FEATURES_SQL},
{OCCUPANCY_SQL} select * from occupancy""")
def icu_occupancy_by_state(spark, sf_dir):
    """Bed occupancy of the month to date per state and bed class."""
    cases, beds = feature_cases(spark, sf_dir, state=True), bed_features(spark, sf_dir)
    return S.icu_occupancy_by_state(cases, beds, AS_OF)


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL}, {BEDS_SQL}, {BED_FEATURES_SQL},
{OCCUPANCY_SQL.replace("07/2001", "05/2001").replace("2001-07-", "2001-05-").replace(
    "from bed_feats)", "from bed_feats where beds_month <= date '2001-05-31')")} select * from occupancy""")
def icu_occupancy_of_a_past_day(spark, sf_dir):
    """Bed occupancy as of an earlier day, by the inventory known then."""
    cases, beds = feature_cases(spark, sf_dir, state=True), bed_features(spark, sf_dir)
    return S.icu_occupancy_by_state(cases, beds, date(2001, 5, 31))


VACCINATION_SQL = """select strftime(notified_on, '%Y-%m') as year_month {state},
  count(case_id) as total_notifications,
  cast(sum(vaccinated_covid) as bigint) as vaccinated_covid,
  cast(sum(vaccinated_flu) as bigint) as vaccinated_flu,
  round(sum(vaccinated_covid) * 1e0 / count(case_id) * 100, 2) as rate_vaccinated_covid,
  round(sum(vaccinated_flu) * 1e0 / count(case_id) * 100, 2) as rate_vaccinated_flu
from feats where notified_on >= {a} and notified_on < {b} group by all"""


@query(f"""with {CASES_SQL}, {FEATURES_SQL} {VACCINATION_SQL.format(
    state="", a="(select date_trunc('month', max(notified_on)) from feats)", b="date '2999-01-01'")}""")
def vaccination_rate(spark, sf_dir):
    """Vaccinated per 100 notifications of the latest month."""
    return V.vaccination_rate(feature_cases(spark, sf_dir))


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL} {VACCINATION_SQL.format(
    state=", state", a="date '2001-07-01'", b="date '2001-08-01'")}""")
def vaccination_by_state(spark, sf_dir):
    """The same per state for a given month, unknown state included."""
    return V.vaccination_rate(feature_cases(spark, sf_dir, state=True), "2001-07", by_state=True)


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL} {VACCINATION_SQL.format(
    state=", state", a="(select date_trunc('month', max(notified_on)) from feats)", b="date '2999-01-01'")}""")
def vaccination_by_state_ranked(spark, sf_dir):
    """States of the latest month, highest rate first."""
    return V.vaccination_by_state_ranked(feature_cases(spark, sf_dir, state=True))


@query(f"""with {CASES_SQL} select cast(min(notified_on) as varchar) as first,
cast(max(notified_on) as varchar) as last, count(*) as n from cases""")
def table_bounds(spark, sf_dir):
    """Global extremes and count of the case table."""
    return text_dates(
        load_cases(spark, sf_dir).agg(
            F.min("notified_on").alias("first"), F.max("notified_on").alias("last"), F.count("*").alias("n")
        )
    )


REPORT_SQL = f"""{STATE_CASES_SQL.replace("cases as (", "all_cases as (", 1)},
cases as (select * from all_cases where notified_on <= date '2001-07-31'), {FEATURES_SQL},
{BEDS_SQL}, {BED_FEATURES_SQL}, {OCCUPANCY_SQL}, {DAILY_SQL},
m as (select max(notified_on) as d, cast(date_trunc('month', max(notified_on)) as date) as m from cases),
icu as (select count(*) as n from cases, m where {STAY_IN.format(a="m", b="last_day(m)")}),
mon as (select count(*) as n from cases, m where notified_on >= m),
ab as (select count(*) filter (notified_on between date '2001-06-01' and date '2001-06-30') as a,
  count(*) filter (notified_on between date '2000-06-01' and date '2000-06-30') as b from cases)"""


@query(f"""with {REPORT_SQL} select strftime(m.d, '%d-%m-%Y') as last_notification,
  '2001-07-31' as report_date,
  (select cast(sum(n) as bigint) from (select n from daily order by day desc limit 7)) as cases_last_seven_days,
  mon.n as total_cases_month,
  (select count(*) from occupancy) as states_with_occupancy,
  (select round(sum(total_rate), 4) from occupancy) as sum_of_total_rates,
  round(round_even((a - b) * 1e0 / nullif(b, 0), 2) * 100, 2) as variation_rate,
  strftime(m.m, '%Y-%m') as last_month, icu.n as icu_admission_count,
  round_even(icu.n / (mon.n * 1e0) * 100, 2) as icu_admission_rate,
  (select count(*) from feats where notified_on >= (select m from m)) as vaccination_notifications
from m, icu, mon, ab""")
def report_metrics(spark, sf_dir):
    """The ten report values; the two tables are shown by their totals here."""
    metrics = Rep.report_metrics(feature_cases(spark, sf_dir, True), bed_features(spark, sf_dir), AS_OF)
    rates = F.transform("icu_occupancy", lambda r: r["total_rate"])
    total = F.aggregate(rates, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return text_dates(
        metrics.withColumns(
            {
                "states_with_occupancy": F.size("icu_occupancy").cast("bigint"),
                "sum_of_total_rates": F.round(total, 4),
                "vaccination_notifications": F.col("vaccination")[0]["total_notifications"],
            }
        ).drop("icu_occupancy", "vaccination")
    )


@query(f"""with {REPORT_SQL}, cal as (select unnest(generate_series((select min(day) from daily)::timestamp,
  (select min(day) + 30 from daily)::timestamp, interval 1 day))::date as day),
v as ({VACCINATION_SQL.format(state=", state", a="(select m from m)", b="date '2001-08-01'")})
select 'cases_per_month' as series, {MONTH_TEXT} as label, count(*) * 1e0 as value from cases
  where notified_on >= date '2000-07-31' group by 2
union all select 'cases_per_day', cast(cal.day as varchar), coalesce(n, 0) * 1e0 from cal left join daily using (day)
union all select 'cases_per_state', upper(state), count(*) * 1e0 from cases where state is not null group by 2
union all select 'vaccination_per_state', state, rate_vaccinated_covid from v""")
def report_series(spark, sf_dir):
    """The four chart series, one row per point."""
    series = Rep.report_series(feature_cases(spark, sf_dir, state=True), AS_OF)
    points = [
        ("cases_per_month", "month", "n"),
        ("cases_per_day", "day", "n"),
        ("cases_per_state", "state", "n"),
        ("vaccination_per_state", "state", "rate_vaccinated_covid"),
    ]

    def point(name, label, value):
        return F.transform(
            name,
            lambda r: F.struct(
                F.lit(name).alias("series"),
                r[label].cast("string").alias("label"),
                r[value].cast("double").alias("value"),
            ),
        )

    return series.select(F.inline(F.concat(*[point(*p) for p in points])))


@query(f"""with {REPORT_SQL} select mon.n as total_cases_month, strftime(m.d, '%d-%m-%Y') as last_notification,
  (select count(distinct upper(state)) from cases where state is not null) as n_states,
  'as told' as comment, mon.n > 0 as has_cases from m, mon""")
def report_context(spark, sf_dir):
    """Values, series and text of a report side by side."""
    cases = feature_cases(spark, sf_dir, state=True)
    metrics = Rep.report_metrics(cases, bed_features(spark, sf_dir), AS_OF)
    series = Rep.report_series(cases, AS_OF)
    latest = F.max(F.col("notified_on") <= F.lit(AS_OF))
    told = cases.agg(latest.alias("has_cases")).withColumn("comment", F.lit("as told"))
    context = Rep.report_context(metrics, series.select("cases_per_state"), told)
    return context.select(
        "total_cases_month", "last_notification",
        F.size("cases_per_state").cast("bigint").alias("n_states"), "comment", "has_cases",
    )
