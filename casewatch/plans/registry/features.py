"""Derived columns, projections, filters and calendar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewatch.contracts import OCCUPANCY_LABELS, VACCINATION_LABELS
from casewatch.functions import dates as D, rates as R, text as X
from casewatch.operators import filters as P, vaccination as V
from casewatch.operators.features import beds_per_state_month as sum_beds, case_features as derive
from casewatch.plans.fixtures import (
    BEDS_SQL, CASES_SQL, FEATURES_SQL, STATE_CASES_SQL, load, load_beds, load_cases, text_dates,
)
from casewatch.plans.registry import query
from casewatch.plans.registry.indicators import STAY_IN, VACCINATION_SQL, feature_cases


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL} select case_id, cast(notified_on as varchar) as notified_on,
state, is_death, is_discharge, cast(icu_days as int) as icu_days, age_years, vaccinated_covid,
vaccinated_flu, bed_class from feats""")
def case_features(spark, sf_dir):
    """The seven derived columns of every case."""
    features = derive(load_cases(spark, sf_dir, state=True))
    return text_dates(
        features.select(
            "case_id", "notified_on", "state", "is_death", "is_discharge", "icu_days",
            "age_years", "vaccinated_covid", "vaccinated_flu", "bed_class",
        )
    )


@query(f"""with {BEDS_SQL} select state, cast(sum(beds_adult) as bigint) as adult,
cast(sum(beds_ped) as bigint) as pediatric, cast(sum(beds_neo) as bigint) as neonatal,
state || cast(comp as varchar) as beds_key,
cast(make_date(comp // 100, comp % 100, 1) as varchar) as beds_month
from beds where comp > 200105 group by state, comp""")
def beds_per_state_month(spark, sf_dir):
    """Beds per state and month after a lower bound."""
    return text_dates(sum_beds(load_beds(spark, sf_dir), 200105))


@query(f"""with {CASES_SQL} select case_id, cast(notified_on as varchar) as notified_on from cases
where notified_on between date '2000-02-29' and date '2001-02-28'""")
def between_dates(spark, sf_dir):
    """Cases of a period, both ends included."""
    cases = P.between_dates(load_cases(spark, sf_dir), "notified_on", "2000-02-29", "2001-02-28")
    return text_dates(cases.select("case_id", "notified_on"))


@query(f"""with {CASES_SQL} select case_id, cast(notified_on as varchar) as notified_on from cases
where strftime(notified_on, '%Y-%m') = '2000-02'""")
def in_month(spark, sf_dir):
    """Cases of one month."""
    cases = P.in_month(load_cases(spark, sf_dir), "notified_on", "2000-02")
    return text_dates(cases.select("case_id", "notified_on"))


@query(f"""with {CASES_SQL} select case_id, cast(icu_in as varchar) as icu_in, cast(icu_out as varchar) as icu_out
from cases where year(icu_in) = 2000 or year(icu_out) = 2000""")
def in_year(spark, sf_dir):
    """Stays that begin or end in a year."""
    cases = P.in_year(load_cases(spark, sf_dir), ["icu_in", "icu_out"], "2000-06-15")
    return text_dates(cases.select("case_id", "icu_in", "icu_out"))


@query(f"""with {CASES_SQL} select case_id, cast(icu_in as varchar) as icu_in, cast(icu_out as varchar) as icu_out
from cases where {STAY_IN.format(a="date '1998-02-27'", b="date '1998-03-03'")}""")
def stays_overlapping(spark, sf_dir):
    """Stays that touch a period across a month end."""
    touching = P.stays_overlapping("icu_in", "icu_out", "1998-02-27", "1998-03-03")
    return text_dates(load_cases(spark, sf_dir).filter(touching).select("case_id", "icu_in", "icu_out"))


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
def with_codes(spark, sf_dir):
    """Rows whose code is in a list."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.with_codes(orders, "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("""select doc_id, lang, n_chars from documents
where doc_id in (select doc_id from labels where quality = 1)""")
def with_codes_from_table(spark, sf_dir):
    """Rows whose code is in another table."""
    good = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return P.with_codes(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", good)


@query(f"""with {STATE_CASES_SQL} select count(*) as n, count(state) as with_state,
count(*) filter (icu_in is null) as no_stay, count(*) filter (icu_in is not null and icu_out is null) as open_stays,
count(*) filter (outcome is null) as no_outcome from cases""")
def null_tests(spark, sf_dir):
    """Missing values of the case table by kind."""
    cases = load_cases(spark, sf_dir, state=True)
    no_in, no_out = F.col("icu_in").isNull(), F.col("icu_out").isNull()
    return cases.agg(
        F.count("*").alias("n"),
        F.count("state").alias("with_state"),
        F.count_if(no_in).alias("no_stay"),
        F.count_if(~no_in & no_out).alias("open_stays"),
        F.count_if(F.col("outcome").isNull()).alias("no_outcome"),
    )


@query(f"""with {STATE_CASES_SQL} select case_id, state, coalesce(outcome, 0) as outcome,
cast(outcome_on as varchar) as outcome_on from cases where state is not null""")
def fill_numbers(spark, sf_dir):
    """Null numbers filled, null dates kept, rows without a state dropped."""
    cases = load_cases(spark, sf_dir, state=True).dropna(subset=["state"])
    return text_dates(P.fill_numbers(cases.select("case_id", "state", "outcome", "outcome_on")))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount from lineitem""")
def sorted_columns(spark, sf_dir):
    """Projection in alphabetical column order."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_partkey", "l_orderkey", "l_linenumber", "l_discount"
    )
    return P.sorted_columns(lines)


@query(f"""with {STATE_CASES_SQL}, {FEATURES_SQL}, v as ({VACCINATION_SQL.format(
    state=", state", a="date '2001-06-01'", b="date '2001-07-01'")}) select
{", ".join(f'{name} as "{label}"' for name, label in VACCINATION_LABELS.items())} from v""")
def relabel(spark, sf_dir):
    """Vaccination table under its report labels."""
    rates = V.vaccination_rate(feature_cases(spark, sf_dir, True), "2001-06", by_state=True)
    return P.relabel(rates, {**OCCUPANCY_LABELS, **VACCINATION_LABELS})


@query("""select case_id, cast(date_trunc('month', d)::date as varchar) as month_start,
cast(last_day(d) as varchar) as month_end, cast((d - interval 13 month)::date as varchar) as months_before,
cast(d - 30 as varchar) as days_before, strftime(d, '%Y-%m') as year_month,
strftime(d, '%d-%m-%Y') as day_label, strftime(d, '%m/%Y') as month_label,
cast((date_trunc('month', d - 1) + interval 1 month)::date as varchar) as month_ceil,
cast(date_trunc('year', d)::date as varchar) as year_start
from (select o_orderkey as case_id, o_orderdate::date as d from orders)""")
def calendar_columns(spark, sf_dir):
    """Calendar arithmetic on every notification date."""
    d = F.col("notified_on")
    return text_dates(
        load_cases(spark, sf_dir).select(
            "case_id",
            D.month_start(d).alias("month_start"),
            D.month_end(d).alias("month_end"),
            D.months_before(d, 13).alias("months_before"),
            D.days_before(d, 30).alias("days_before"),
            D.year_month(d).alias("year_month"),
            D.day_label(d).alias("day_label"),
            D.month_label(d).alias("month_label"),
            D.month_ceil(d).alias("month_ceil"),
            D.year_start(d).alias("year_start"),
        )
    )


@query("""select o_orderkey as case_id,
cast(try_strptime(t, '%d/%m/%Y')::date as varchar) as parsed,
cast(date_trunc('month', o_orderdate)::date as varchar) as comp_month,
cast(date_trunc('month', o_orderdate)::date as varchar) as text_month
from (select *, case when o_orderstatus = 'O' then 'unknown' else strftime(o_orderdate, '%d/%m/%Y') end as t from orders)""")
def text_to_date(spark, sf_dir):
    """Dates from dirty text, yyyyMM numbers and 'yyyy-MM' text."""
    date_text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return text_dates(
        load(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("case_id"),
            D.text_to_date(
                F.when(F.col("o_orderstatus") == "O", "unknown").otherwise(date_text), "dd/MM/yyyy"
            ).alias("parsed"),
            D.month_of_comp(F.date_format("o_orderdate", "yyyyMM").cast("int")).alias("comp_month"),
            D.month_of_year_month(F.date_format("o_orderdate", "yyyy-MM")).alias("text_month"),
        )
    )


@query("""select l_orderkey, l_linenumber,
round_even(l_discount / nullif(l_tax, 0) * 100, 2) as half_even,
round(l_discount / nullif(l_tax, 0) * 100, 2) as half_up,
case when l_tax = 0 and l_discount > 0 then 100e0
  when round_even(l_discount / nullif(l_tax, 0) * 100, 2) > 100 then 100e0
  else round_even(l_discount / nullif(l_tax, 0) * 100, 2) end as capped from lineitem""")
def rates(spark, sf_dir):
    """Safe percentages under both rounding rules, and capped."""
    part, whole = F.col("l_discount"), F.col("l_tax")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        R.percent_half_even(part, whole).alias("half_even"),
        R.percent_half_up(part, whole).alias("half_up"),
        R.capped_percent(part, whole).alias("capped"),
    )


@query("""select doc_id, regexp_replace(text, '\\n\\s*', ' ', 'g') as text from documents""")
def collapse_newlines(spark, sf_dir):
    """Whole texts with their line breaks collapsed."""
    return load(spark, sf_dir, "documents").select("doc_id", X.collapse_newlines(F.col("text")).alias("text"))


@query("""select o_orderkey, 's3a://cases/' || year(o_orderdate) || '/' || o_orderkey || '.csv' as path from orders""")
def to_object_path(spark, sf_dir):
    """Public URL to object-store path."""
    url = F.format_string(
        "https://s3.sa-east-1.amazonaws.com/cases/%d/%d.csv", F.year("o_orderdate"), F.col("o_orderkey")
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", X.to_object_path(url).alias("path"))
