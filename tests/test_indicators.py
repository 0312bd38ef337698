"""Counts and rates on hand-made rows, and the report frames."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from casewatch.operators import counts as N, filters as P, stays as S, vaccination as V
from casewatch.operators.features import with_case_features
from casewatch.plans import report as Rep
from tests.helpers import cases, day, rows

BED_FEATURES = "state string, adult bigint, pediatric bigint, neonatal bigint, beds_key string, beds_month date"


def notified(spark, *dates, **more):
    return cases(spark, [{"notified_on": d, **more} for d in dates])


def test_twelve_month_window_touches_thirteen_months(spark):
    df = notified(spark, "2024-06-29", "2024-06-30", "2025-06-30", "2025-07-01", None)
    got = N.cases_per_month(df, date(2025, 6, 30))
    assert [tuple(r) for r in got.collect()] == [(day("2024-06-01"), 1), (day("2025-06-01"), 1)]


def test_cases_per_day_ends_at_the_latest(spark):
    df = notified(spark, "2025-01-01", "2025-01-02", "2025-02-01", "2025-02-01", None)
    got = N.cases_per_day(df)
    assert [tuple(r) for r in got.collect()] == [(day("2025-01-02"), 1), (day("2025-02-01"), 2)]


def test_variation_counts_the_first_of_the_month(spark):
    df = notified(spark, "2025-05-01", "2025-05-31", "2025-05-15", "2024-05-01", "2024-05-31", "2025-06-01")
    assert rows(N.variation_rate(df, date(2025, 6, 10))) == [(3, 2, 50.0)]


def test_variation_without_comparison_is_null(spark):
    df = notified(spark, "2025-05-01")
    assert rows(N.variation_rate(df, date(2025, 6, 10))) == [(1, 0, None)]


def test_variation_is_rounded_before_the_percentage(spark):
    df = notified(spark, *["2025-05-03"] * 2, *["2024-05-03"] * 3)
    assert rows(N.variation_rate(df, date(2025, 6, 10))) == [(2, 3, -33.0)]


def test_variation_in_leap_years(spark):
    df = notified(spark, "2023-02-28", "2023-03-01", "2024-02-29")
    assert rows(N.variation_rate(df, date(2024, 3, 31))) == [(1, 1, 0.0)]


def test_tail_sum_by_rows_and_by_days(spark):
    series = spark.createDataFrame([(day("2025-01-01"), 5), (day("2025-01-30"), 2), (day("2025-01-31"), 1)], "day date, n bigint")
    assert N.tail_sum(series).first()[0] == 8
    assert N.tail_sum(series, unit="days").first()[0] == 3
    assert N.tail_sum(series.limit(0)).first()[0] is None


def test_gap_fill_cuts_past_thirty_days_and_keeps_sums(spark):
    series = spark.createDataFrame(
        [(day("2025-01-01"), 5), (day("2025-01-31"), 2), (day("2025-02-01"), 1)], "day date, n bigint"
    )
    got = N.fill_daily_gaps(series).collect()
    assert len(got) == 31 and sum(r.n for r in got) == 7
    assert N.fill_daily_gaps(series.limit(0)).collect() == []


def test_series_bounds(spark):
    series = spark.createDataFrame([(day("2025-01-01"), 5), (day("2025-01-30"), 2)], "day date, n bigint")
    assert rows(N.series_bounds(series)) == [(day("2025-01-01"), day("2025-01-30"), 5, True)]
    assert rows(N.last_value(series, "day")) == [(day("2025-01-30"), 2)]


def test_cases_per_state_order_and_null(spark):
    df = cases(spark, [{"state": s} for s in ("B", "A", "A", None, None, None, "C")])
    assert [tuple(r) for r in N.cases_per_state(df).collect()] == [("A", 2), ("B", 1), ("C", 1)]


# Stays -----------------------------------------------------------------------

def test_overlap_edges(spark):
    stays = [
        ("2025-01-10", None),           # open: entry month only
        ("2025-03-05", "2025-01-20"),   # reversed: both own months
        ("2025-01-31", "2025-02-01"),   # month end to month start
        ("2025-01-15", "2025-03-15"),   # spans three months
        (None, "2025-02-10"),           # exit only
        (None, None),
    ]
    df = cases(spark, [{"icu_in": a, "icu_out": b} for a, b in stays])
    got = S.overlap_count(df, "2025-01-01", "2025-04-30")
    want = [("2025-01-01", 4), ("2025-02-01", 3), ("2025-03-01", 2), ("2025-04-01", 0)]
    assert rows(got) == [(day(m), n) for m, n in want]


def random_stays(count, seed):
    rng = random.Random(seed)
    start = date(2024, 1, 1)

    def stay():
        entry = start + timedelta(days=rng.randrange(500))
        exit = entry + timedelta(days=rng.choice([0, 1, 5, 30, 31, 70, 400, -3, -40]))
        return {
            "icu_in": None if rng.random() < 0.1 else str(entry),
            "icu_out": None if rng.random() < 0.2 else str(exit),
        }

    return [stay() for _ in range(count)]


def test_overlap_equals_the_predicate_month_by_month(spark):
    df = cases(spark, random_stays(3000, seed=5))
    start, end = date(2024, 2, 10), date(2025, 6, 20)
    got = {r.month: r.n for r in S.overlap_count(df, start, end).collect()}
    months = [r.month for r in S.month_calendar(df, start, end).collect()]
    assert months[0] == date(2024, 3, 1) and months[-1] == date(2025, 6, 1) and len(months) == 16
    checks = [
        F.count_if(P.stays_overlapping("icu_in", "icu_out", m, (m.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)))
        for m in months
    ]
    want = df.agg(*[c.alias(str(m)) for c, m in zip(checks, months)]).first()
    assert got == {m: want[str(m)] for m in months}


def test_mistyped_exit_year_adds_no_rows(spark):
    df = cases(spark, [{"icu_in": "2025-01-05", "icu_out": "9999-01-05"}])
    assert rows(S.overlap_count(df, "2025-01-01", "2025-02-28")) == [(day("2025-01-01"), 1), (day("2025-02-01"), 1)]


def test_period_without_a_month_start_has_no_months(spark):
    df = cases(spark, [{"icu_in": "2025-01-20", "icu_out": "2025-01-25"}])
    assert rows(S.overlap_count(df, "2025-01-10", "2025-01-31")) == []


def test_icu_rate_without_cases_and_in_a_partial_month(spark):
    df = cases(
        spark,
        [
            {"notified_on": "2025-01-20", "icu_in": "2025-01-20", "icu_out": "2025-02-03"},
            {"notified_on": "2025-03-02", "icu_in": "2025-03-02"},
            {"notified_on": "2025-03-03"},
            {"notified_on": "2025-03-04"},
        ],
    )
    got = S.icu_admission_rate(df, "2025-01-15", "2025-03-31")
    assert [tuple(r) for r in got.collect()] == [
        ("2025-01", 1, 0, 0.0), ("2025-02", 0, 1, None), ("2025-03", 3, 1, 33.33),
    ]
    assert rows(S.icu_admission_rate(df)) == [("2025-03", 3, 1, 33.33)]


def occupancy_cases(spark):
    stay = {"notified_on": "2025-07-20", "icu_in": "2025-07-02", "icu_out": "2025-07-09"}
    patients = [("A", 40, 5), ("B", 5, 0), ("C", 40, 200), ("D", 40, 1), (None, 40, 3)]
    data = [
        {**stay, "state": s, "age_value": age, "age_unit": 3} for s, age, n in patients for _ in range(n)
    ]
    return with_case_features(cases(spark, data))


def test_occupancy_of_empty_and_overfull_states(spark):
    beds = [("A", 0, 1, 0), ("C", 100, 0, 0), ("D", 3, 0, 0), ("E", 9, 9, 9)]
    rows_of_beds = [(s, a, p, n, s, day("2025-07-01")) for s, a, p, n in beds]
    rows_of_beds.append(("A", 50, 50, 50, "old", day("2025-06-01")))
    df = spark.createDataFrame(rows_of_beds, BED_FEATURES)
    got = S.icu_occupancy_by_state(occupancy_cases(spark), df)
    assert [tuple(r) for r in got.collect()] == [
        ("07/2025", "A", 100.0, 0.0, None, 100.0),
        ("07/2025", "C", 100.0, None, None, 100.0),
        ("07/2025", "D", 33.33, None, None, 33.33),
    ]


def test_stay_outside_the_year_does_not_occupy(spark):
    df = cases(spark, [{"notified_on": "2025-07-20", "state": "A", "icu_in": "2024-01-01", "icu_out": "2026-01-01"}])
    beds = spark.createDataFrame([("A", 1, 1, 1, "A", day("2025-07-01"))], BED_FEATURES)
    assert S.icu_occupancy_by_state(with_case_features(df), beds).collect() == []


def test_pivot_sums_to_the_cases(spark):
    df = with_case_features(cases(spark, [{"state": "A", "age_value": v, "age_unit": 3} for v in (1, 20, 30)]))
    assert rows(S.pivot_bed_class(df)) == [("A", 2, 1, 0)]


# Vaccination -----------------------------------------------------------------

def test_vaccination_counts_keys_and_keeps_unknown_state(spark):
    data = [
        {"notified_on": "2025-05-03", "state": "A", "vac_covid": 1},
        {"notified_on": "2025-05-04", "state": "A", "vac_covid": 2},
        {"notified_on": "2025-05-04", "state": "A", "vac_covid": 2, "vac_flu": 1},
        {"notified_on": "2025-05-04", "vac_flu": 1},
        {"notified_on": "2025-04-30", "state": "A", "vac_covid": 1},
    ]
    df = with_case_features(cases(spark, data))
    assert rows(V.vaccination_rate(df)) == [("2025-05", 4, 1, 2, 25.0, 50.0)]
    ranked = V.vaccination_by_state_ranked(df, "2025-05", sort_by="rate_vaccinated_flu").collect()
    assert [r.state for r in ranked] == [None, "A"]
    assert ranked[1].rate_vaccinated_covid == 33.33


# Report ----------------------------------------------------------------------

def report_inputs(spark):
    data = [
        {"notified_on": f"2025-06-{d:02d}", "state": "sp", "vac_covid": 1, "age_value": 30, "age_unit": 3,
         "icu_in": f"2025-06-{d:02d}", "icu_out": f"2025-06-{d + 1:02d}"}
        for d in range(1, 21)
    ]
    data += [{"notified_on": "2025-05-10", "state": "rj"}] * 3 + [{"notified_on": "2024-05-10", "state": "rj"}] * 2
    data += [{"notified_on": "2025-07-10", "state": "xx"}]
    beds = spark.createDataFrame([("sp", 40, 1, 1, "k", day("2025-06-01"))], BED_FEATURES)
    return with_case_features(cases(spark, data)), beds


def test_report_metrics(spark):
    df, beds = report_inputs(spark)
    got = Rep.report_metrics(df, beds, date(2025, 6, 25)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.last_notification, r.report_date) == ("20-06-2025", date(2025, 6, 25))
    assert (r.cases_last_seven_days, r.total_cases_month, r.variation_rate) == (7, 20, 50.0)
    assert (r.last_month, r.icu_admission_count, r.icu_admission_rate) == ("2025-06", 20, 100.0)
    assert [tuple(x) for x in r.icu_occupancy] == [("06/2025", "sp", 50.0, 0.0, 0.0, 47.62)]
    assert r.vaccination[0].rate_vaccinated_covid == 100.0


def test_report_series_are_ordered(spark):
    df, _ = report_inputs(spark)
    r = Rep.report_series(df, date(2025, 6, 25)).first()
    assert [tuple(x) for x in r.cases_per_month] == [(day("2025-05-01"), 3), (day("2025-06-01"), 20)]
    assert [tuple(x) for x in r.cases_per_state] == [("SP", 20), ("RJ", 5)]
    assert len(r.cases_per_day) == 31 and r.cases_per_day[0].day == day("2025-06-01")
    assert [x.state for x in r.vaccination_per_state] == ["sp"]


def test_report_of_no_cases_is_one_row_of_nulls(spark):
    df, beds = report_inputs(spark)
    r = Rep.report_metrics(df.limit(0), beds, date(2025, 6, 25)).collect()
    assert len(r) == 1 and r[0].last_notification is None and r[0].icu_occupancy == []


def test_context_later_part_wins(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(9, "t")], "y int, z string")
    got = Rep.report_context(a, b).first()
    assert got.asDict() == {"x": 1, "y": 9, "z": "t"}
