"""Derived columns, filters and rates on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from casewatch.contracts import (
    BED_COLUMNS, CASES, FEATURE_CASE_COLUMNS, NOTIFICATION_FORM,
)
from casewatch.functions import dates as D, rates as R
from casewatch.operators import filters as P
from casewatch.operators.features import beds_per_state_month, case_features, with_case_features
from tests.helpers import cases, day, rows


def test_column_sets_have_the_published_size():
    assert [len(c) for c in (FEATURE_CASE_COLUMNS, BED_COLUMNS)] == [31, 20]


@pytest.mark.parametrize(
    "value, unit, years, bed",
    [
        (28, 1, 0.08, "pediatric"),
        (27, 1, 0.07, "neonatal"),
        (1, 2, 0.08, "pediatric"),
        (0, 2, 0.0, "neonatal"),
        (12, 3, 12.0, "adult"),
        (11, 3, 11.0, "pediatric"),
        (None, None, None, "pediatric"),
    ],
)
def test_age_and_bed_class(spark, value, unit, years, bed):
    df = with_case_features(cases(spark, [{"age_value": value, "age_unit": unit}]))
    assert rows(df.select("age_years", "bed_class")) == [(years, bed)]


def test_icu_days_fall_back_to_the_outcome_and_may_be_negative(spark):
    df = cases(
        spark,
        [
            {"icu_in": "2025-01-10", "icu_out": "2025-01-15", "outcome_on": "2025-02-01"},
            {"icu_in": "2025-01-10", "outcome_on": "2025-01-12"},
            {"icu_in": "2025-01-10", "icu_out": "2025-01-08"},
            {"icu_in": "2025-01-10"},
            {"outcome_on": "2025-01-12"},
        ],
    )
    got = with_case_features(df).select("case_id", "icu_days")
    assert rows(got) == [(0, 5), (1, 2), (2, -2), (3, None), (4, None)]


def test_flags_are_zero_for_null_and_other_codes(spark):
    df = cases(
        spark,
        [{"outcome": 1, "vac_covid": 1, "vac_flu": 2}, {"outcome": 2, "vac_covid": 9}, {}],
    )
    got = with_case_features(df).select("is_death", "is_discharge", "vaccinated_covid", "vaccinated_flu")
    assert rows(got) == [(0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 0, 0)]


def test_published_form_gives_38_columns(spark):
    roles = {"NU_IDADE_N": "int", "TP_IDADE": "int", "EVOLUCAO": "int", "VACINA": "int", "VACINA_COV": "int"}
    schema = ", ".join(
        f"{c} {'date' if c.startswith('DT_') else roles.get(c, 'string')}" for c in FEATURE_CASE_COLUMNS
    )
    row = {c: None for c in FEATURE_CASE_COLUMNS} | {"NU_NOTIFIC": "7", "NU_IDADE_N": 40, "TP_IDADE": 3}
    df = spark.createDataFrame([tuple(row.values())], schema)
    features = case_features(df, NOTIFICATION_FORM, FEATURE_CASE_COLUMNS)
    assert len(features.columns) == 38
    assert features.first()["classificacao_etaria_leito"] == "adulto"


def test_beds_key_and_month(spark):
    schema = "facility_id int, comp int, state string, beds_adult int, beds_ped int, beds_neo int"
    beds = spark.createDataFrame(
        [(1, 202501, "SP", 2, 1, 0), (2, 202501, "SP", 3, None, 1), (1, 202412, "SP", 9, 9, 9)], schema
    )
    got = beds_per_state_month(beds, 202500)
    assert rows(got) == [("SP", 5, 1, 1, "SP202501", date(2025, 1, 1))]


def test_between_dates_includes_both_ends_and_drops_null(spark):
    df = cases(spark, [{"notified_on": d} for d in ("2025-01-01", "2025-01-31", "2025-02-01", None)])
    got = P.between_dates(df, "notified_on", "2025-01-01", date(2025, 1, 31))
    assert rows(got.select("case_id")) == [(0,), (1,)]
    assert got.columns == df.columns


def test_in_month_defaults_to_the_latest(spark):
    df = cases(spark, [{"notified_on": d} for d in ("2024-12-31", "2025-01-01", "2025-01-31")])
    assert rows(P.in_month(df, "notified_on").select("case_id")) == [(1,), (2,)]
    assert rows(P.in_month(df, "notified_on", "2024-12").select("case_id")) == [(0,)]


def test_fill_numbers_leaves_text_and_dates(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a int, b double, c string, d date")
    assert rows(P.fill_numbers(df)) == [(0, 0.0, None, None)]


def test_codes_from_a_table_with_repeats_do_not_multiply(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
    codes = spark.createDataFrame([("a",), ("a",)], "k string")
    assert rows(P.with_codes(df, "code", codes)) == [("a", 1)]


def test_rates(spark):
    df = spark.createDataFrame(
        [(5.0, 0.0), (0.0, 0.0), (200.0, 100.0), (1.0, 800.0), (3.0, 800.0), (None, 5.0)], "p double, w double"
    )
    p, w = F.col("p"), F.col("w")
    got = df.select(
        R.capped_percent(p, w).alias("c"), R.percent_half_even(p, w).alias("e"), R.percent_half_up(p, w).alias("u")
    ).collect()
    assert [r.c for r in got] == [100.0, None, 100.0, 0.12, 0.38, None]
    assert [r.e for r in got] == [None, None, 200.0, 0.12, 0.38, None]
    assert [r.u for r in got] == [None, None, 200.0, 0.13, 0.38, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (3.0,), (300.0,)], "x double")
    assert [r[0] for r in df.select(R.clip_upper(F.col("x"), 100)).collect()] == [None, 3.0, 100.0]


def test_calendar(spark):
    one = spark.range(1)
    got = one.select(
        D.month_ceil("2025-01-01"), D.month_ceil("2025-01-02"), D.month_ceil("2025-12-31"),
        D.months_before("2024-02-29", 12), D.month_end("2024-02-03"),
        D.month_of_comp(F.lit(202501)), D.month_of_comp(F.lit(209999)), D.month_of_year_month("2025-03"),
        D.text_to_date(F.lit("31/02/2025"), "dd/MM/yyyy"),
    ).first()
    assert list(got) == [
        day("2025-01-01"), day("2025-02-01"), day("2026-01-01"), day("2023-02-28"), day("2024-02-29"),
        day("2025-01-01"), None, day("2025-03-01"), None,
    ]


def test_relabel_and_sorted_columns(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert P.sorted_columns(df).columns == ["a", "b"]
    assert P.relabel(df, {"b": "B", "x": "X"}).columns == ["B", "a"]
    assert CASES.with_names(state="uf").state == "uf"
