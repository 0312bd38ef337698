"""Vaccination of notified cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewatch.contracts import CASES, CaseSchema
from casewatch.functions import dates as D, rates as R
from casewatch.operators import filters as P


def vaccination_rate(
    df: DataFrame, year_month: str | None = None, by_state: bool = False, s: CaseSchema = CASES
) -> DataFrame:
    """Vaccinated cases per 100 notifications of a month, also per state.

    Reads the 0/1 features. Without a month it covers the latest one.
    """
    group = [D.year_month(s.notified_on).alias("year_month")]
    if by_state:
        group.append(F.col(s.state).alias("state"))
    total = F.col("total_notifications")
    return (
        P.notified_in_month(df, s, year_month)
        .groupBy(*group)
        .agg(
            F.count(s.key).alias("total_notifications"),
            F.sum(s.vaccinated_covid).alias("vaccinated_covid"),
            F.sum(s.vaccinated_flu).alias("vaccinated_flu"),
        )
        .withColumns(
            {
                "rate_vaccinated_covid": R.percent_half_up("vaccinated_covid", total),
                "rate_vaccinated_flu": R.percent_half_up("vaccinated_flu", total),
            }
        )
    )


def vaccination_by_state_ranked(
    df: DataFrame,
    year_month: str | None = None,
    sort_by: str = "rate_vaccinated_covid",
    s: CaseSchema = CASES,
) -> DataFrame:
    """Vaccination per state, highest rate first."""
    rates = vaccination_rate(df, year_month, by_state=True, s=s)
    return rates.orderBy(F.desc_nulls_last(sort_by), F.asc_nulls_last("state"))
