"""Features of one case as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casewatch import contracts as C
from casewatch.contracts import CaseSchema


def flag(column: str, code: int) -> Column:
    """1 where the code matches, 0 otherwise, also for null."""
    return F.when(F.col(column) == code, 1).otherwise(0)


def icu_days(s: CaseSchema) -> Column:
    """Days from ICU entry to exit, or to the outcome while there is no exit."""
    return F.datediff(F.coalesce(s.icu_out, s.outcome_on), s.icu_in)


def age_years(s: CaseSchema) -> Column:
    """Age in years; a value in smaller units is rounded to 2 decimals, half up."""
    value, unit = F.col(s.age_value), F.col(s.age_unit)
    years = value.cast("double")
    for code, per_year in C.AGE_UNITS_PER_YEAR.items():
        years = F.when(unit == code, F.round(value / per_year, 2)).otherwise(years)
    return years


def bed_class(s: CaseSchema) -> Column:
    """Bed class by age; an unknown age counts as pediatric."""
    age = F.col(s.age_years)
    return (
        F.when(age <= C.NEONATAL_UP_TO, F.lit(s.neonatal))
        .when(age >= C.ADULT_FROM, F.lit(s.adult))
        .otherwise(F.lit(s.pediatric))
    )
