"""Feature tables of cases and beds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewatch import contracts as C
from casewatch.contracts import BEDS, CASES, BedSchema, CaseSchema
from casewatch.functions import dates as D, features as X


def with_case_features(df: DataFrame, s: CaseSchema = CASES) -> DataFrame:
    """Add the seven derived columns; narrow, so it fuses into the scan stage."""
    return df.withColumns(
        {
            s.is_death: X.flag(s.outcome, C.OUTCOME_DEATH),
            s.is_discharge: X.flag(s.outcome, C.OUTCOME_DISCHARGE),
            s.icu_days: X.icu_days(s),
            s.age_years: X.age_years(s),
            s.vaccinated_covid: X.flag(s.vac_covid, C.CODE_YES),
            s.vaccinated_flu: X.flag(s.vac_flu, C.CODE_YES),
        }
    ).withColumns({s.bed_class: X.bed_class(s)})


def with_month(df: DataFrame, s: CaseSchema) -> DataFrame:
    """Add the notification month the schema names as partition column, if any."""
    return df if s.month is None else df.withColumn(s.month, D.month_start(F.col(s.notified_on)))


def case_features(df: DataFrame, s: CaseSchema = CASES, columns=None) -> DataFrame:
    """Kept case columns plus the derived ones, and the month to partition by."""
    return with_month(with_case_features(df.select(*columns) if columns else df, s), s)


def beds_per_state_month(df: DataFrame, min_comp: int, s: BedSchema = BEDS) -> DataFrame:
    """Beds of each class per state and month after `min_comp` (yyyyMM)."""
    per_month = df.filter(F.col(s.comp) > min_comp).groupBy(s.state, s.comp)
    raw = (s.adult, s.pediatric, s.neonatal)
    beds = per_month.agg(*[F.sum(beds).alias(name) for beds, name in zip(raw, s.sums)])
    return beds.select(
        s.state,
        *s.sums,
        F.concat(s.state, F.col(s.comp).cast("string")).alias(s.key),
        D.month_of_comp(s.comp).alias(s.month),
    )
