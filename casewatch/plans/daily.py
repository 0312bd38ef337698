"""The first full load and the daily run: snapshots, beds, features, report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casewatch.contracts import BEDS, CASES, BedSchema, CaseSchema
from casewatch.operators import quality
from casewatch.operators.features import beds_per_state_month, case_features, with_month
from casewatch.plans.report import report
from casewatch.sources import changes, snapshots as N, tables
from casewatch.sources.delimited import read_with_contract, read_zipped_csv


@dataclass(frozen=True)
class Tables:
    """Names of the tables of a deployment."""

    cases: str = "cases_raw"
    beds: str = "beds_raw"
    ledger: str = "case_updates"
    case_features: str = "case_features"
    bed_features: str = "bed_features"


def _partitions(s: CaseSchema) -> list[str]:
    return [s.month] if s.month else []


def load_history(
    spark: SparkSession, paths, contract: T.StructType, name: str, sep: str = ";",
    s: CaseSchema | None = None, bucket_by=None,
) -> DataFrame:
    """Yearly files under one contract into one new table; returns its repeated rows.

    Features of an earlier table of the name are then built in full at the next `build_features`.
    """
    changes.forget(spark, name)
    rows = tables.union_years([read_with_contract(spark, path, contract, sep) for path in paths])
    parts = _partitions(s) if s else []
    tables.write_table(with_month(rows, s) if s else rows, name, partition_by=parts, bucket_by=bucket_by)
    return quality.duplicate_rows(tables.read_table(spark, name))


def write_extract(
    spark: SparkSession, source: str, columns, name: str, fraction: float = 0.1, seed: int = 42,
    by_key=None,
) -> None:
    """Table of some columns and, beside it, a sample of its rows."""
    tables.write_table(tables.read_table(spark, source).select(*columns), name)
    rows = quality.sample_rows(tables.read_table(spark, name), fraction, seed, by_key)
    tables.write_table(rows, f"{name}_sample")


def load_fresh_beds(
    spark: SparkSession, archives, contract: T.StructType, names: Tables = Tables(),
    b: BedSchema = BEDS, sep: str = ";", partitions: int | None = None,
) -> None:
    """Merge zipped bed inventories by facility and month; a key may occur once among the archives."""
    beds = read_zipped_csv(spark, archives, contract, sep=sep, partitions=partitions, strict=True)
    tables.upsert_table(
        beds, names.beds, [b.facility, b.comp], on_duplicate="error", before=lambda rows: changes.record(rows, names.beds)
    )


def load_fresh_cases(
    spark: SparkSession, folder: str, as_of: date, contract: T.StructType,
    names: Tables = Tables(), s: CaseSchema = CASES, sep: str = ";", order_by=None,
) -> DataFrame:
    """Merge the snapshots the ledger has not seen; returns the snapshots loaded.

    Of several entries of a key in one file the last by `order_by` counts: name the columns that tell
    a correction from what it corrects, such as the day of digitising. Without, it is the
    notification day, which corrections often share; then the larger remaining cells win. The ledger
    advances only after the merge, so a failed load is tried again. The tables are
    partitioned by the schema's month, if it names one.
    """
    order_by = [s.notified_on] if order_by is None else list(order_by)
    found = N.latest_snapshot(N.list_snapshots(spark, folder), as_of)
    # one row per published year
    fresh = N.fresh_only(found, N.read_ledger(spark, names.ledger)).orderBy("year").collect()
    for snapshot in fresh:
        rows = with_month(read_with_contract(spark, snapshot.path, contract, sep), s)
        tables.upsert_table(
            rows, names.cases, [s.key], order_by=order_by, partition_by=_partitions(s),
            before=lambda batch: changes.record(batch, names.cases),
        )
        N.ledger_record(spark, names.ledger, spark.createDataFrame([snapshot]))
    schema = T.StructType([T.StructField("path", T.StringType()), *N.LEDGER.fields])
    return tables.from_rows(spark, [(r.path, r.year, r.updated_on) for r in fresh], schema)


def build_features(
    spark: SparkSession, min_comp: int, names: Tables = Tables(), s: CaseSchema = CASES,
    b: BedSchema = BEDS, columns=None, full: bool = False,
) -> None:
    """Bring both feature tables up to date with the raw tables.

    Features are derived for the cases that loads have touched since the last time, and for the months
    of inventory they touched; partitions without any keep their files. Everything is built with
    `full`, the first time, after `load_history`, and where the raw table was written by other
    means than the loads of this module, which must then say `full`.
    """
    parts = _partitions(s)

    def of_cases(rows: DataFrame, changed: DataFrame | None) -> DataFrame:
        if changed is not None:
            rows = changes.touched(rows, changed, [s.key], parts)
        return case_features(rows, s, columns)

    def of_beds(rows: DataFrame, changed: DataFrame | None) -> DataFrame:
        if changed is not None:  # a month's sums need all of its facilities
            rows = changes.touched(rows, changed, [b.comp])
        return beds_per_state_month(rows, min_comp, b)

    _follow(spark, names.cases, names.case_features, of_cases, s.key, parts, [s.key, *parts], full)
    _follow(spark, names.beds, names.bed_features, of_beds, b.key, [], [b.facility, b.comp], full)


def _follow(spark, source: str, name: str, derive, key, parts, listed, full: bool) -> None:
    """Merge into `name` what is derived from the changed rows of `source`, or from all."""
    changed = changes.pending(spark, source) if tables.table_exists(spark, name) and not full else None
    done = [] if changed is None else changes.batches(changed)
    if changed is not None and not done:
        return
    now = changed if changed is None else changed.filter(F.col(changes.BATCH).isin(done))
    tables.write_feature_table(derive(tables.read_table(spark, source), now), name, key, parts)
    if changed is None:
        changes.begin(spark, source, listed)
    else:
        changes.settle(spark, source, done)


def daily_report(
    spark: SparkSession, as_of: date, names: Tables = Tables(), s: CaseSchema = CASES,
    b: BedSchema = BEDS,
) -> DataFrame:
    """All values of a day's report, one row."""
    cases = tables.read_table(spark, names.case_features)
    beds = tables.read_table(spark, names.bed_features)
    return report(cases, beds, as_of, s, b)
