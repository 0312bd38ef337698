"""Published snapshots and the ledger of what has been loaded."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewatch.contracts import LEDGER, SNAPSHOT_NAME
from casewatch.functions import dates as D
from casewatch.sources import tables


def list_snapshots(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """File listing (path, length, modificationTime); file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    listed = files.option("recursiveFileLookup", True).load(folder)
    return listed.select("path", "length", "modificationTime")


def latest_snapshot(
    listing: DataFrame, as_of, days_back: int = 30, years=None, pattern: str = SNAPSHOT_NAME
) -> DataFrame:
    """Newest snapshot per year among those of the last `days_back` days.

    Year and day come from the file name; names that do not fit are ignored.
    """
    named = listing.select(
        "path",
        (F.regexp_extract("path", pattern, 1).try_cast("int") + 2000).alias("year"),
        F.try_to_date(F.regexp_extract("path", pattern, 2), "dd-MM-yyyy").alias("updated_on"),
    )
    recent = named.filter(
        (F.col("updated_on") > D.as_date(as_of - timedelta(days=days_back)))
        & (F.col("updated_on") <= D.as_date(as_of))
    )
    if years is not None:
        recent = recent.filter(F.col("year").isin(list(years)))
    newest = F.max(F.struct("updated_on", "path"))
    return recent.groupBy("year").agg(newest.alias("s")).select("year", "s.path", "s.updated_on")


def ledger_latest(ledger: DataFrame, year: int | None = None) -> DataFrame:
    """Newest loaded date per year; no row for a year never loaded."""
    rows = ledger if year is None else ledger.filter(F.col("year") == year)
    return rows.groupBy("year").agg(F.max("updated_on").alias("updated_on"))


def fresh_only(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Snapshots newer than what the ledger has for their year."""
    loaded = ledger_latest(ledger).withColumnRenamed("updated_on", "_loaded_on")
    return (
        candidates.join(loaded, "year", "left")
        .filter(F.col("_loaded_on").isNull() | (F.col("_loaded_on") < F.col("updated_on")))
        .drop("_loaded_on")
    )


def ledger_additions(ledger: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows to append: loaded dates that differ from the ledger's newest."""
    new = loaded.select("year", "updated_on").distinct()
    return new.join(ledger_latest(ledger), ["year", "updated_on"], "left_anti")


def read_ledger(spark: SparkSession, name: str) -> DataFrame:
    """The ledger, empty where it does not exist yet."""
    if tables.table_exists(spark, name):
        return tables.read_table(spark, name)
    return tables.from_rows(spark, [], LEDGER)


def ledger_record(spark: SparkSession, name: str, loaded: DataFrame) -> None:
    """Append the loaded dates; called after their data is in the table."""
    additions = ledger_additions(read_ledger(spark, name), loaded)
    rows = additions.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields])
    mode = "append" if tables.table_exists(spark, name) else "overwrite"
    tables.write_table(rows, name, mode=mode)
