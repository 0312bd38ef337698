"""Keys that loads have touched and that derived tables have not followed yet.

Beside a table lies a list of its changed keys, in batches, each with the partition the row is in
now. It exists only once a derived table has been built in full; a missing list therefore
means "build everything". A load lists its keys before it merges them, and a batch leaves the list
after the derived table has it, so whatever stops in between is done again, never left out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewatch.sources import tables

BATCH = "batch"


def list_of(name: str) -> str:
    return f"{name}_changes"


def begin(spark: SparkSession, name: str, columns) -> None:
    """Start an empty list: the derived table has all there is in `name`."""
    columns = list(dict.fromkeys(columns))
    empty = tables.read_table(spark, name).select(*columns).limit(0)
    tables.write_table(empty.withColumn(BATCH, F.lit(None).cast("string")), list_of(name))


def forget(spark: SparkSession, name: str) -> None:
    """Remove the list: what it would lead to is no longer all that changed."""
    spark.sql(f"DROP TABLE IF EXISTS {list_of(name)}")


def record(rows: DataFrame, name: str) -> None:
    """List the keys of a batch of `name`, if anything follows that table."""
    spark = rows.sparkSession
    if not tables.table_exists(spark, list_of(name)):
        return
    columns = [c for c in tables.read_table(spark, list_of(name)).columns if c != BATCH]
    batch = rows.select(*columns).distinct().withColumn(BATCH, F.lit(uuid.uuid4().hex))
    tables.write_table(batch, list_of(name), mode="append")


def pending(spark: SparkSession, name: str) -> DataFrame | None:
    """Changed keys with their batches; None if there is no list, so that all counts as changed."""
    return tables.read_table(spark, list_of(name)) if tables.table_exists(spark, list_of(name)) else None


def batches(changed: DataFrame) -> list[str]:
    """Ids of the batches: one per load since the derived table was last brought up to date."""
    return sorted(r[0] for r in changed.select(BATCH).distinct().collect())


def settle(spark: SparkSession, name: str, done: list[str]) -> None:
    """Take batches off the list."""
    if done:
        tables.write_table(tables.read_table(spark, list_of(name)).filter(~F.col(BATCH).isin(done)), list_of(name))


def touched(rows: DataFrame, changed: DataFrame, keys, partitions=()) -> DataFrame:
    """The rows of the changed keys; only partitions that a changed row is in are read."""
    keys = list(keys)
    if partitions:
        # as many values as the table has partitions, as for any keyed write
        values = {tuple(r) for r in changed.select(*partitions).distinct().collect()}
        if not values:
            return rows.limit(0)
        rows = rows.filter(tables.in_partitions(partitions, values))
    listed = changed.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same: list[Column] = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(listed, reduce(lambda a, b: a & b, same), "left_semi")
