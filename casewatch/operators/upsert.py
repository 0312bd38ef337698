"""Keyed merge of a batch of newer rows into a table's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _any_null(keys) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def keep_latest(source: DataFrame, keys, order_by=(), on_duplicate: str = "latest") -> DataFrame:
    """One row per non-null key: the largest by `order_by`, then by all columns.

    Without `order_by` nothing tells the newest, and a repeated key fails the job.
    It is an aggregate, so a key that holds a third of the batch shrinks to one
    row per input task before the shuffle. Rows with a null key never match each
    other and all stay. `on_duplicate='error'` fails the job instead.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in source.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order_by], *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    rows = source.filter(~_any_null(keys)).groupBy(*keys).agg(
        F.max(ranked).alias("_row"), F.count("*").alias("_copies")
    )
    if on_duplicate == "error" or not order_by:
        message = F.concat(F.lit("duplicate key in the source: "), F.to_json(F.struct(*keys)))
        unique = F.when(F.col("_copies") == 1, F.col("_row")).otherwise(F.raise_error(message))
        rows = rows.withColumn("_row", unique.cast(rows.schema["_row"].dataType))
    kept = rows.select(*keys, *[F.col(f"_row._{i}").alias(c) for i, c in enumerate(rest)])
    return kept.unionByName(source.filter(_any_null(keys))).select(*source.columns)


def upsert(
    target: DataFrame, source: DataFrame, keys, order_by=(), on_duplicate: str = "latest"
) -> DataFrame:
    """Rows of `target` whose key `source` does not have, plus all of `source`.

    Equal to an update-all / insert-all merge. A null key matches nothing, so
    such rows of the target bypass the join (they would all meet in one task) and
    such rows of the source are added every time.
    """
    keys = list(keys)
    return merge(target, keep_latest(source, keys, order_by, on_duplicate), keys)


def merge(target: DataFrame, newer: DataFrame, keys) -> DataFrame:
    """`upsert` of a batch that has each key once."""
    newer, has_null = newer.select(*target.columns), _any_null(keys)
    kept = target.filter(~has_null).join(newer.select(*keys), keys, "left_anti")
    return kept.select(*target.columns).unionByName(target.filter(has_null)).unionByName(newer)


def upsert_audit(target: DataFrame, source: DataFrame, keys, order_by=()) -> DataFrame:
    """What `upsert` would do, as one row of counts taken from the keys.

    Both sides shrink to their keys and a side mark before the shuffle, and one
    aggregate over the union gives every count.
    """
    keys = list(keys)
    sides = target.select(*keys, F.lit(1).alias("_t"), F.lit(0).alias("_s")).unionByName(
        source.select(*keys, F.lit(0).alias("_t"), F.lit(1).alias("_s"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("_t").alias("t"), F.sum("_s").alias("s"))
    t, s = F.col("t"), F.col("s")
    null_key, in_both = _any_null(keys), (t > 0) & (s > 0)
    kept = F.when(null_key | (s == 0), t).otherwise(0)
    added = F.when(null_key, s).when(s > 0, 1).otherwise(0)
    return per_key.agg(
        F.coalesce(F.sum(t), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(s), F.lit(0)).alias("rows_source"),
        F.coalesce(F.sum(kept + added), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum(F.when(null_key, s).when(t == 0, 1).otherwise(0)), F.lit(0)).alias("inserted"),
        F.coalesce(F.sum(F.when(in_both & ~null_key, 1).otherwise(0)), F.lit(0)).alias("updated"),
        F.coalesce(F.sum(F.when(~null_key & (s > 1), s - 1).otherwise(0)), F.lit(0)).alias("superseded"),
    ).select(*[F.col(c).cast("bigint").alias(c) for c in AUDIT_COLUMNS])


AUDIT_COLUMNS = ("rows_before", "rows_source", "rows_after", "inserted", "updated", "superseded")
