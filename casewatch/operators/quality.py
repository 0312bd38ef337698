"""Data-quality checks, profiles and samples.

The checks over all columns run in a fixed number of passes, however many
columns there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from casewatch.session import stage

RANK_GROUPS = 64
RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def duplicate_rows(df: DataFrame, by_hash: bool = False) -> DataFrame:
    """Rows that occur more than once, with their count.

    With `by_hash`, one job shuffles a hash of each row and stages those that
    repeat; the exact grouping then sees just the rows with one of them, so whole
    rows are moved only where they may be duplicates. Without, the result is lazy.
    """
    columns = df.columns
    if not by_hash:
        return duplicate_keys(df, columns)
    hashed = df.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    repeated = stage(duplicate_keys(hashed, "_hash").select("_hash"))
    return duplicate_keys(hashed.join(repeated, "_hash", "left_semi"), columns)


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their count. Null is a value here."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count), most nulls first; one map-side aggregate."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _tall(row, df.columns, "null_count").orderBy(F.desc("null_count"), "column")


def _tall(row: DataFrame, columns, value: str) -> DataFrame:
    return row.unpivot([], [F.col(f"`{c}`") for c in columns], "column", value)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, value as text, n) for every distinct value of every column.

    Columns of one type are counted together, by their own values, and become
    text after that: each column is read once, and what is shuffled is as narrow
    as its type. Frequent values, null among them, are counted map-side first, so
    a value that fills a column costs one row per task.
    """
    by_type: dict[str, list] = {}
    for name, kind in df.dtypes:
        if columns is None or name in columns:
            value, kind = _countable(F.col(f"`{name}`"), kind)
            by_type.setdefault(kind, []).append(value.alias(name))
    counts = [_counts(df.select(*values)) for values in by_type.values()]
    return reduce(DataFrame.unionByName, counts)


def _countable(value, kind: str):
    """A value that groups as it compares, and the type it is counted under."""
    if kind in ("double", "float"):
        return value + F.lit(0.0).cast(kind), kind  # -0.0 and 0.0 are one value
    if kind in ("tinyint", "smallint", "int"):
        return value.cast("bigint"), "bigint"
    if kind.startswith(("array", "map", "struct", "binary", "variant")):
        return value.cast("string"), "string"
    return value, kind


def _counts(values: DataFrame) -> DataFrame:
    columns = [F.col(f"`{c}`") for c in values.columns]
    return (
        values.unpivot([], columns, "column", "value")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("value", F.col("value").cast("string"))
    )


def top_values(counts: DataFrame, k: int = 50) -> DataFrame:
    """The `k` most frequent values of each column; ties go by value.

    Values are ranked in `RANK_GROUPS` groups of a column first, of which only the
    first `k` can be among its first `k`: however many distinct values a column has,
    and whatever `k`, one task ranks at most `k` of each group. Null takes part in
    the rank and is then left out.
    """
    order = (F.desc("n"), F.asc_nulls_first("value"))
    group = F.pmod(F.xxhash64("value"), F.lit(RANK_GROUPS))
    for rank in (Window.partitionBy("column", group).orderBy(*order), Window.partitionBy("column").orderBy(*order)):
        counts = counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return counts.filter(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, unique_count, null_count); null counts as one value."""
    return _summarise(value_counts(df, columns))


def _summarise(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("*").alias("unique_count"),
    )


def value_ranges(df: DataFrame, columns=None) -> DataFrame:
    """(column, min_value, max_value) as text for numbers, dates and timestamps."""
    columns = columns or df.columns
    ranged = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, RANGED)]
    if not ranged:
        empty = "column string, min_value string, max_value string"
        return df.sparkSession.createDataFrame([], empty)
    bounds = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(f"`{c}`").cast("string").alias("min_value"),
            F.max(f"`{c}`").cast("string").alias("max_value"),
        )
        for c in ranged
    ]
    return df.agg(F.array(*bounds).alias("b")).select(F.inline("b"))


def profile(df: DataFrame, max_categories: int = 50, columns=None) -> DataFrame:
    """One row per column: nulls, distinct values, most frequent values, range.

    Each column is read twice: once to count its values, once for all ranges.
    Everything after that is at most `max_categories` rows a column.
    """
    counts = value_counts(df, columns)
    entry = F.struct("value", "n")
    # values that differ may read alike, as two instants of the hour a clock is set back
    readings = counts.groupBy("column", "value").agg(F.sum("n").alias("n"))
    frequent = (
        top_values(readings, max_categories)
        .groupBy("column")
        .agg(F.map_from_entries(F.collect_list(entry)).alias("value_counts"))
    )
    return (
        _summarise(counts)
        .join(frequent, "column", "left")
        .join(value_ranges(df, columns), "column", "left")
        .select("column", "null_count", "unique_count", "value_counts", "min_value", "max_value")
    )


# Types that the frequent-items sketch takes as they are; values of others are counted as text.
SKETCHED = ("bigint", "double", "float", "boolean", "date", "timestamp", "string")


def sketched_profile(
    df: DataFrame, max_categories: int = 50, columns=None, rsd: float = 0.02, tracked: int = 8192,
    exact_below: int = 100_000,
) -> DataFrame:
    """`profile` of wide tables with many distinct values, at the cost of one pass and what it names.

    One aggregate of mergeable sketches over all columns estimates distinct counts, with the
    relative standard deviation `rsd`, and names the frequent values of each. Columns with fewer than
    `exact_below` values, three deviations included, are then profiled exactly. Of the others no value is
    shuffled but the named ones: these are counted exactly in one more pass, `unique_count` is the
    estimate, and `exact` false. A value is surely named if it fills more than 4 / `tracked`
    (a power of two) of a column. Nulls and ranges are exact throughout. Runs the first pass at once; the driver
    sees twice `max_categories` values a column.
    """
    kinds = {name: kind for name, kind in df.dtypes if columns is None or name in columns}
    values = {name: _sketchable(F.col(f"`{name}`"), kind) for name, kind in kinds.items()}
    if not values:
        return profile(df, max_categories, []).withColumn("exact", F.lit(True))
    named = df.select(*[value.alias(f"_{i}") for i, value in enumerate(values.values())])
    k = 2 * max_categories
    sketches = [
        F.struct(
            F.approx_count_distinct(f"_{i}", rsd).alias("n"),
            F.count_if(F.col(f"_{i}").isNull()).alias("nulls"),
            F.expr(f"approx_top_k(_{i}, {min(k, tracked)}, {tracked})").alias("frequent"),
        ).alias(f"_{i}")
        for i in range(len(values))
    ]
    seen = dict(zip(values, named.agg(*sketches).first()))
    wide = [c for c in values if seen[c]["n"] * (1 + 3 * rsd) >= exact_below]
    parts, narrow = [], [c for c in values if c not in wide]
    if narrow:
        parts.append(profile(df, max_categories, narrow).withColumn("exact", F.lit(True)))
    if wide:
        parts.append(_profile_of_named(df, values, wide, seen, max_categories).withColumn("exact", F.lit(False)))
    return reduce(DataFrame.unionByName, parts)


def _sketchable(value, kind: str):
    value, kind = _countable(value, kind)
    return value if kind in SKETCHED else value.cast("string")


def _profile_of_named(df, values, wide, seen, max_categories: int) -> DataFrame:
    """Profile rows of columns whose frequent values and distinct counts a sketch has told."""
    entry = "array<struct<column string, value string>>"
    named = []
    for c in wide:
        items = [item["item"] for item in seen[c]["frequent"] or [] if item["item"] is not None]
        if items:
            here = F.struct(F.lit(c).alias("column"), values[c].cast("string").alias("value"))
            named.append(F.when(values[c].isin(items), here))
    found = F.array_compact(F.array(*named)) if named else F.array().cast(entry)
    counts = df.select(F.inline(found)).groupBy("column", "value").agg(F.count("*").alias("n"))
    frequent = (
        top_values(counts, max_categories)
        .groupBy("column")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("value_counts"))
    )
    # null counts as one value
    told = [(c, seen[c]["nulls"], seen[c]["n"] + (seen[c]["nulls"] > 0)) for c in wide]
    told = df.sparkSession.createDataFrame(told, "column string, null_count long, unique_count long")
    whole = told.join(frequent, "column", "left").join(value_ranges(df, wide), "column", "left")
    return whole.select("column", "null_count", "unique_count", "value_counts", "min_value", "max_value")


def sample_rows(
    df: DataFrame, fraction: float = 0.1, seed: int = 42, by_key=None, by_position: bool = False
) -> DataFrame:
    """Bernoulli sample of the rows.

    The plain form depends on how the input is split. With `by_key` the choice
    hangs on the key and seed alone: the same rows on every cluster and run. With `by_position`
    it hangs on the name of the file and the row's place in it, for Parquet files as they are read:
    the same rows however the files are split, equal rows drawn one by one.
    """
    if by_position:
        place = [F.element_at(F.split("_metadata.file_path", "/"), -1), F.col("_metadata.row_index").cast("string")]
        return df.filter(_drawn(place, fraction, seed))
    if by_key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    keys = [by_key] if isinstance(by_key, str) else list(by_key)
    return df.filter(_drawn([F.col(k).cast("string") for k in keys], fraction, seed))


def _drawn(parts, fraction: float, seed: int):
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(fraction * 2**32)
