"""Catalog tables: read, write, union of yearly frames, keyed writes."""

from __future__ import annotations

import re
import uuid
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casewatch.operators.upsert import keep_latest, merge
from casewatch.session import drop_folder, shared_dir, stage, staging_folder, tables_dir

# Set on a table that is a complete replacement and only lacks its name.
REPLACES = "casewatch.replaces"
SPECS_PER_STATEMENT = 200
# Characters that partition paths write as their code.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """A handful of rows, possibly none, as a typed DataFrame."""
    return spark.createDataFrame(rows, schema)


def schema_diff(left: T.StructType, right: T.StructType) -> dict[str, list[str]]:
    """Column names only in the one, only in the other, in both, and those in
    both with different types."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (left, right))
    return {
        "only_left": sorted(set(a) - set(b)),
        "only_right": sorted(set(b) - set(a)),
        "common": sorted(set(a) & set(b)),
        "retyped": sorted(c for c in set(a) & set(b) if a[c] != b[c]),
    }


def union_years(frames, allow_missing: bool = False) -> DataFrame:
    """All rows of the yearly frames, columns matched by name.

    A frame that lacks columns, adds some or changes a type is an error, unless
    `allow_missing`, where absent columns become null.
    """
    frames = list(frames)
    for frame in frames[1:]:
        diff = schema_diff(frames[0].schema, frame.schema)
        drifted = diff["retyped"] or (diff["only_left"] or diff["only_right"]) and not allow_missing
        if drifted:
            raise ValueError(f"frames disagree: {diff}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_table(
    df: DataFrame, name: str, mode: str = "overwrite", merge_schema: bool = False,
    partition_by=(), bucket_by: tuple[int, list[str]] | None = None,
) -> None:
    """Write a catalog table under the root of permanent tables.

    An overwrite goes to a new folder which the table then points to, so the
    table may be among the inputs of `df` and a failed write leaves it whole.
    `merge_schema` keeps columns the table has and `df` lacks, as null.
    `bucket_by` (count, columns) lays the table out by key, so that a keyed merge
    moves only the new rows. A table keeps its layout when none is given.
    """
    spark = df.sparkSession
    _finish_replacement(spark, name)
    exists = table_exists(spark, name)
    if exists and not partition_by and not bucket_by:
        partition_by, bucket_by = table_layout(spark, name)
    if merge_schema and exists:
        empty = read_table(spark, name).limit(0)
        df = empty.unionByName(df, allowMissingColumns=True)
    if bucket_by:
        df = df.repartition(bucket_by[0], *bucket_by[1])
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if mode == "append" and exists:
        _writer(df, partition_by, bucket_by).mode("append").saveAsTable(name)
    else:
        keeps_layout = exists and not partition_by and table_layout(spark, name) == ([], bucket_by)
        in_place = keeps_layout and _same_columns(spark, name, df)
        _replace(df, name, partition_by, bucket_by, in_place)


def _writer(df: DataFrame, partition_by, bucket_by):
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    return writer


def _write_beside(df: DataFrame, name: str, partition_by, bucket_by) -> tuple[str, str]:
    """Write a table next to `name`, of this run alone; returns its name and folder."""
    location = _next_location(df.sparkSession, name)
    staged = f"{name}_staged_{uuid.uuid4().hex}"
    _writer(df, partition_by, bucket_by).option("path", location).saveAsTable(staged)
    return staged, location


def _replace(df: DataFrame, name: str, partition_by, bucket_by, in_place: bool) -> None:
    """Let a newly written table take the name; `in_place` is one catalog change."""
    spark = df.sparkSession
    staged, location = _write_beside(df, name, partition_by, bucket_by)
    if in_place:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.sql(f"DROP TABLE {staged}")
    else:
        exists = table_exists(spark, name)
        if exists:  # the mark tells a stopped replacement from other leftovers
            spark.sql(f"ALTER TABLE {staged} SET TBLPROPERTIES ('{REPLACES}' = '{name}')")
            spark.sql(f"DROP TABLE {name}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        if exists:
            spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ('{REPLACES}')")


def _finish_replacement(spark: SparkSession, name: str) -> None:
    """Complete a replacement that stopped between its catalog changes.

    Only a table that says so takes the name: any other leftover may be a part of the rows,
    or of a table that was dropped on purpose.
    """
    if table_exists(spark, name):
        return
    database, _, bare = name.rpartition(".")
    listed = spark.sql("SHOW TABLES" + (f" IN {database}" if database else "") + f" LIKE '{bare}_staged_*'")
    for row in listed.collect():
        staged = f"{database}.{row.tableName}" if database else row.tableName
        marks = spark.sql(f"SHOW TBLPROPERTIES {staged}").filter(F.col("key") == REPLACES).collect()
        if any(m["value"] == name for m in marks):
            spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
            spark.sql(f"ALTER TABLE {name} UNSET TBLPROPERTIES IF EXISTS ('{REPLACES}')")
            return


def vacuum(spark: SparkSession, name: str, keep: int = 1) -> list[str]:
    """Remove superseded folders of a table; returns them.

    Each write makes a folder named by its time. Those that the table's location or any of its files
    lies in are live and stay, whatever their age, and so do the newest `keep` others
    for readers that are still at work. Writers of the table must be at rest.
    """
    root = f"{tables_dir(spark)}/{name}.versions"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    folders = sorted(f.getPath().getName() for f in fs.listStatus(path))
    version = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(name)}\.versions/([^/]+)/", 1)
    live = {r[0] for r in read_table(spark, name).select(version).distinct().collect()}
    described = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first()
    live |= {f for f in folders if f"/{f}" in described.data_type}
    gone = [f for f in folders if f not in live]
    gone = gone[: max(0, len(gone) - keep)]
    for folder in gone:
        drop_folder(spark, f"{root}/{folder}", root)
    return gone


def table_layout(spark: SparkSession, name: str):
    """Partition columns and (bucket count, bucket columns) of a table."""
    columns = spark.catalog.listColumns(name)
    parts = [c.name for c in columns if c.isPartition]
    buckets = [c.name for c in columns if c.isBucket]
    if not buckets:
        return parts, None
    described = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'")
    return parts, (int(described.first().data_type), buckets)


def _same_columns(spark, name, df) -> bool:
    return [(f.name, f.dataType) for f in read_table(spark, name).schema] == [
        (f.name, f.dataType) for f in df.schema
    ]


def _next_location(spark: SparkSession, name: str) -> str:
    return f"{tables_dir(spark)}/{name}.versions/{datetime.now():%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"


class KeyViolation(ValueError):
    """A primary key is null or occurs twice."""


def check_primary_key(df: DataFrame, keys) -> None:
    """Raise unless the key is present and unique; one job, no rows collected."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    found = (
        df.select(*keys, missing.alias("_missing"))
        .groupBy(*keys, "_missing")
        .agg(F.count("*").alias("n"))
        .agg(
            F.sum(F.when(F.col("_missing"), F.col("n")).otherwise(0)).alias("nulls"),
            F.count_if((F.col("n") > 1) & ~F.col("_missing")).alias("repeated"),
        )
        .first()
    )
    if found.nulls or found.repeated:
        raise KeyViolation(f"{found.nulls or 0} rows without {keys}, {found.repeated} repeated keys")


def write_feature_table(df: DataFrame, name: str, primary_key, partition_by=()) -> None:
    """Create the table or merge into it, by a checked primary key."""
    keys = [primary_key] if isinstance(primary_key, str) else list(primary_key)
    folder = staging_folder(df.sparkSession)
    rows = stage(df, folder)
    check_primary_key(rows, keys)
    _merge_staged(rows, name, keys, partition_by)
    drop_folder(df.sparkSession, folder, shared_dir(df.sparkSession))


def upsert_table(
    source: DataFrame, name: str, keys, order_by=(), on_duplicate: str = "latest",
    partition_by=(), before=None,
) -> None:
    """Merge a batch into a catalog table by key; creates the table if absent.

    The batch is reduced to one row per key and staged first: it is then read
    several times without being computed again, and its size is known when Spark
    chooses the joins. A partitioned table rewrites only the partitions the batch
    touches: those it writes to and those that hold an older version of one of its
    keys. A rerun after a failure gives the same table. `before(rows)` is called with the
    staged batch, one row per key, ahead of the merge.
    """
    keys = list(keys)
    folder = staging_folder(source.sparkSession)
    newer = stage(keep_latest(source, keys, order_by, on_duplicate), folder)
    if before:
        before(newer)
    _merge_staged(newer, name, keys, partition_by)
    drop_folder(source.sparkSession, folder, shared_dir(source.sparkSession))


def _merge_staged(newer: DataFrame, name: str, keys, partition_by) -> None:
    """Merge staged rows with distinct keys the way the table is laid out."""
    spark = newer.sparkSession
    _finish_replacement(spark, name)
    if not table_exists(spark, name):
        write_table(newer, name, partition_by=partition_by)
        return
    parts, buckets = table_layout(spark, name)
    target = read_table(spark, name)
    newer = newer.select(*target.columns)
    if parts:
        _upsert_partitions(newer, target, name, keys, parts)
    elif buckets:
        # the kept rows stay in the bucket they are read from; only new ones move
        moved = newer.repartition(buckets[0], *buckets[1])
        _replace(merge(target, moved, keys), name, (), buckets, in_place=True)
    else:
        write_table(merge(target, newer, keys), name)


def _upsert_partitions(newer, target, name, keys, parts):
    """Write the affected partitions anew and point the table at them, one by one.

    No file of the table is touched before that, and every row that moves between
    partitions is one of the batch, so a rerun completes what a lost driver left.
    """
    spark = newer.sparkSession
    # an empty text names no partition; such rows are kept in that of null
    texts = [p for p in parts if dict(newer.dtypes)[p] == "string"]
    newer = newer.withColumns({p: F.nullif(F.col(p), F.lit("")) for p in texts})
    # Only lists of partition values come to the driver, as long as the table
    # has partitions; the catalog holds the same list there.
    holding = _partition_values(target.join(newer.select(*keys), keys, "left_semi"), parts)
    affected = holding | _partition_values(newer, parts)
    if not affected:
        return
    merged = merge(target.filter(in_partitions(parts, affected)), newer, keys)
    rebalanced = merged.select(*target.columns).hint("rebalance", *parts)
    staged, _ = _write_beside(rebalanced, name, parts, None)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("_folder")
    written = read_table(spark, staged).select(*parts, folder).distinct().collect()
    filled = {tuple(r)[:-1]: r["_folder"] for r in written}

    def spec(values):
        return "PARTITION (" + ", ".join(f"{p} = {_literal(v)}" for p, v in zip(parts, values)) + ")"

    # New partitions come with their folder and empty ones go, many in a statement. One that
    # the table has is pointed elsewhere in a statement of its own, which never loses it.
    there = set(filled) & _known_partitions(spark, name, parts, affected)
    for batch in _batches([v for v in filled if v not in there]):
        added = " ".join(f"{spec(v)} LOCATION {_literal(unquote(filled[v]))}" for v in batch)
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {added}")
    for values in there:
        spark.sql(f"ALTER TABLE {name} {spec(values)} SET LOCATION {_literal(unquote(filled[values]))}")
    for batch in _batches([v for v in affected if v not in filled]):  # all their rows moved to others
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(spec(v) for v in batch))
    spark.sql(f"DROP TABLE {staged}")
    spark.catalog.refreshTable(name)


def _partition_values(df: DataFrame, parts) -> set[tuple]:
    return {tuple(r) for r in df.select(*parts).distinct().collect()}


def _batches(items: list) -> list[list]:
    return [items[i : i + SPECS_PER_STATEMENT] for i in range(0, len(items), SPECS_PER_STATEMENT)]


def _known_partitions(spark, name: str, parts, affected) -> set[tuple]:
    """Which of the partitions the table has, as the catalog lists them."""
    listed = {r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}

    def named(values):
        return "/".join(f"{p}={_path_name(v)}" for p, v in zip(parts, values))

    return {v for v in affected if named(v) in listed}


def _path_name(value) -> str:
    """A partition value as the catalog writes it in paths."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 0x20 or ord(c) == 0x7F else c for c in text)


def in_partitions(parts, affected):
    """Predicate on partition columns alone, so that the scan prunes by it.

    Joined as a balanced tree: it stays shallow however many partitions there are.
    """
    tests = [
        reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, values)])
        for values in affected
    ]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


_in_partitions = in_partitions  # its name before other modules called it


def _literal(value) -> str:
    if value is None:
        return "null"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
