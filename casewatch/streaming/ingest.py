"""Incremental ingest: merge every file not seen yet into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from casewatch.session import shared_dir
from casewatch.sources.delimited import CASE_DATE_FORMAT, LINE_OPTIONS, apply_contract, with_file
from casewatch.sources.tables import upsert_table


def stream_delimited(
    spark: SparkSession, folder: str, columns, schema: T.StructType, sep: str = ";",
    encoding: str = "UTF-8", date_format: str = CASE_DATE_FORMAT,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of the CSV files of a folder under a contract.

    `columns` are the header names in file order, the same in all files; for
    files of any order see `stream_lines`.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(text).options(
        sep=sep, header=True, encoding=encoding, enforceSchema=False
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return apply_contract(reader.csv(folder), schema, date_format)


def stream_lines(
    spark: SparkSession, folder: str, encoding: str = "UTF-8", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of the lines of a folder's files, for `bind_lines` as `bind` of `incremental_ingest`.

    Every batch then binds its files by their own headers, so columns may stand in any order and a
    file may have more of them.
    """
    reader = spark.readStream.schema("line string").options(**LINE_OPTIONS, encoding=encoding)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_file(reader.csv(folder))


def incremental_ingest(
    stream: DataFrame, table: str, keys, order_by=(), partition_by=(),
    checkpoint: str | None = None, after_batch=None, bind=None,
) -> None:
    """Merge what is new in the stream into `table`, then stop.

    The checkpoint remembers the files taken. A batch that failed is taken again,
    and merging it twice changes nothing, so a lost executor or driver leaves no
    gap and no duplicates. `bind(batch)`, if given, makes the rows to merge of a batch;
    `after_batch(batch, id)` runs once a batch is in.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{shared_dir(spark)}/streams/{table}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_table(bind(batch) if bind else batch, table, keys, order_by, partition_by=partition_by)
        if after_batch:
            after_batch(batch, batch_id)

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark.catalog.refreshTable(table)
