"""Stored reports: is there one of the day, and its text as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casewatch.functions import dates as D, text as X

REPORT_NAME = r"report_(\d{4}-\d{2}-\d{2})\.html$"
STORED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("report_on", T.DateType()),
        T.StructField("html", T.StringType()),
    ]
)


def stored_reports(spark: SparkSession, folder: str, name: str = REPORT_NAME) -> DataFrame:
    """(path, report_on, html) of the dated reports in a folder, one row a file."""
    files = spark.read.text(f"{folder}/*.html", wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.try_to_date(F.regexp_extract("_metadata.file_name", name, 1), "yyyy-MM-dd").alias("report_on"),
        F.col("value").alias("html"),
    )


def find_report(reports: DataFrame, as_of) -> DataFrame:
    """One row (exists, path, content, message) on the report of a day."""
    day = D.as_date(as_of)
    found = reports.filter(F.col("report_on") == day).select(
        "path", X.html_to_markdown("html").alias("content")
    )
    newest = found.agg(F.max("path").alias("path"), F.max_by("content", "path").alias("content"))
    exists, text = F.col("path").isNotNull(), day.cast("string")
    return newest.select(
        exists.alias("exists"),
        "path",
        "content",
        F.when(exists, F.concat(F.lit("Report of "), text, F.lit(" found, returned as Markdown.")))
        .otherwise(F.concat(F.lit("No report of "), text, F.lit(". Generate a new one.")))
        .alias("message"),
    )


def report_lookup(spark: SparkSession, folder: str, as_of, name: str = REPORT_NAME) -> DataFrame:
    """Look a day's report up in a folder; only that day's file is read."""
    return find_report(stored_reports(spark, folder, name), as_of)
