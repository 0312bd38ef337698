"""Delimited text, plain and zipped, under a schema contract."""

from __future__ import annotations

import csv
import io
import zipfile
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casewatch.contracts import CASE_DATE_FORMAT
from casewatch.session import stage

UNPARSED = "n_unparsed"

# --- Fixed values: texts that mean "no value" in the zipped bed inventory ------
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --- end of fixed values ---------------------------------------------------------


def read_delimited(
    spark: SparkSession, path, sep: str = ";", schema: T.StructType | None = None,
    date_format: str = CASE_DATE_FORMAT, encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header. Types are inferred unless a schema is given, which then
    binds by position; see `read_with_contract` for binding by name."""
    reader = spark.read.options(
        sep=sep, header=True, dateFormat=date_format, encoding=encoding
    )
    reader = reader.schema(schema) if schema is not None else reader.options(inferSchema=True)
    return reader.csv(path)


def read_with_contract(
    spark: SparkSession, path, schema: T.StructType, sep: str = ";",
    date_format: str = CASE_DATE_FORMAT, encoding: str = "UTF-8", audit: bool = False,
) -> DataFrame:
    """CSV read as text, bound to the contract by column name and then cast.

    Column order in a file does not matter, nor need all files have the same; files
    are read in groups of one header. A missing column is an error, and text that does
    not parse becomes null; with `audit` a column counts such cells per row instead of
    losing them silently.
    """
    options = {"sep": sep, "header": True, "encoding": encoding}
    parts = []
    for header, files in headers(spark, path, sep, encoding).items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        raw = spark.read.schema(text).options(**options, enforceSchema=False).csv(files)
        parts.append(apply_contract(raw, schema, date_format, audit))
    if not parts:
        raise ValueError(f"no file with a header: {path}")
    return reduce(DataFrame.unionByName, parts)


def headers(spark: SparkSession, path, sep: str = ";", encoding: str = "UTF-8") -> dict[tuple, list[str]]:
    """Files by the column names in their first line; one row per file comes to the driver.

    A file of any length gives up its first line only: the rest of its first split is read past.
    """
    lines = with_file(spark.read.options(**LINE_OPTIONS, encoding=encoding).schema("line string").csv(path))
    found: dict[tuple, list[str]] = {}
    for row in first_lines(lines).collect():
        found.setdefault(tuple(names_in(row["header"], sep)), []).append(row["file"])
    return {names: sorted(found[names]) for names in sorted(found)}


# A line is read as the only cell of its row.
LINE_OPTIONS = {"sep": "\u0000", "quote": "", "header": False}


def with_file(lines: DataFrame) -> DataFrame:
    """Lines with their file, and whether they are of its first split."""
    start = (F.col("_metadata.file_block_start") == 0).alias("first")
    return lines.select(F.col("_metadata.file_path").alias("file"), start, "line")


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line of each file, `header`; of `lines` only first splits are looked at."""
    return lines.filter("first").groupBy("file").agg(F.first("line").alias("header"))


def names_in(header: str, sep: str) -> list[str]:
    return next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))


def bind_lines(
    lines: DataFrame, schema: T.StructType, sep: str = ";", date_format: str = CASE_DATE_FORMAT
) -> DataFrame:
    """Lines of many files, from `with_file`, as rows of a contract, each file by its own header.

    All lines are read once, whatever the number of different headers; the driver sees those. A header that
    lacks a column is an error. Cells do not span lines; a line equal to its file's header is one.
    """
    headers = stage(first_lines(lines))  # a row per file: its size decides how it is joined
    rows = lines.join(headers, "file").filter(F.col("line") != F.col("header"))
    bound = None
    for header in sorted(r["header"] for r in headers.select("header").distinct().collect()):
        names = names_in(header, sep)
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"columns missing in the file: {missing}")
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        cells = F.from_csv("line", text.simpleString()[7:-1].replace(":", " "), {"sep": sep})
        typed = [_typed(cells[f"c{names.index(f.name)}"], f.dataType, date_format).alias(f.name) for f in schema.fields]
        here, row = F.col("header") == header, F.struct(*typed)
        bound = F.when(here, row) if bound is None else bound.when(here, row)
    if bound is None:
        return lines.sparkSession.createDataFrame([], schema)
    return rows.select(bound.alias("row")).select("row.*")


def apply_contract(
    raw: DataFrame, schema: T.StructType, date_format: str = CASE_DATE_FORMAT, audit: bool = False
) -> DataFrame:
    """Select the contract's columns of an all-text frame by name and cast them."""
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in the file: {missing}")
    typed = {f.name: _typed(F.col(f"`{f.name}`"), f.dataType, date_format) for f in schema.fields}
    columns = [column.alias(name) for name, column in typed.items()]
    if audit:
        lost = [
            (F.col(f"`{name}`").isNotNull() & column.isNull()).cast("int")
            for name, column in typed.items()
        ]
        columns.append(sum(lost[1:], lost[0]).alias(UNPARSED))
    return raw.select(*columns)


def _typed(column, data_type, date_format):
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, T.DateType):
        return F.try_to_date(F.trim(column), date_format)
    return F.trim(column).try_cast(data_type)


def _first_member(content: bytes, names, sep: str, encoding: str, strict: bool):
    """Named cells of each fitting line of an archive's first file, streamed."""
    csv.field_size_limit(2**31 - 1)
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = [m for m in archive.namelist() if not m.endswith("/")]
        if strict and len(members) != 1:
            raise ValueError(f"an archive holds one data file, not {members}")
        with archive.open(members[0]) as member:
            lines = csv.reader(io.TextIOWrapper(member, encoding, newline=""), delimiter=sep)
            header = next(lines)
            at = [header.index(n) for n in names]
            for cells in lines:
                if strict and len(cells) > len(header):
                    raise ValueError(f"line {lines.line_num} has {len(cells)} cells under {len(header)} names")
                if 0 < len(cells) <= len(header):
                    cells += [""] * (len(header) - len(cells))
                    yield [None if cells[i] in NULL_TEXTS else cells[i] for i in at]


def read_zipped_csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    """Rows of zip archives at a path; options as for `unzipped`."""
    return unzipped(spark.read.format("binaryFile").load(path), schema, **options)


def unzipped(
    archives: DataFrame, schema: T.StructType, sep: str = ";", encoding: str = "latin-1",
    date_format: str = CASE_DATE_FORMAT, partitions: int | None = None, batch_rows: int = 50_000,
    strict: bool = False,
) -> DataFrame:
    """The first file of each zip archive in the column `content` as rows of the contract.

    A zip has no entry points, so one task unpacks an archive, streaming it in
    batches of `batch_rows`; `partitions` then spreads the rows for the work that
    follows. Lines with more cells than the header are left out, shorter ones are
    filled with null. With `strict`, such a longer line fails the job, and so does an
    archive with more than one file: nothing is passed over in silence.
    """
    names = schema.fieldNames()
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def unpack(batches):
        import pyarrow as pa

        text = pa.schema([(n, pa.string()) for n in names])
        for batch in batches:
            for content in batch.column("content"):
                rows = _first_member(content.as_py(), names, sep, encoding, strict)
                while chunk := list(islice(rows, batch_rows)):
                    columns = [pa.array(c, pa.string()) for c in zip(*chunk)]
                    yield pa.RecordBatch.from_arrays(columns, schema=text)

    rows = archives.select("content").mapInArrow(unpack, text_schema)
    if partitions:
        rows = rows.repartition(partitions)
    return apply_contract(rows, schema, date_format)
