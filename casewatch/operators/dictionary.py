"""Data-dictionary tables: continuation rows, known columns, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casewatch.functions import text as X
from casewatch.operators import filters as P


def stitch_rows(
    df: DataFrame, doc: str, pos: str, key: str, columns, chunk: int = 10_000
) -> DataFrame:
    """Join continuation rows (blank key) onto the row they continue.

    Every row after a keyed one and before the next belongs to it; the cells of
    each other column are joined by a blank in `pos` order, nulls left out; a cell
    without any is null. Rows before the first key of a document belong to nothing
    and drop.

    A document may be most of the table, so no task sees a whole one: rows are
    first stitched inside chunks of `chunk` positions, then each chunk that
    opens with a continuation is given the last key position before it, found
    from one row per chunk, and the pieces of a row are put together.
    """
    columns = list(columns)
    has_key = F.trim(F.coalesce(F.col(key), F.lit(""))) != ""
    chunk_of = F.expr(f"`{pos}` div {int(chunk)}")
    in_chunk = Window.partitionBy(doc, "_chunk").orderBy(pos)
    rows = df.select(
        doc, pos, key, *columns,
        chunk_of.alias("_chunk"), has_key.alias("_head"),
    ).withColumn("_part", F.sum(F.col("_head").cast("int")).over(in_chunk))

    def joined(items, name):
        """The known cells in order; null if none is known, so that pieces leave no trace of where they were cut."""
        cells = F.array_compact(F.transform(F.array_sort(items), lambda x: x[name]))
        return F.when(F.size(cells) > 0, F.array_join(cells, " "))

    pieces = rows.groupBy(doc, "_chunk", "_part").agg(
        F.min(F.when(F.col("_head"), F.col(pos))).alias("_start"),
        F.max(F.when(F.col("_head"), F.col(key))).alias(key),
        *[joined(F.collect_list(F.struct(F.col(pos), F.col(c).alias(c))), c).alias(c) for c in columns],
    )
    before = Window.partitionBy(doc).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        df.select(doc, chunk_of.alias("_chunk"), F.when(has_key, F.col(pos)).alias("_p"))
        .groupBy(doc, "_chunk")
        .agg(F.max("_p").alias("_last"))
        .withColumn("_carried", F.max("_last").over(before))
        .select(doc, "_chunk", "_carried")
    )
    placed = pieces.join(heads, [doc, "_chunk"], "left").withColumn(
        "_start", F.coalesce("_start", "_carried")
    )
    return (
        placed.filter(F.col("_start").isNotNull())
        .groupBy(doc, F.col("_start").alias(pos))
        .agg(
            F.max(key).alias(key),
            *[joined(F.collect_list(F.struct(F.col("_chunk"), F.col(c).alias(c))), c).alias(c) for c in columns],
        )
    )


def column_dictionary(
    dictionary: DataFrame, columns, code: str, description: str, extra: DataFrame | None = None
) -> DataFrame:
    """(column, description) of the known columns, plus hand-written ones.

    `columns` is a list of names or a one-column DataFrame of them.
    """
    known = P.with_codes(dictionary, code, columns).select(
        F.col(code).alias("column"),
        X.collapse_newlines(F.col(description)).alias("description"),
    )
    return known if extra is None else known.unionByName(extra)


def missing_descriptions(columns: DataFrame, dictionary: DataFrame, code: str) -> DataFrame:
    """Names in the one-column `columns` that the dictionary does not cover."""
    names = columns.toDF("column").distinct()
    return names.join(dictionary.select(F.col(code).alias("column")), "column", "left_anti")
