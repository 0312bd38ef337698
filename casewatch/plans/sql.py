"""Ad-hoc read-only SQL over the feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What a query may consist of: reading tables and views, and computing on rows. Everything else, such
# as handing rows to a program (TRANSFORM), is refused because it is not in this list.
READING = {
    "LogicalRelation", "HiveTableRelation", "DataSourceV2Relation", "LocalRelation", "OneRowRelation", "Range", "View",
}
COMPUTING = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset",
    "Distinct", "Deduplicate", "Union", "Intersect", "Except", "SubqueryAlias", "Window", "Generate", "Expand", "Sample",
    "Pivot", "Unpivot", "WithCTE", "CTERelationDef", "CTERelationRef", "ResolvedHint", "Repartition",
    "RepartitionByExpression", "RebalancePartitions",
}
BUILT_IN = "org.apache.spark.sql.catalyst.expressions."
# Built in, yet they run code that the query names or that somebody registered.
FOREIGN = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF"}
WITH_PLAN = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}


class NotAllowed(ValueError):
    """The query does something other than to read tables and compute on their rows."""


def query_sql(
    spark: SparkSession, sql: str, max_results: int = 5, args: dict | None = None,
    database: str | None = None,
) -> DataFrame:
    """First `max_results` rows of a query over the registered tables and views.

    The text is placed inside a FROM clause, where Spark accepts a query and nothing else. The
    analysed plan, before any of it runs, must then hold only the nodes listed above and built-in
    functions: no methods of the driver by reflection, no registered functions, no programs, no files
    by path. What a registered view does is its owner's matter. Raises `NotAllowed` otherwise.
    """
    text = sql.strip().rstrip(";")
    before = spark.catalog.currentDatabase()
    on_files = spark.conf.get("spark.sql.runSQLOnFiles")
    try:
        if database:
            spark.catalog.setCurrentDatabase(database)
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        # names are resolved here, so the session can go back to its own database
        answer = spark.sql(f"SELECT * FROM (\n{text}\n) AS answer", args=args)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", on_files)
        if database:
            spark.catalog.setCurrentDatabase(before)
    _check_plan(answer._jdf.queryExecution().analyzed())
    return answer.limit(max_results)


def _each(found):
    return [found.apply(i) for i in range(found.size())]


def _check_plan(node) -> None:
    name = node.getClass().getSimpleName()
    if name not in READING and name not in COMPUTING:
        raise NotAllowed(f"a query may not contain {name}")
    if name == "View":
        return
    for expression in _each(node.expressions()):
        _check_expression(expression)
    for child in _each(node.children()):
        _check_plan(child)


def _check_expression(expression) -> None:
    kind = expression.getClass()
    name = kind.getSimpleName()
    unknown_plan = "Subquery" in name and name not in WITH_PLAN | {"InSubquery"}
    if not kind.getName().startswith(BUILT_IN) or name in FOREIGN or unknown_plan:
        raise NotAllowed(f"a query may not call {expression.prettyName()}")
    if name in WITH_PLAN:
        _check_plan(expression.plan())
    for child in _each(expression.children()):
        _check_expression(child)
