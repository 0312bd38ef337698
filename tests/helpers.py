"""Small tables and comparison for the tests."""

from datetime import date

CASES = (
    "case_id bigint, notified_on date, state string, outcome int, outcome_on date, age_value int, "
    "age_unit int, icu_in date, icu_out date, vac_covid int, vac_flu int"
)


def day(text):
    return text and date.fromisoformat(text)


def cases(spark, rows):
    """Cases from dicts; absent columns are null, keys count up."""
    names = [c.split()[0] for c in CASES.split(", ")]
    dates = {"notified_on", "outcome_on", "icu_in", "icu_out"}
    filled = []
    for i, row in enumerate(rows):
        row = {"case_id": i, **row}
        filled.append(tuple(day(row.get(n)) if n in dates else row.get(n) for n in names))
    return spark.createDataFrame(filled, CASES)


def rows(df):
    """Rows as plain tuples, in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((c is None, str(c)) for c in r))


def plan(df):
    """Physical plan after it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def first_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table):
    """How many scans of a table a plan runs, after it has run; what is reused counts once."""
    df.collect()
    found, seen = [], set()

    def visit(node):
        name = node.getClass().getSimpleName()
        if name.startswith("Reused"):
            return
        if name == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return visit(node.plan())
        if name in ("FileSourceScanExec", "BatchScanExec") and table in node.toString():
            found.append(node.toString())
        if name == "SubqueryExec":
            if node.id() in seen:
                return
            seen.add(node.id())
        for children in (node.children(), node.subqueries()):
            for i in range(children.size()):
                visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return len(found)
