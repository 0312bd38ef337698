"""Duplicates, nulls, profiles and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewatch.operators import quality as Q
from casewatch.plans.fixtures import load
from casewatch.plans.registry import query

EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def per_column(columns, template, table):
    """The same SELECT for each column, one after the other."""
    return " union all ".join(template.format(c=c, t=table) for c in columns)


@query("""select l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, count(*) as n
from lineitem group by 1, 2, 3, 4, 5 having count(*) > 1""")
def duplicate_rows(spark, sf_dir):
    """Repeated rows of a narrow table."""
    columns = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
    return Q.duplicate_rows(load(spark, sf_dir, "lineitem").select(*columns))


@query("""select text, lang, count(*) as n from documents group by 1, 2 having count(*) > 1""")
def duplicate_rows_by_hash(spark, sf_dir):
    """Repeated rows of a table of long texts."""
    return Q.duplicate_rows(load(spark, sf_dir, "documents").select("text", "lang"), by_hash=True)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Repeated keys."""
    return Q.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


NULLED = "(select *, nullif(event_type, 'error') as kind, case when value > 0 then value end as positive from events)"


def nulled_events(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr(
        "*", "nullif(event_type, 'error') as kind", "case when value > 0 then value end as positive"
    )


@query(per_column(EVENTS + ["kind", "positive"], "select '{c}' as \"column\", count(*) - count({c}) as null_count from {t}", NULLED))
def null_counts(spark, sf_dir):
    """Nulls per column."""
    return Q.null_counts(nulled_events(spark, sf_dir))


@query("select count(*) as n_rows from lineitem")
def row_count(spark, sf_dir):
    """Rows of a table."""
    return Q.row_count(load(spark, sf_dir, "lineitem"))


@query(per_column(
    EVENTS + ["kind", "positive"],
    "select '{c}' as \"column\", count(*) - count({c}) as null_count, "
    "count(distinct {c}) + case when count(*) > count({c}) then 1 else 0 end as unique_count from {t}",
    NULLED,
))
def distinct_counts(spark, sf_dir):
    """Distinct values per column, null as one of them."""
    return Q.distinct_counts(nulled_events(spark, sf_dir))


@query(per_column(
    ["event_type", "kind", "user_id", "value"],
    "select '{c}' as \"column\", value, n, cast(rank as int) as rank from (select cast({c} as varchar) as value, "
    "count(*) as n, row_number() over (order by count(*) desc, cast({c} as varchar) nulls first) as rank "
    "from {t} group by 1) where rank <= 50 and value is not null",
    NULLED,
))
def top_values(spark, sf_dir):
    """The fifty most frequent values of each column."""
    columns = ["event_type", "kind", "user_id", "value"]
    return Q.top_values(Q.value_counts(nulled_events(spark, sf_dir), columns))


@query(per_column(
    ["event_id", "ts", "user_id", "value"],
    "select '{c}' as \"column\", cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from {t}",
    "events",
))
def value_ranges(spark, sf_dir):
    """Range of each number and timestamp."""
    return Q.value_ranges(load(spark, sf_dir, "events"))


@query(per_column(
    CUSTOMER,
    "select '{c}' as \"column\", count(*) - count({c}) as null_count, count(distinct {c}) as unique_count, "
    "least(count(distinct {c}), 50) as n_values, "
    "(select cast(sum(n) as bigint) from (select count(*) as n from {t} group by {c} order by n desc limit 50)) as n_rows_in_values, "
    "case when typeof(min({c})) <> 'VARCHAR' then cast(min({c}) as varchar) end as min_value, "
    "case when typeof(min({c})) <> 'VARCHAR' then cast(max({c}) as varchar) end as max_value from {t}",
    "customer",
))
def profile(spark, sf_dir):
    """Profile of every column; the value map is shown by its size and total."""
    return Q.profile(load(spark, sf_dir, "customer")).selectExpr(
        "column", "null_count", "unique_count",
        "cast(size(value_counts) as bigint) as n_values",
        "aggregate(map_values(value_counts), 0L, (a, x) -> a + x) as n_rows_in_values",
        "min_value", "max_value",
    )


@query(per_column(
    CUSTOMER,
    "select '{c}' as \"column\", count(distinct {c}) < 100 as exact, count(*) - count({c}) as null_count, "
    "case when count(distinct {c}) < 100 then count(distinct {c}) end as unique_count, "
    "case when count(distinct {c}) < 100 then count({c})::bigint end as n_rows_in_values, "
    "case when typeof(min({c})) <> 'VARCHAR' then cast(min({c}) as varchar) end as min_value, "
    "case when typeof(min({c})) <> 'VARCHAR' then cast(max({c}) as varchar) end as max_value from {t}",
    "customer",
))
def sketched_profile(spark, sf_dir):
    """Profile by sketches: columns of a hundred values and more are estimated, the others exact."""
    told = Q.sketched_profile(load(spark, sf_dir, "customer"), max_categories=100, exact_below=100)
    rows = "aggregate(map_values(value_counts), 0L, (a, x) -> a + x)"
    return told.selectExpr(
        "column", "exact", "null_count",
        "case when exact then unique_count end as unique_count",
        f"case when exact then {rows} end as n_rows_in_values",
        "min_value", "max_value",
    )


@query("""select o_orderkey, o_totalprice from orders
where cast('0x' || substr(md5('42|' || o_orderkey), 1, 8) as bigint) < 429496729""")
def sample_by_key(spark, sf_dir):
    """A tenth of the rows, chosen by key."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return Q.sample_rows(orders, 0.1, seed=42, by_key="o_orderkey")


@query("select true as all_known, true as none_twice, true as about_a_tenth")
def sample_rows(spark, sf_dir):
    """What a sample by position must be: some of the rows, each once, about a tenth."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sample = Q.sample_rows(orders, 0.1)
    marks = orders.select("*", F.lit(0).alias("s")).unionByName(sample.select("*", F.lit(1).alias("s")))
    per_row = marks.groupBy("o_orderkey", "o_totalprice").agg(F.sum("s").alias("s"), F.count_if(F.col("s") == 0).alias("n"))
    n, kept = F.sum("n"), F.sum("s")
    return per_row.agg(
        F.coalesce(F.bool_and((F.col("s") == 0) | (F.col("n") > 0)), F.lit(True)).alias("all_known"),
        F.coalesce(F.bool_and(F.col("s") <= F.col("n")), F.lit(True)).alias("none_twice"),
        (F.abs(kept - 0.1 * n) <= 5 * F.sqrt(0.09 * n) + 1).alias("about_a_tenth"),
    )


@query("""with twice as (select * from lineitem union all select * from lineitem where l_orderkey % 7 = 0)
select *, count(*) as n from twice group by all having count(*) > 1""")
def duplicate_whole_rows(spark, sf_dir):
    """Repeated rows, all columns compared, of a table a part of which is there twice."""
    lines = load(spark, sf_dir, "lineitem")
    return Q.duplicate_rows(lines.unionByName(lines.where("l_orderkey % 7 = 0")))
