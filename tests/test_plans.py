"""Shape of the physical plans: what is scanned, shuffled and kept out."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from casewatch.plans.registry import QUERIES
from casewatch.operators import counts as N, filters as P, quality as Q, stays as S, upsert as U
from casewatch.sources import tables as B
from casewatch.plans import report as Rep
from casewatch.plans.sql import NotAllowed, query_sql
from tests.helpers import cases, first_plan, plan, rows, scans

SF_DIR = "/root/testdata/sf0.001"
AS_OF = "2025-06-30"
# Queries that write tables on the way, and the one that unpacks archives.
EAGER = {
    "feature_table", "incremental_ingest_table", "write_table_evolved", "stream_delimited_table", "read_zipped_beds",
    "stream_files_of_other_orders", "features_of_changed_cases", "sketched_profile",
}
LAZY = [n for n in QUERIES if n not in EAGER]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Case table on disk with real DATE columns."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    folder = str(tmp_path_factory.mktemp("cases"))
    data = [
        {"notified_on": f"2025-0{1 + i % 6}-1{i % 9}", "state": "SP", "icu_in": "2025-03-01", "icu_out": "2025-03-09"}
        for i in range(60)
    ]
    cases(spark, data).withColumn("month", F.date_format("notified_on", "yyyy-MM")).write.partitionBy(
        "month"
    ).mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def pushed(text):
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\]", text))


def columns_read(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", text)]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_in_any_query(spark, name):
    text = first_plan(entry.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in text


def test_period_filters_reach_the_scan(spark, stored):
    text = first_plan(N.cases_per_month(stored, "2025-06-30"))
    assert "GreaterThanOrEqual(notified_on,2024-06-30)" in pushed(text)
    assert "LessThanOrEqual(notified_on,2025-06-30)" in pushed(text)
    assert columns_read(text) == [{"notified_on"}]
    month = first_plan(P.in_month(stored, "notified_on", "2025-03").select("case_id"))
    assert "GreaterThanOrEqual(notified_on,2025-03-01), LessThan(notified_on,2025-04-01)" in pushed(month)


def test_overlap_filter_reaches_the_scan_and_joins_by_key(spark, stored):
    text = first_plan(S.overlap_count(stored, "2025-01-01", AS_OF))
    assert "GreaterThanOrEqual(icu_in,2025-01-01)" in pushed(text)
    assert {"icu_in", "icu_out"} in columns_read(text)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_latest_date_is_computed_once_and_used_in_the_scan(spark, stored):
    text = plan(N.cases_per_day(stored))
    scan = [line for line in text.split("\n") if "FileScan" in line and "Subquery" in line]
    assert scan and "ReusedSubquery" in text


def test_default_day_window_scans_one_column(spark, stored):
    assert all(c <= {"notified_on"} for c in columns_read(plan(N.cases_per_day(stored))))


def test_pivot_takes_one_shuffle(spark, stored):
    from casewatch.operators.features import with_case_features

    assert first_plan(S.pivot_bed_class(with_case_features(stored))).count("Exchange hashpartitioning") == 1


def test_top_values_ranks_before_the_shuffle(spark, stored):
    assert "WindowGroupLimit" in first_plan(Q.top_values(Q.value_counts(stored)))


def test_profile_counts_values_once(spark, stored):
    """One count per column type, shared by the summary and the frequent values."""
    text = plan(Q.profile(stored)).split("Initial Plan")[0]
    kinds = {"int": "bigint"}
    types = {kinds.get(kind, kind) for _, kind in stored.dtypes}
    assert text.count("ReusedExchange") >= len(types)


def test_counts_aggregate_before_the_shuffle(spark, stored):
    for df in (N.cases_per_state(stored), Q.duplicate_keys(stored, "state"), Q.value_counts(stored)):
        assert "partial_count" in first_plan(df)


def test_null_counts_need_no_hash_shuffle(spark, stored):
    assert "hashpartitioning" not in first_plan(Q.null_counts(stored))


def test_merge_into_buckets_leaves_the_table_in_place(spark):
    name = f"b_{uuid.uuid4().hex[:10]}"
    B.write_table(spark.range(1000).selectExpr("id as k", "id as v"), name, bucket_by=(4, ["k"]))
    target = B.read_table(spark, name)
    newer = spark.range(500, 1500).selectExpr("id as k", "0L as v").repartition(4, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = first_plan(U.merge(target, newer, ["k"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = text.split("LeftAnti")[1].split("Union")[0]
    scan = kept.split("FileScan parquet")[0]
    assert "Bucketed: true" in text and "Exchange" not in scan.split("\n:")[0]


def test_merge_rewrites_only_affected_partitions(spark):
    name = f"p_{uuid.uuid4().hex[:10]}"
    B.write_table(spark.range(100).selectExpr("id as k", "id % 5 as p"), name, partition_by=["p"])
    target = B.read_table(spark, name)
    text = first_plan(target.filter(B._in_partitions(["p"], {(1,), (3,)})))
    assert "PartitionFilters: [((p" in text or "PartitionFilters: [(p" in text


def test_hot_key_is_one_row_per_task_before_the_shuffle(spark):
    """A third of the batch has one key; it shrinks map-side and merges right."""
    source = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id) as k", "id as t")
    target = spark.range(100).selectExpr("id as k", "-1L as t")
    merged = U.upsert(target, source, ["k"], ["t"])
    assert "partial_max" in first_plan(merged)
    got = merged.filter("k = -1").collect()
    assert [(r.k, r.t) for r in got] == [(-1, 29_997)]
    assert merged.count() == 20_001 + target.filter("k % 3 = 0").count()


def test_repeated_hashes_are_staged_and_rows_stay_in_place(spark, tmp_path):
    spark.range(5000).selectExpr("id % 4990 as a", "repeat('x', 50) as b").write.parquet(str(tmp_path / "t"))
    text = first_plan(Q.duplicate_rows(spark.read.parquet(str(tmp_path / "t")), by_hash=True))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_month_partitions_are_pruned_by_every_period(spark, tmp_path):
    from casewatch.contracts import CASES
    from casewatch.operators import vaccination as V
    from casewatch.operators.features import case_features

    s = CASES.with_names(month="month")
    data = [{"notified_on": f"2025-{m:02d}-{d:02d}", "state": "SP"} for m in range(1, 9) for d in (1, 15)] + [{}]
    case_features(cases(spark, data), s).write.partitionBy("month").parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    month = __import__("datetime").date(2025, 3, 31)
    for build in (
        lambda z: N.cases_per_month(df, month, start="2025-02-10", s=z),
        lambda z: N.cases_per_day(df, s=z),
        lambda z: N.variation_rate(df, month, z),
        lambda z: V.vaccination_rate(df, s=z),
        lambda z: V.vaccination_rate(df, "2025-02", s=z),
        lambda z: S.icu_admission_rate(df, s=z),
        lambda z: N.cases_per_month(Rep.known_by(df, month, z), month, s=z),
    ):
        pruned = build(s)
        assert rows(pruned) == rows(build(CASES)) and rows(pruned)
        filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan(pruned))
        assert any("month" in f for f in filters)
    text = plan(N.cases_per_month(df, month, start="2025-02-10", s=s))
    assert "PartitionFilters: [isnotnull(month" in text


def test_a_report_reads_the_cases_three_times_at_most(spark, tmp_path):
    from datetime import date

    from casewatch.operators.features import case_features

    data = [
        {"notified_on": f"2025-0{1 + i % 6}-1{i % 9}", "state": ("SP", "RJ", None)[i % 3], "icu_in": "2025-06-01", "age_value": i, "age_unit": 3}
        for i in range(60)
    ]
    case_features(cases(spark, data)).write.parquet(f"{tmp_path}/cases_table")
    beds = spark.createDataFrame([("SP", date(2025, 6, 1), 3, 2, 1)], "state string, month date, adult int, pediatric int, neonatal int")
    beds = beds.toDF(Rep.BEDS.state, Rep.BEDS.month, Rep.BEDS.sum_adult, Rep.BEDS.sum_pediatric, Rep.BEDS.sum_neonatal)
    beds.write.parquet(f"{tmp_path}/beds_table")
    stored, beds = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("cases_table", "beds_table"))
    for df in (Rep.report_metrics(stored, beds, date(2025, 6, 25)), Rep.report(stored, beds, date(2025, 6, 25))):
        assert 0 < scans(df, "cases_table") <= 3 and scans(df, "beds_table") == 1
    assert scans(Rep.report_series(stored, date(2025, 6, 25)), "cases_table") == 1
    assert len(Rep.report(stored, beds, date(2025, 6, 25)).first().icu_occupancy) == 1


@pytest.fixture
def queried(spark, tmp_path):
    spark.range(5).selectExpr("id", "id % 2 as kind", "array(id, id + 1) as both").createOrReplaceTempView("queried")
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/files")
    return f"{tmp_path}/files"


@pytest.mark.parametrize("sql", [
    "select java_method('java.lang.System', 'setProperty', 'casewatch.probe', 'set')",
    "select id from queried where reflect('java.lang.System', 'getProperty', 'user.home') is not null",
    "select try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "select (select java_method('java.lang.System', 'getProperty', 'user.home')) as x",
    "select exists (select 1 from queried where java_method('java.util.UUID', 'randomUUID') = 'x') as x",
    "select transform(both, x -> java_method('java.lang.Math', 'abs', x)) as x from queried",
    "with c as (select java_method('java.util.UUID', 'randomUUID') as u) select * from c",
    "select TRANSFORM(id) USING 'cat' AS (x string) from queried",
    "select registered(id) as x from queried",
])
def test_a_query_that_would_do_more_than_read_is_refused_before_it_runs(spark, queried, sql):
    spark.udf.register("registered", lambda x: x, "bigint")
    with pytest.raises(NotAllowed):
        query_sql(spark, sql)
    assert spark._jvm.java.lang.System.getProperty("casewatch.probe") is None


def test_a_query_reads_no_files_by_path_and_runs_no_command(spark, queried):
    for sql in (f"select * from parquet.`{queried}`", "drop view queried", "select 1) as a; drop view queried; select * from (select 1"):
        with pytest.raises(Exception):
            query_sql(spark, sql).collect()
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true" and spark.catalog.tableExists("queried")


@pytest.mark.parametrize("sql,n", [
    ("with c as (select kind, count(*) as n from queried group by kind having count(*) > 1) select * from c order by n", 2),
    ("select id, row_number() over (partition by kind order by id) as r, q.x from queried lateral view explode(both) q as x", 5),
    ("select kind, grouping(kind) as g, sum(id) as s from queried group by rollup (kind)", 3),
    ("select a.id from queried a left anti join queried b on a.id = b.id + 1 union select id from queried where id in (select kind from queried)", 2),
    ("select * from values (1, 'a'), (2, 'b') as t(x, y) limit 1 offset 1", 1),
    ("select * from (select kind, id from queried) pivot (sum(id) for kind in (0, 1))", 1),
    ("select *, (select max(id) from queried) as m, date_format(current_date(), 'yyyy') as y, named_struct('a', id) as s from queried", 5),
])
def test_queries_that_read_and_compute_are_answered(spark, queried, sql, n):
    assert len(query_sql(spark, sql).collect()) == n
