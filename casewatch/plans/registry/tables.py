"""Keyed merges, snapshots, the ledger, sources and sinks."""

from __future__ import annotations

import io
import uuid
import zipfile
from datetime import date

import pyarrow as pa
from pyspark.sql import functions as F

from casewatch.contracts import case_contract, CASES
from casewatch.operators import upsert as U
from casewatch.operators.features import case_features
from casewatch.plans.fixtures import (
    AS_OF, BEDS_SQL, CASES_SQL, FEATURES_SQL, TABLES, load, load_beds, load_cases, text_dates,
)
from casewatch.plans.registry import query
from casewatch.session import shared_dir
from casewatch.sources import changes, delimited as C, snapshots as N, tables as T
from casewatch.streaming.ingest import incremental_ingest, stream_delimited, stream_lines

# A batch of corrections to the orders of two statuses: urgent orders of any
# status, the most urgent of them twice with a newer price.
UPSERT_SQL = """target as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'P'),
source as (select o_orderkey, 'U' as o_orderstatus, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH')
  union all select o_orderkey, 'V', o_totalprice + 1 from orders where o_orderpriority = '1-URGENT'),
newer as (select o_orderkey, max(o_orderstatus) as o_orderstatus, max(o_totalprice) as o_totalprice from source group by 1),
merged as (select * from target where o_orderkey not in (select o_orderkey from source) union all select * from newer)"""


def order_batch(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    target = orders.filter("o_orderstatus <> 'P'").select(*columns)
    first = orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')").withColumn("o_orderstatus", F.lit("U"))
    second = orders.filter("o_orderpriority = '1-URGENT'").withColumns(
        {"o_orderstatus": F.lit("V"), "o_totalprice": F.col("o_totalprice") + 1}
    )
    return target, first.select(*columns).unionByName(second.select(*columns))


@query(f"with {UPSERT_SQL} select * from merged")
def upsert_single(spark, sf_dir):
    """Merge by one key, newest of a repeated key kept."""
    return U.upsert(*order_batch(spark, sf_dir), ["o_orderkey"], order_by=["o_totalprice"])


@query(f"""with {BEDS_SQL}, target as (select * from beds where comp <= 200106),
source as (select facility_id, comp, state, beds_adult + 1 as beds_adult, beds_ped, beds_neo from beds where comp >= 200106)
select * from target t where not exists (select 1 from source s where s.facility_id = t.facility_id and s.comp = t.comp)
union all select * from source""")
def upsert_composite(spark, sf_dir):
    """Merge of a later bed inventory by facility and month."""
    beds = load_beds(spark, sf_dir)
    later = beds.filter("comp >= 200106").withColumn("beds_adult", F.col("beds_adult") + 1)
    return U.upsert(beds.filter("comp <= 200106"), later, ["facility_id", "comp"])


@query(f"""with {UPSERT_SQL} select (select count(*) from target) as rows_before,
(select count(*) from source) as rows_source, (select count(*) from merged) as rows_after,
(select count(*) from newer where o_orderkey not in (select o_orderkey from target)) as inserted,
(select count(*) from newer where o_orderkey in (select o_orderkey from target)) as updated,
(select count(*) from source) - (select count(*) from newer) as superseded""")
def upsert_audit(spark, sf_dir):
    """What that merge does, in counts."""
    return U.upsert_audit(*order_batch(spark, sf_dir), ["o_orderkey"])


@query("""select o_orderkey, max(o_totalprice) as o_totalprice from (
select o_orderkey, o_totalprice from orders union all
select l_orderkey, l_extendedprice from lineitem) group by 1""")
def keep_latest(spark, sf_dir):
    """One row per key out of many."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice")
    )
    return U.keep_latest(orders.unionByName(lines), ["o_orderkey"], ["o_totalprice"])


# Snapshots of three yearly files, published on the order dates.
LISTING_SQL = """listing as (select 's3a://cases/INFLUD' || lpad(cast(1 + o_custkey % 3 as varchar), 2, '0') || '-'
  || strftime(o_orderdate, '%d-%m-%Y') || '.csv' as path, 2001 + o_custkey % 3 as year,
  cast(o_orderdate as date) as updated_on, o_orderstatus from orders),
latest as (select year, max(updated_on) as updated_on, arg_max(path, updated_on) as path from listing
  where updated_on between date '2001-07-02' and date '2001-07-31' group by 1),
ledger as (select distinct year, updated_on from listing where o_orderstatus = 'F'
  and updated_on <= case when year = 2001 then date '2001-12-31' else date '2001-07-15' end and year <> 2003)"""


def listing(spark, sf_dir):
    suffix = F.lpad((1 + F.col("o_custkey") % 3).cast("string"), 2, "0")
    return load(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("s3a://cases/INFLUD"), suffix, F.lit("-"),
            F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(".csv"),
        ).alias("path"),
        (2001 + F.col("o_custkey") % 3).cast("int").alias("year"),
        F.col("o_orderdate").cast("date").alias("updated_on"),
        "o_orderstatus",
    )


def ledger_rows(spark, sf_dir):
    until = F.when(F.col("year") == 2001, F.lit(date(2001, 12, 31))).otherwise(F.lit(date(2001, 7, 15)))
    rows = listing(spark, sf_dir).filter("o_orderstatus = 'F' and year <> 2003")
    return rows.filter(F.col("updated_on") <= until).select("year", "updated_on").distinct()


@query(f"with {LISTING_SQL} select cast(year as int) as year, path, cast(updated_on as varchar) as updated_on from latest")
def latest_snapshot(spark, sf_dir):
    """Newest file of each year among the last thirty days."""
    return text_dates(N.latest_snapshot(listing(spark, sf_dir).select("path"), AS_OF))


@query(f"with {LISTING_SQL} select cast(year as int) as year, cast(max(updated_on) as varchar) as updated_on from ledger group by 1")
def ledger_latest(spark, sf_dir):
    """Newest loaded date per year."""
    return text_dates(N.ledger_latest(ledger_rows(spark, sf_dir)))


@query(f"""with {LISTING_SQL} select cast(year as int) as year, path, cast(updated_on as varchar) as updated_on from latest l
where not exists (select 1 from ledger g where g.year = l.year and g.updated_on >= l.updated_on)""")
def fresh_only(spark, sf_dir):
    """Newest files the ledger does not have yet."""
    found = N.latest_snapshot(listing(spark, sf_dir).select("path"), AS_OF)
    return text_dates(N.fresh_only(found, ledger_rows(spark, sf_dir)))


@query(f"""with {LISTING_SQL}, newest as (select year, max(updated_on) as updated_on from ledger group by 1)
select distinct cast(year as int) as year, cast(updated_on as varchar) as updated_on from listing l
where not exists (select 1 from newest n where n.year = l.year and n.updated_on = l.updated_on)""")
def ledger_additions(spark, sf_dir):
    """Dates to append to the ledger."""
    return text_dates(N.ledger_additions(ledger_rows(spark, sf_dir), listing(spark, sf_dir)))


@query(f"""with {LISTING_SQL} select cast(year as int) as year, cast(max(updated_on) as varchar) as updated_on
from (select year, updated_on from ledger union all select year, updated_on from latest) group by 1""")
def ledger_record(spark, sf_dir):
    """Ledger after the newest files were loaded, the same ones twice."""
    name = fresh_name("ledger")
    N.ledger_record(spark, name, ledger_rows(spark, sf_dir))
    found = N.latest_snapshot(listing(spark, sf_dir).select("path"), AS_OF)
    for _ in range(2):
        N.ledger_record(spark, name, found)
    return text_dates(N.ledger_latest(N.read_ledger(spark, name)))


@query("select o_orderkey, o_custkey, o_totalprice, year(o_orderdate) as year from orders")
def union_years(spark, sf_dir):
    """Yearly frames with differing column order back in one table."""
    orders = load(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    older = orders.filter("year < 1997").select("year", "o_orderkey", "o_custkey", "o_totalprice")
    middle = orders.filter("year between 1997 and 1999").select("o_orderkey", "o_custkey", "o_totalprice", "year")
    newer = orders.filter("year > 1999").select("o_totalprice", "year", "o_custkey", "o_orderkey")
    return T.union_years([older, middle, newer])


@query("""select p_partkey as id, p_name as name, p_size as size, null as balance from part
union all by name select s_suppkey as id, s_name as name, null as size, s_acctbal as balance from supplier""")
def union_missing(spark, sf_dir):
    """Frames with different columns, the absent ones null."""
    part = load(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_name as name", "p_size as size")
    supplier = load(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance")
    return T.union_years([part, supplier], allow_missing=True)


def fresh_name(prefix: str) -> str:
    """Table name of this run alone, so that queries never meet."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@query(f"""with {CASES_SQL}, {FEATURES_SQL} select case_id, cast(notified_on as varchar) as notified_on,
is_death, cast(icu_days as int) as icu_days, age_years, bed_class from feats""")
def feature_table(spark, sf_dir):
    """Feature table written by key, written again, and read back."""
    name = fresh_name("features")
    rows = case_features(load_cases(spark, sf_dir)).select(
        "case_id", "notified_on", "is_death", "icu_days", "age_years", "bed_class"
    )
    T.write_feature_table(rows, name, "case_id")
    T.write_feature_table(rows.filter("is_death = 1"), name, "case_id")
    return text_dates(T.read_table(spark, name))


@query(f"""with {UPSERT_SQL} select o_orderkey, o_totalprice, o_orderstatus from merged""")
def upsert_partitioned_table(spark, sf_dir):
    """Merge into a partitioned table; corrected rows change their partition."""
    name = fresh_name("orders")
    target, source = order_batch(spark, sf_dir)
    T.write_table(target, name, partition_by=["o_orderstatus"])
    T.upsert_table(source, name, ["o_orderkey"], order_by=["o_totalprice"])
    return T.read_table(spark, name)


@query(f"""with {UPSERT_SQL} select o_orderkey, o_totalprice, o_orderstatus from merged""")
def upsert_bucketed_table(spark, sf_dir):
    """Merge into a table laid out by key."""
    name = fresh_name("orders")
    target, source = order_batch(spark, sf_dir)
    T.write_table(target, name, bucket_by=(8, ["o_orderkey"]))
    T.upsert_table(source, name, ["o_orderkey"], order_by=["o_totalprice"])
    return T.read_table(spark, name)


@query("""select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as int) as nation from supplier""")
def write_table_evolved(spark, sf_dir):
    """Overwrite that adds a column and keeps the old ones."""
    supplier, name = load(spark, sf_dir, "supplier"), fresh_name("suppliers")
    T.write_table(supplier.selectExpr("s_suppkey as id", "s_name as name", "s_nationkey as nation"), name)
    T.write_table(
        supplier.selectExpr("s_suppkey as id", "s_name as name", "s_acctbal as balance"), name, merge_schema=True
    )
    return T.read_table(spark, name)


CSV_SQL = f"""with {CASES_SQL} select case_id, cast(notified_on as varchar) as notified_on, outcome,
cast(icu_in as varchar) as icu_in, cast(icu_out as varchar) as icu_out from cases"""


def csv_export(spark, sf_dir, columns):
    """Cases as the published text: ';', day first, one folder per run."""
    folder = f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"
    rows = load_cases(spark, sf_dir).select(*columns)
    rows.write.options(sep=";", header=True, dateFormat="dd/MM/yyyy").csv(folder)
    return folder


@query(CSV_SQL)
def read_delimited(spark, sf_dir):
    """Text files with inferred types."""
    folder = csv_export(spark, sf_dir, ["case_id", "notified_on", "outcome", "icu_in", "icu_out"])
    read = C.read_delimited(spark, folder)
    return text_dates(read.withColumn("case_id", F.col("case_id").cast("bigint")))


@query(CSV_SQL)
def read_with_contract(spark, sf_dir):
    """Text files in another column order, bound by name."""
    folder = csv_export(spark, sf_dir, ["icu_out", "outcome", "case_id", "icu_in", "notified_on"])
    contract = case_contract(CASES, ["case_id", "notified_on", "outcome", "icu_in", "icu_out"])
    read = C.read_with_contract(spark, folder, contract)
    return text_dates(read.withColumn("case_id", F.col("case_id").cast("bigint")))


@query("""select o_orderkey, o_orderstatus, o_totalprice from orders""")
def incremental_ingest_table(spark, sf_dir):
    """Files streamed once into a keyed table; a second run finds nothing new."""
    name = fresh_name("ingested")
    for _ in range(2):
        stream = spark.readStream.schema(TABLES["orders"]).parquet(f"{sf_dir}/orders.parquet*")
        incremental_ingest(stream.select("o_orderkey", "o_orderstatus", "o_totalprice"), name, ["o_orderkey"])
    return T.read_table(spark, name)


def files_of_other_orders(spark, sf_dir) -> str:
    """A folder of case files whose columns stand in two orders."""
    other = load_cases(spark, sf_dir).select("notified_on", "case_id", "icu_in", "icu_out", "outcome")
    half = F.col("case_id") % 2 == 0
    both = f"{shared_dir(spark)}/exports/{uuid.uuid4().hex}"
    first = load_cases(spark, sf_dir).select("icu_out", "outcome", "case_id", "icu_in", "notified_on")
    options = {"sep": ";", "header": True, "dateFormat": "dd/MM/yyyy"}
    first.where(half).write.options(**options).csv(both)
    other.where(~half).write.mode("append").options(**options).csv(both)
    return both


CASE_FILE = case_contract(CASES, ["case_id", "notified_on", "outcome", "icu_in", "icu_out"])


@query(CSV_SQL)
def read_files_of_other_orders(spark, sf_dir):
    """Files of one folder whose columns stand in different orders, each bound by its own header."""
    read = C.read_with_contract(spark, files_of_other_orders(spark, sf_dir), CASE_FILE)
    return text_dates(read.withColumn("case_id", F.col("case_id").cast("bigint")))


@query(CSV_SQL)
def stream_files_of_other_orders(spark, sf_dir):
    """The same files streamed into a keyed table."""
    name = fresh_name("streamed")
    lines = stream_lines(spark, files_of_other_orders(spark, sf_dir))
    incremental_ingest(lines, name, ["case_id"], bind=lambda batch: C.bind_lines(batch, CASE_FILE))
    return text_dates(T.read_table(spark, name).withColumn("case_id", F.col("case_id").cast("bigint")))


@query(f"""with {CASES_SQL}, {FEATURES_SQL} select case_id, cast(notified_on as varchar) as notified_on,
is_death, cast(icu_days as int) as icu_days, age_years, bed_class from feats""")
def features_of_changed_cases(spark, sf_dir):
    """A feature table that follows the cases: built in full, then for those a later load changed."""
    source, derived = fresh_name("cases"), fresh_name("features")
    loaded = load_cases(spark, sf_dir)
    early = F.when(F.col("case_id") % 3 != 0, F.col("outcome"))  # a third of the outcomes come later
    T.write_table(loaded.filter("case_id % 5 <> 0").withColumn("outcome", early), source, partition_by=["outcome"])
    columns = ["case_id", "notified_on", "is_death", "icu_days", "age_years", "bed_class"]

    def features(cases):
        return case_features(cases).select(*columns)

    T.write_feature_table(features(T.read_table(spark, source)), derived, "case_id")
    changes.begin(spark, source, ["case_id", "outcome"])
    batch = loaded.filter("case_id % 3 = 0 or case_id % 5 = 0")
    T.upsert_table(batch, source, ["case_id"], order_by=["notified_on"], before=lambda rows: changes.record(rows, source))
    changed = changes.touched(T.read_table(spark, source), changes.pending(spark, source), ["case_id"], ["outcome"])
    T.write_feature_table(features(changed), derived, "case_id")
    return text_dates(T.read_table(spark, derived))


@query(f"with {BEDS_SQL} select * from beds")
def read_zipped_beds(spark, sf_dir):
    """Bed inventories out of one zip archive per month."""
    columns = ["facility_id", "comp", "state", "beds_adult", "beds_ped", "beds_neo"]
    beds = load_beds(spark, sf_dir).select(*columns)

    def zip_month(month: pa.Table) -> pa.Table:
        rows = zip(*(month.column(c).to_pylist() for c in columns))
        lines = [";".join(columns), *(";".join(map(str, row)) for row in rows)]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("beds.csv", "\n".join(lines).encode("latin-1"))
        return pa.table({"content": [packed.getvalue()]})

    archives = beds.groupBy("comp").applyInArrow(zip_month, "content binary")
    return C.unzipped(archives, beds.schema, strict=True)


@query(f"""with {UPSERT_SQL}, day as (select o_orderkey as k, cast(o_orderdate as date) as d from orders)
select o_orderkey, o_totalprice, o_orderstatus, cast(d as varchar) as day from merged join day on k = o_orderkey""")
def upsert_by_day_table(spark, sf_dir):
    """Merge into a table with a partition per day, nearly all of which it touches."""
    name = fresh_name("orders_by_day")
    days = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day")
    target, source = (df.join(days, "o_orderkey") for df in order_batch(spark, sf_dir))
    T.write_table(target, name, partition_by=["day"])
    T.upsert_table(source, name, ["o_orderkey"], order_by=["o_totalprice"])
    return text_dates(T.read_table(spark, name))


@query(CSV_SQL)
def stream_delimited_table(spark, sf_dir):
    """CSV files streamed under a contract into a keyed table."""
    columns = ["case_id", "notified_on", "outcome", "icu_in", "icu_out"]
    folder, name = csv_export(spark, sf_dir, columns), fresh_name("streamed")
    stream = stream_delimited(spark, folder, columns, case_contract(CASES, columns))
    incremental_ingest(stream, name, ["case_id"])
    return text_dates(T.read_table(spark, name).withColumn("case_id", F.col("case_id").cast("bigint")))
