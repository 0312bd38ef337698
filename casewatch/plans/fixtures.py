"""Case, bed, snapshot and hit tables as projections of the given tables.

The `*_SQL` texts define the same projections for the check in another engine.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = date(2001, 7, 31)

CASE_COLUMNS = """
  o_orderkey as case_id,
  cast(o_orderdate as date) as notified_on,
  case o_orderstatus when 'F' then 1 when 'P' then 2 else null end as outcome,
  case when o_orderstatus = 'O' then null
       else cast(o_orderdate as date) + cast(o_orderkey % 40 as int) end as outcome_on,
  cast(o_custkey % 90 as int) as age_value,
  case when o_orderkey % 20 = 0 then 1 when o_orderkey % 20 = 1 then 2 else 3 end as age_unit,
  case when o_orderpriority in ('1-URGENT','2-HIGH')
       then cast(o_orderdate as date) + cast(o_orderkey % 10 as int) end as icu_in,
  case when o_orderpriority in ('1-URGENT','2-HIGH') and o_orderkey % 4 <> 0
       then cast(o_orderdate as date) + cast(o_orderkey % 10 + o_orderkey % 25 as int) end as icu_out,
  case when o_orderkey % 5 < 2 then 1 when o_orderkey % 5 = 4 then 9 else 2 end as vac_covid,
  case when o_custkey % 3 = 0 then 1 else 2 end as vac_flu"""
STATE_COLUMN = "case when o_orderkey % 97 = 0 then null else n_name end as state"

# `cases` holds everything an order alone tells; `state_cases` adds the state.
CASES_SQL = f"cases as (select {CASE_COLUMNS} from orders)"
STATE_CASES_SQL = f"""cases as (select {CASE_COLUMNS}, {STATE_COLUMN}
  from orders left join (select c_custkey, n_name from customer
       left join nation on c_nationkey = n_nationkey) c on o_custkey = c_custkey)"""
FEATURES_SQL = """feats as (select *, case
    when age_years <= 0.0768 then 'neonatal' when age_years >= 12 then 'adult'
    else 'pediatric' end as bed_class
  from (select *,
    case when outcome = 2 then 1 else 0 end as is_death,
    case when outcome = 1 then 1 else 0 end as is_discharge,
    case when icu_out is not null then icu_out - icu_in else outcome_on - icu_in end as icu_days,
    case when age_unit = 1 then round(age_value / 365e0, 2)
         when age_unit = 2 then round(age_value / 12e0, 2) else age_value end as age_years,
    case when vac_covid = 1 then 1 else 0 end as vaccinated_covid,
    case when vac_flu = 1 then 1 else 0 end as vaccinated_flu
  from cases))"""
BEDS_SQL = """beds as (select s_suppkey as facility_id, m.comp, n_name as state,
    cast(1 + s_suppkey % 5 as int) as beds_adult,
    cast(s_suppkey % 3 as int) as beds_ped,
    cast(s_suppkey % 2 as int) as beds_neo
  from supplier join nation on s_nationkey = n_nationkey
  cross join (select 200105 as comp union all select 200106 union all select 200107) m)"""
BED_FEATURES_SQL = """bed_feats as (select state, cast(sum(beds_adult) as bigint) as adult,
    cast(sum(beds_ped) as bigint) as pediatric, cast(sum(beds_neo) as bigint) as neonatal,
    state || cast(comp as varchar) as beds_key,
    make_date(comp // 100, comp % 100, 1) as beds_month
  from beds where comp > 200100 group by state, comp)"""


# Columns of the given tables; stated, so that no job runs to learn them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def load_cases(spark: SparkSession, sf_dir: str, state: bool = False) -> DataFrame:
    """Cases, one per order. The state costs a join, so it is only added on
    demand; it is an outer join and never changes the rows."""
    orders = load(spark, sf_dir, "orders")
    columns = [c.strip() for c in CASE_COLUMNS.split(",\n")]
    if not state:
        return orders.selectExpr(*columns)
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
    return placed.selectExpr(*columns, STATE_COLUMN)


def load_beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed inventory: every supplier in each of three months."""
    nation = load(spark, sf_dir, "nation")
    return (
        load(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("comp", F.explode(F.array(F.lit(200105), F.lit(200106), F.lit(200107))))
        .selectExpr(
            "s_suppkey as facility_id",
            "comp",
            "n_name as state",
            "cast(1 + s_suppkey % 5 as int) as beds_adult",
            "cast(s_suppkey % 3 as int) as beds_ped",
            "cast(s_suppkey % 2 as int) as beds_neo",
        )
    )


def text_dates(df: DataFrame) -> DataFrame:
    """DATE columns as ISO text, so results compare alike in any client."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})
