"""Sources, keyed writes, the ledger, the stream and the daily run."""

import random
import uuid
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F, types as T

from casewatch.contracts import BED_COLUMNS, BED_INVENTORY, CASES, bed_contract, case_contract
from casewatch.operators import upsert as U
from casewatch.plans import daily
from casewatch.sources import changes, delimited as C, reports as R, snapshots as N, tables as B
from casewatch.streaming.ingest import incremental_ingest, stream_delimited, stream_lines
from tests.helpers import cases, day, rows


def name(prefix="t"):
    return f"{prefix}_{uuid.uuid4().hex[:10]}"


def pairs(spark, data):
    return spark.createDataFrame(data, "k int, v string, t int")


# Upsert ----------------------------------------------------------------------

def test_upsert_replaces_and_inserts(spark):
    target = pairs(spark, [(1, "a", 0), (2, "b", 0)])
    source = pairs(spark, [(2, "B", 1), (3, "C", 1)])
    assert rows(U.upsert(target, source, ["k"])) == [(1, "a", 0), (2, "B", 1), (3, "C", 1)]


def test_null_keys_match_nothing(spark):
    target = pairs(spark, [(None, "a", 0), (1, "b", 0)])
    source = pairs(spark, [(None, "x", 1), (None, "x", 1)])
    once = U.upsert(target, source, ["k"])
    assert sorted(r.v for r in once.collect()) == ["a", "b", "x", "x"]
    assert U.upsert(once, source, ["k"]).count() == 6


def test_newest_duplicate_wins_or_fails(spark):
    target = pairs(spark, [(1, "a", 0)])
    source = pairs(spark, [(1, "old", 1), (1, "new", 2), (1, None, 1)])
    assert rows(U.upsert(target, source, ["k"], order_by=["t"])) == [(1, "new", 2)]
    with pytest.raises(Exception, match="duplicate key"):
        U.upsert(target, source, ["k"], on_duplicate="error").collect()
    fine = U.upsert(target, pairs(spark, [(2, "x", 1)]), ["k"], on_duplicate="error")
    assert rows(fine) == [(1, "a", 0), (2, "x", 1)]


def test_upsert_is_idempotent_and_counts_the_key_union(spark):
    rng = random.Random(3)
    target = pairs(spark, [(k, "t", 0) for k in rng.sample(range(500), 200)])
    source = pairs(spark, [(rng.randrange(500), f"s{i}", i) for i in range(300)])
    once = U.upsert(target, source, ["k"], ["t"])
    assert rows(U.upsert(once, source, ["k"], ["t"])) == rows(once)
    union = target.select("k").union(source.select("k")).distinct().count()
    assert once.count() == union
    audit = U.upsert_audit(target, source, ["k"]).first()
    assert audit.rows_after == union
    assert audit.inserted == union - audit.rows_before == source.select("k").subtract(target.select("k")).count()
    assert audit.updated + audit.inserted + audit.superseded == audit.rows_source


def test_audit_of_null_keys_and_empty_frames(spark):
    target, source = pairs(spark, [(None, "a", 0)]), pairs(spark, [(None, "x", 1), (None, "y", 1)])
    audit = U.upsert_audit(target, source, ["k"]).first()
    assert tuple(audit) == (1, 2, U.upsert(target, source, ["k"]).count(), 2, 0, 0)
    assert tuple(U.upsert_audit(target.limit(0), source.limit(0), ["k"]).first()) == (0, 0, 0, 0, 0, 0)


def test_columns_are_matched_by_name(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([("b", 1)], "v string, k int")
    assert rows(U.upsert(target, source, ["k"])) == [(1, "b")]


# Tables ----------------------------------------------------------------------

@pytest.mark.parametrize("layout", [{}, {"partition_by": ["t"]}, {"bucket_by": (4, ["k"])}])
def test_table_upsert_in_every_layout(spark, layout):
    table = name()
    B.write_table(pairs(spark, [(1, "a", 0), (2, "b", 1), (3, "c", 1)]), table, **layout)
    source = pairs(spark, [(2, "B", 2), (3, "C", 2), (4, "D", None)])
    for _ in range(2):
        B.upsert_table(source, table, ["k"])
        got = rows(B.read_table(spark, table).select("k", "v", "t"))
        assert got == [(1, "a", 0), (2, "B", 2), (3, "C", 2), (4, "D", None)]
    B.upsert_table(pairs(spark, [(4, "E", 0)]), table, ["k"])
    assert rows(B.read_table(spark, table).select("k", "v", "t"))[-1] == (4, "E", 0)


def test_untouched_partitions_are_not_rewritten(spark):
    table = name()
    B.write_table(pairs(spark, [(1, "a", 0), (2, "b", 1)]), table, partition_by=["t"])
    files = lambda: {r.f for r in B.read_table(spark, table).filter("t = 0").select(F.input_file_name().alias("f")).collect()}
    before = files()
    B.upsert_table(pairs(spark, [(2, "B", 1)]), table, ["k"])
    assert files() == before


def test_failed_overwrite_leaves_the_table(spark):
    table = name()
    B.write_table(pairs(spark, [(1, "a", 0)]), table)
    broken = pairs(spark, [(1, "b", 0)]).withColumn("t", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        B.write_table(broken, table)
    assert rows(B.read_table(spark, table)) == [(1, "a", 0)]


def test_schema_evolution_and_append(spark):
    table = name()
    B.write_table(pairs(spark, [(1, "a", 0)]), table)
    wider = spark.createDataFrame([(2, "x")], "k int, extra string")
    B.write_table(wider, table, merge_schema=True)
    assert rows(B.read_table(spark, table)) == [(2, None, None, "x")]
    B.write_table(B.read_table(spark, table), table, mode="append")
    assert B.read_table(spark, table).count() == 2


def test_feature_table_rejects_bad_keys(spark):
    table = name()
    with pytest.raises(B.KeyViolation):
        B.write_feature_table(pairs(spark, [(1, "a", 0), (1, "b", 0)]), table, "k")
    with pytest.raises(B.KeyViolation):
        B.write_feature_table(pairs(spark, [(None, "a", 0)]), table, "k")
    assert not B.table_exists(spark, table)
    B.write_feature_table(pairs(spark, [(1, "a", 0)]), table, "k")
    B.write_feature_table(pairs(spark, [(1, "b", 0), (2, "c", 0)]), table, "k")
    assert rows(B.read_table(spark, table)) == [(1, "b", 0), (2, "c", 0)]


def test_union_years_by_name_and_drift(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k int")
    assert rows(B.union_years([a, b])) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="only_right"):
        B.union_years([a, b.withColumn("z", F.lit(1))])
    with pytest.raises(ValueError, match="retyped"):
        B.union_years([a, a.withColumn("k", F.lit("1"))], allow_missing=True)
    assert rows(B.union_years([a, b.drop("v")], allow_missing=True)) == [(1, "x"), (2, None)]
    diff = B.schema_diff(a.schema, b.drop("v").schema)
    assert (diff["only_left"], diff["only_right"], diff["common"]) == (["v"], [], ["k"])


def test_from_rows_may_be_empty(spark):
    assert B.from_rows(spark, [], "a int, b string").columns == ["a", "b"]


# Text files ------------------------------------------------------------------

CONTRACT = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("n", T.IntegerType())])


def test_contract_binds_by_name_and_counts_lost_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n;d;k;more\n10;05/03/2025;1;x\nten;2025-03-05;2;y\n;;3;z\n")
    got = C.read_with_contract(spark, str(tmp_path), CONTRACT, audit=True)
    assert rows(got) == [(1, day("2025-03-05"), 10, 0), (2, None, None, 2), (3, None, None, 0)]
    with pytest.raises(ValueError, match="missing"):
        C.read_with_contract(spark, str(tmp_path), CONTRACT.add("gone", T.StringType()))


def test_inferred_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;d;n\n1;05/03/2025;10\n", encoding="latin-1")
    got = C.read_delimited(spark, str(tmp_path), encoding="ISO-8859-1")
    assert dict(got.dtypes) == {"k": "int", "d": "date", "n": "int"}


def test_zipped_csv_drops_long_lines_and_pads_short_ones(spark, tmp_path):
    fixed = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("d", T.StringType()), T.StructField("n", T.IntegerType())])
    with zipfile.ZipFile(tmp_path / "beds.zip", "w") as z:
        text = 'k;d;n\n1;São "Paulo";10\n2;b\n3;c;1;9\n4;d;5;\n5;"a;b";NA\n'
        z.writestr("beds.csv", text.encode("latin-1"))
        z.writestr("second.csv", "k;d;n\n99;x;1\n")
    got = C.read_zipped_csv(spark, str(tmp_path / "*.zip"), fixed, partitions=2, batch_rows=2)
    assert rows(got) == [(1, 'São "Paulo"', 10), (2, "b", None), (5, "a;b", None)]


def test_bed_contract_of_the_published_inventory():
    contract = bed_contract(BED_INVENTORY, BED_COLUMNS)
    types = {f.name: f.dataType for f in contract}
    assert types["COMP"] == types["LEITOS_SUS"] == T.IntegerType() and types["CNES"] == T.StringType()


# Snapshots and ledger ------------------------------------------------------------

def test_latest_snapshot_reads_day_first_and_looks_back_thirty_days(spark):
    files = [
        "s3a://b/2026/INFLUD26-05-03-2026.csv", "s3a://b/2026/INFLUD26-04-03-2026.csv",
        "s3a://b/2025/INFLUD25-26-06-2025.csv", "s3a://b/2026/INFLUD26-06-03-2026.csv",
        "s3a://b/2025/INFLUD25-08-02-2026.csv", "s3a://b/2024/INFLUD24-03-02-2026.csv", "s3a://b/x.csv",
    ]
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    got = N.latest_snapshot(listing, date(2026, 3, 5))
    assert rows(got) == [(2025, files[4], day("2026-02-08")), (2026, files[0], day("2026-03-05"))]
    assert rows(N.latest_snapshot(listing, date(2026, 3, 5), years=[2025]).select("year")) == [(2025,)]


def test_ledger_round(spark):
    ledger = name("ledger")
    new = spark.createDataFrame([(2025, day("2025-03-01")), (2026, day("2026-03-01"))], "year int, updated_on date")
    assert rows(N.fresh_only(new, N.read_ledger(spark, ledger))) == rows(new)
    N.ledger_record(spark, ledger, new)
    N.ledger_record(spark, ledger, new)
    assert N.read_ledger(spark, ledger).count() == 2
    assert N.fresh_only(new, N.read_ledger(spark, ledger)).collect() == []
    later = spark.createDataFrame([(2025, day("2025-04-01")), (2026, day("2026-02-01"))], "year int, updated_on date")
    assert rows(N.fresh_only(later, N.read_ledger(spark, ledger))) == [(2025, day("2025-04-01"))]
    N.ledger_record(spark, ledger, later)
    assert rows(N.ledger_latest(N.read_ledger(spark, ledger), 2025)) == [(2025, day("2025-04-01"))]
    assert N.ledger_latest(N.read_ledger(spark, ledger), 1999).collect() == []


# Reports -----------------------------------------------------------------------

def test_report_lookup(spark, tmp_path):
    (tmp_path / "report_2025-03-05.html").write_text("<html><head><title>x</title></head><body><h1>Hi</h1><p>all <b>well</b></p></body></html>")
    (tmp_path / "notes.html").write_text("<p>no date</p>")
    found = R.report_lookup(spark, str(tmp_path), date(2025, 3, 5)).collect()
    assert len(found) == 1 and found[0].exists and found[0].path.endswith("report_2025-03-05.html")
    assert found[0].content == "# Hi\n\nall **well**"
    missing = R.report_lookup(spark, str(tmp_path), date(2025, 3, 6)).first()
    assert (missing.exists, missing.path, missing.content) == (False, None, None)
    assert "2025-03-06" in missing.message


# Stream and daily run --------------------------------------------------------------

HEADER = "case_id;notified_on;state;outcome;outcome_on;age_value;age_unit;icu_in;icu_out;vac_covid;vac_flu"


def line(case_id, notified_on, state="SP", outcome=""):
    return f"{case_id};{notified_on};{state};{outcome};;30;3;{notified_on};;1;2"


def test_stream_takes_each_file_once(spark, tmp_path):
    table, folder = name("cases"), tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join([HEADER, line(1, "01/03/2025"), line(2, "01/03/2025")]))
    contract, batches = case_contract(CASES), []

    def run():
        stream = stream_delimited(spark, str(folder), HEADER.split(";"), contract, files_per_batch=1)
        incremental_ingest(
            stream, table, ["case_id"], checkpoint=str(tmp_path / "checkpoint"),
            after_batch=lambda batch, number: batches.append(number),
        )
        return rows(B.read_table(spark, table).select("case_id", "outcome"))

    assert run() == [("1", None), ("2", None)]
    assert run() == [("1", None), ("2", None)] and batches == [0]
    (folder / "b.csv").write_text("\n".join([HEADER, line(2, "01/03/2025", outcome=2), line(3, "02/03/2025")]))
    assert run() == [("1", None), ("2", 2), ("3", None)] and batches == [0, 1]


@pytest.mark.parametrize("s", [CASES, CASES.with_names(month="notified_month")], ids=["whole", "by month"])
def test_daily_run(spark, tmp_path, s):
    names = daily.Tables(*[name(n) for n in ("cases", "beds", "ledger", "cfeat", "bfeat")])
    contract = case_contract(CASES)
    first = [HEADER, line(1, "01/05/2025"), line(2, "02/06/2025"), line(3, "03/06/2025")]
    (tmp_path / "INFLUD25-10-06-2025.csv").write_text("\n".join(first))
    (tmp_path / "INFLUD25-09-06-2025.csv").write_text("not;a;case\nfile;of;old")
    beds = spark.createDataFrame([(1, 202506, "SP", 4, 1, 1)], "facility_id int, comp int, state string, beds_adult int, beds_ped int, beds_neo int")
    B.write_table(beds, names.beds)

    def run(as_of):
        loaded = daily.load_fresh_cases(spark, str(tmp_path), as_of, contract, names, s)
        daily.build_features(spark, as_of.year * 100, names, s)
        return loaded.count(), daily.daily_report(spark, as_of, names, s).first()

    count, report = run(date(2025, 6, 10))
    assert count == 1 and report.total_cases_month == 2 and report.icu_admission_count == 2
    assert report.cases_per_month[0].n == 1 and report.icu_occupancy[0].adult_rate == 50.0
    assert run(date(2025, 6, 10))[0] == 0
    second = [HEADER, line(3, "04/06/2025"), line(4, "05/06/2025")]
    (tmp_path / "INFLUD25-11-06-2025.csv").write_text("\n".join(second))
    count, report = run(date(2025, 6, 11))
    assert count == 1 and report.total_cases_month == 3 and report.last_notification == "05-06-2025"


def test_failed_load_leaves_the_ledger(spark, tmp_path):
    names = daily.Tables(*[name(n) for n in ("cases", "beds", "ledger", "cfeat", "bfeat")])
    (tmp_path / "INFLUD25-10-06-2025.csv").write_text("other;columns\n1;2")
    with pytest.raises(ValueError, match="missing"):
        daily.load_fresh_cases(spark, str(tmp_path), date(2025, 6, 10), case_contract(CASES), names)
    assert N.read_ledger(spark, names.ledger).count() == 0


def test_first_load_extract_and_beds(spark, tmp_path):
    contract, raw = case_contract(CASES), name("raw")
    for year in (2023, 2024):
        text = [HEADER, line(f"{year}1", f"01/03/{year}"), line(f"{year}2", f"02/03/{year}")]
        (tmp_path / f"{year}.csv").write_text("\n".join(text + text[-1:] * (year == 2024)))
    paths = [str(tmp_path / f"{year}.csv") for year in (2023, 2024)]
    repeated = daily.load_history(spark, paths, contract, raw)
    assert [(r.case_id, r.n) for r in repeated.collect()] == [("20242", 2)]
    extract = name("extract")
    daily.write_extract(spark, raw, ["case_id", "state"], extract, by_key="case_id")
    assert B.read_table(spark, extract).columns == ["case_id", "state"]
    assert B.read_table(spark, extract).count() == 5 >= B.read_table(spark, f"{extract}_sample").count()

    names = daily.Tables(beds=name("beds"))
    header = ";".join(BED_COLUMNS)
    bed_line = lambda comp, beds: ";".join([str(comp), "0012", "SP", "S", "M", "1"] + [str(beds)] * 14)
    for part, months in (("a", [(202501, 1), (202502, 2)]), ("b", [(202502, 5), (202503, 6)])):
        with zipfile.ZipFile(tmp_path / f"{part}.zip", "w") as z:
            z.writestr("beds.csv", "\n".join([header, *[bed_line(*m) for m in months]]))
        daily.load_fresh_beds(
            spark, str(tmp_path / f"{part}.zip"), bed_contract(BED_INVENTORY, BED_COLUMNS), names, BED_INVENTORY
        )
    got = B.read_table(spark, names.beds).select("COMP", "CNES", "UTI_ADULTO_EXIST")
    assert rows(got) == [(202501, "0012", 1), (202502, "0012", 5), (202503, "0012", 6)]


@pytest.mark.parametrize("value", ["O'Hara", "a/b c=d%", "back\\slash", 'quo"te', "São João", ""])
def test_partition_values_with_odd_characters(spark, value):
    table = name()
    odd = spark.createDataFrame([(1, "x", value), (2, "y", "plain")], "k int, v string, p string")
    B.write_table(odd, table, partition_by=["p"])
    B.upsert_table(spark.createDataFrame([(1, "X", value)], odd.schema), table, ["k"])
    stored = value or None  # an empty partition value is stored as null
    assert rows(B.read_table(spark, table)) == [(1, "X", stored), (2, "y", "plain")]
    B.upsert_table(spark.createDataFrame([(1, "Z", "plain")], odd.schema), table, ["k"])
    assert rows(B.read_table(spark, table)) == [(1, "Z", "plain"), (2, "y", "plain")]


def test_merge_touches_a_thousand_partitions(spark):
    name = "t_thousand_days"
    days = spark.range(1000).selectExpr("id AS k", "date_add(date'2020-01-01', int(id)) AS day", "'a' AS v")
    B.write_table(days, name, partition_by=["day"])
    B.upsert_table(days.withColumn("v", F.lit("b")).unionByName(days.selectExpr("k + 1000 AS k", "day", "v")), name, ["k"])
    got = {r["v"]: r["n"] for r in B.read_table(spark, name).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1000, "b": 1000}
    assert B.read_table(spark, name).select("day").distinct().count() == 1000


def test_leftover_never_becomes_a_table(spark):
    name = "t_leftover"
    pairs(spark, [(1, "x", 0), (2, "y", 0)]).write.saveAsTable(f"{name}_staged_1")
    B.write_table(pairs(spark, [(3, "z", 0)]), name, mode="append")
    assert [r["k"] for r in B.read_table(spark, name).collect()] == [3]


def test_stopped_replacement_is_completed(spark):
    name = "t_stopped"
    B.write_table(pairs(spark, [(1, "x", 0)]), name)
    pairs(spark, [(2, "y", 0)]).write.saveAsTable(f"{name}_staged_1")
    spark.sql(f"ALTER TABLE {name}_staged_1 SET TBLPROPERTIES ('{B.REPLACES}' = '{name}')")
    spark.sql(f"DROP TABLE {name}")
    B._finish_replacement(spark, name)
    assert [r["k"] for r in B.read_table(spark, name).collect()] == [2]


def test_vacuum_keeps_untouched_partitions(spark):
    name = "t_vacuum"
    frame = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, p string, t int")
    B.write_table(frame, name, partition_by=["p"])
    for t in (1, 2, 3):
        B.upsert_table(spark.createDataFrame([(2, "b", t)], "k int, p string, t int"), name, ["k"])
    before = rows(B.read_table(spark, name))
    assert len(B.vacuum(spark, name, keep=0)) == 2
    assert rows(B.read_table(spark, name)) == before == [(1, "a", 0), (2, "b", 3)] or len(before) == 2


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;d\nA;1\n")
    (tmp_path / "b.csv").write_text("d;k\n2;B\n")
    contract = T.StructType([T.StructField("k", T.StringType()), T.StructField("d", T.IntegerType())])
    assert rows(C.read_with_contract(spark, str(tmp_path), contract)) == [("A", 1), ("B", 2)]
    (tmp_path / "c.csv").write_text("k\nC\n")
    with pytest.raises(ValueError):
        C.read_with_contract(spark, str(tmp_path), contract)


def test_newest_must_be_named(spark):
    twice = pairs(spark, [(1, "nine", 9), (1, "three", 3)])
    with pytest.raises(Exception):
        U.keep_latest(twice, ["k"]).collect()


def test_features_follow_the_changed_cases_only(spark, tmp_path):
    s = CASES.with_names(month="notified_month")
    names = daily.Tables(*[name(n) for n in ("cases", "beds", "ledger", "cfeat", "bfeat")])
    contract = case_contract(CASES)
    beds = [(1, 202505, "SP", 4, 1, 1), (1, 202506, "SP", 5, 1, 1)]
    shape = "facility_id int, comp int, state string, beds_adult int, beds_ped int, beds_neo int"
    B.write_table(spark.createDataFrame(beds, shape), names.beds)

    def run(file, lines, as_of, **options):
        (tmp_path / file).write_text("\n".join([HEADER, *lines]))
        daily.load_fresh_cases(spark, str(tmp_path), as_of, contract, names, s, **options)
        daily.build_features(spark, 202500, names, s)

    def files(table):
        found = B.read_table(spark, table).select("notified_month", F.col("_metadata.file_path").alias("f")).distinct()
        out = {}
        for month, path in sorted((str(r[0]), r[1]) for r in found.collect()):
            out.setdefault(month, []).append(path)
        return out

    def features():
        return rows(B.read_table(spark, names.case_features).select("case_id", "notified_on", "is_death", "notified_month"))

    run("INFLUD25-10-06-2025.csv", [line(1, "01/04/2025"), line(2, "02/05/2025"), line(3, "03/06/2025")], date(2025, 6, 10))
    before, whole = files(names.case_features), features()
    bed_files = B.read_table(spark, names.bed_features).select("_metadata.file_path").distinct().collect()
    # one case changes, one moves from May to June, one is new; none is of April
    second = [line(3, "03/06/2025", outcome=2), line(2, "05/06/2025"), line(4, "05/06/2025")]
    run("INFLUD25-11-06-2025.csv", second, date(2025, 6, 11))
    after, followed = files(names.case_features), features()
    assert after["2025-04-01"] == before["2025-04-01"] and "2025-05-01" not in after
    assert not set(after["2025-06-01"]) & set(before["2025-06-01"])
    assert [r[0] for r in followed] == ["1", "2", "3", "4"] and followed != whole
    assert B.read_table(spark, names.bed_features).select("_metadata.file_path").distinct().collect() == bed_files
    assert changes.pending(spark, names.cases).count() == 0
    # nothing new: nothing is written; a full build gives the same rows in other files
    daily.build_features(spark, 202500, names, s)
    assert files(names.case_features) == after
    daily.build_features(spark, 202500, names, s, full=True)
    assert features() == followed and files(names.case_features)["2025-04-01"] != before["2025-04-01"]
    # a build that stopped before it took the batch off the list is done again
    changes.record(B.read_table(spark, names.cases).filter("case_id = '1'"), names.cases)
    daily.build_features(spark, 202500, names, s)
    assert features() == followed and changes.pending(spark, names.cases).count() == 0


def test_inventories_that_change_are_summed_again(spark):
    names = daily.Tables(*[name(n) for n in ("cases", "beds", "ledger", "cfeat", "bfeat")])
    shape = "facility_id int, comp int, state string, beds_adult int, beds_ped int, beds_neo int"
    B.write_table(spark.createDataFrame([(1, 202505, "SP", 4, 1, 1), (2, 202505, "SP", 2, 0, 0), (1, 202506, "SP", 5, 1, 1)], shape), names.beds)
    B.write_table(with_case_rows(spark), names.cases)
    daily.build_features(spark, 202500, names)
    newer = spark.createDataFrame([(1, 202505, "SP", 9, 1, 1), (3, 202505, "RJ", 1, 1, 1)], shape)
    B.upsert_table(newer, names.beds, ["facility_id", "comp"], on_duplicate="error", before=lambda r: changes.record(r, names.beds))
    daily.build_features(spark, 202500, names)
    followed = rows(B.read_table(spark, names.bed_features))
    daily.build_features(spark, 202500, names, full=True)
    assert rows(B.read_table(spark, names.bed_features)) == followed and len(followed) == 3


def with_case_rows(spark):
    return cases(spark, [{"notified_on": "2025-06-01", "state": "SP"}])


def test_the_caller_names_what_makes_an_entry_newer(spark, tmp_path):
    names = daily.Tables(*[name(n) for n in ("cases", "beds", "ledger", "cfeat", "bfeat")])
    contract = T.StructType([*case_contract(CASES).fields, T.StructField("digitised_on", T.DateType())])
    lines = [f"{line(1, '01/06/2025', outcome=2)};05/06/2025", f"{line(1, '01/06/2025', outcome=1)};07/06/2025"]
    (tmp_path / "INFLUD25-10-06-2025.csv").write_text("\n".join([f"{HEADER};digitised_on", *lines]))
    daily.load_fresh_cases(spark, str(tmp_path), date(2025, 6, 10), contract, names, order_by=["notified_on", "digitised_on"])
    assert [r.outcome for r in B.read_table(spark, names.cases).collect()] == [1]  # the later entry, though its code is smaller


def test_streamed_files_are_bound_by_their_own_headers(spark, tmp_path):
    table, folder = name("cases"), tmp_path / "in"
    folder.mkdir()
    contract = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("on", T.DateType())])
    (folder / "a.csv").write_text("k;v;on\n1;one;01/02/2025\n2;\"two;and more\";x\n\n")
    (folder / "b.csv").write_text("\ufeffon;extra;v;k\n03/02/2025;e;three;3\n04/02/2025;e;;4\n5\n")
    (folder / "empty.csv").write_text("")
    (folder / "header.csv").write_text("v;k;on\n")

    def run(files_per_batch=None):
        lines = stream_lines(spark, str(folder), files_per_batch=files_per_batch)
        bind = lambda batch: C.bind_lines(batch, contract)
        incremental_ingest(lines, table, ["k"], checkpoint=str(tmp_path / "checkpoint"), bind=bind)
        return rows(B.read_table(spark, table))

    want = [(1, "one", day("2025-02-01")), (2, "two;and more", None), (3, "three", day("2025-02-03")), (4, None, day("2025-02-04"))]
    assert run() == [*want, (None, None, None)]
    (folder / "c.csv").write_text("v;on;k\nsix;06/02/2025;6\n")
    (folder / "d.csv").write_text("k;on;v\n1;09/02/2025;newer\n")
    got = run(files_per_batch=1)
    assert got[0] == (1, "newer", day("2025-02-09")) and (6, "six", day("2025-02-06")) in got and len(got) == 6
    (folder / "e.csv").write_text("k;v\n7;seven\n")
    with pytest.raises(Exception, match="missing"):
        run()
    assert len(rows(B.read_table(spark, table))) == 6
