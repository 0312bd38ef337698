"""Profiles, samples, dictionary, hits, pages and SQL on hand-made rows."""

import random
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from casewatch.functions import text as X
from casewatch.operators import dictionary as W, hits as H, quality as Q
from casewatch.plans.sql import query_sql
from tests.helpers import day, rows


def mixed(spark):
    data = [(i % 3 or None, f"v{i % 60}", date(2025, 1, 1 + i % 9), datetime(2025, 1, 1, i % 24), -0.0 if i % 2 else 0.0)
            for i in range(600)]
    return spark.createDataFrame(data, "a int, b string, d date, t timestamp_ntz, z double")


def test_profile(spark):
    got = {r.column: r for r in Q.profile(mixed(spark)).collect()}
    assert got["a"].null_count == 200 and got["a"].unique_count == 3
    assert got["a"].value_counts == {"1": 200, "2": 200}
    assert len(got["b"].value_counts) == 50 and got["b"].unique_count == 60
    assert (got["b"].min_value, got["d"].min_value, got["d"].max_value) == (None, "2025-01-01", "2025-01-09")
    assert got["t"].max_value == "2025-01-01 23:00:00"
    assert got["z"].unique_count == 1


def test_null_among_the_frequent_values_takes_a_place(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,)], "a int")
    assert Q.profile(df, max_categories=2).first().value_counts == {"1": 1}


def test_profile_of_odd_names_and_no_rows(spark):
    df = spark.createDataFrame([], "`a b` int, `c.d` string")
    assert Q.value_ranges(df).first().min_value is None
    assert Q.null_counts(df).count() == 2


def test_duplicates_by_both_ways(spark):
    rng = random.Random(1)
    data = [(rng.choice([None, 1, 2]), rng.choice(["x", "y", None])) for _ in range(50)]
    df = spark.createDataFrame(data, "a int, b string")
    want = {(a, b, n) for (a, b), n in Counter(data).items() if n > 1}
    assert set(rows(Q.duplicate_rows(df))) == set(rows(Q.duplicate_rows(df, by_hash=True))) == want
    assert rows(Q.duplicate_keys(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k")) == [(1, 2)]


def test_null_counts_are_ordered(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 1, 1)], "a int, b int, c int")
    assert [tuple(r) for r in Q.null_counts(df).collect()] == [("a", 2), ("c", 1), ("b", 0)]


def test_keyed_sample_is_the_same_however_the_input_is_split(spark):
    df = spark.range(20_000)
    one = rows(Q.sample_rows(df.repartition(2), 0.1, by_key="id"))
    assert one == rows(Q.sample_rows(df.repartition(7), 0.1, by_key="id"))
    assert 1800 < len(one) < 2200
    assert one != rows(Q.sample_rows(df, 0.1, seed=7, by_key="id"))
    assert 1600 < Q.sample_rows(df, 0.1).count() < 2400


# Dictionary ------------------------------------------------------------------

def test_stitch(spark):
    df = spark.createDataFrame(
        [(1, i, k, t) for i, (k, t) in enumerate([("A", "x"), ("", "y"), (None, "z"), ("B", "w")])],
        "doc int, pos int, key string, text string",
    )
    got = W.stitch_rows(df, "doc", "pos", "key", ["text"])
    assert rows(got.select("key", "text")) == [("A", "x y z"), ("B", "w")]


@pytest.mark.parametrize("chunk", [1, 3, 10, 10_000])
def test_stitch_equals_a_plain_loop_for_any_chunk(spark, chunk):
    rng = random.Random(chunk)
    data, want = [], {}
    for doc in range(6):
        current = None
        for pos in range(80 if doc else 400):
            key = f"k{pos}" if rng.random() < 0.15 else rng.choice(["", "  ", None])
            a, b = f"a{pos}", f"b{pos}"
            data.append((doc, pos, key, a, b))
            if key and key.strip():
                current = (doc, pos)
                want[current] = (key, [a], [b])
            elif current:
                want[current][1].append(a)
                want[current][2].append(b)
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc int, pos int, key string, a string, b string")
    got = W.stitch_rows(df, "doc", "pos", "key", ["a", "b"], chunk=chunk)
    expected = {(d, p, k, " ".join(a), " ".join(b)) for (d, p), (k, a, b) in want.items()}
    assert set(rows(got.select("doc", "pos", "key", "a", "b"))) == expected


def test_dictionary(spark):
    df = spark.createDataFrame([("A", "one\n   two"), ("B", "x")], "code string, text string")
    extra = spark.createDataFrame([("Z", "written")], "column string, description string")
    got = W.column_dictionary(df, ["A", "Q"], "code", "text", extra)
    assert rows(got) == [("A", "one two"), ("Z", "written")]
    names = spark.createDataFrame([("A",), ("Q",), ("Q",)], "n string")
    assert rows(W.missing_descriptions(names, df, "code")) == [("Q",)]
    assert rows(W.column_dictionary(df, names, "code", "text")) == [("A", "one two")]


# Hits ------------------------------------------------------------------------

def test_hits_get_their_own_text(spark):
    hits = spark.createDataFrame(
        [("t", f"u{i}", f"title {i}", day("2025-03-01"), i) for i in range(4)]
        + [("t", "old", "old", day("2025-01-01"), 99), ("s", "u1", "other", day("2025-03-01"), 1)],
        "topic string, url string, title string, published_on date, score int",
    )
    extracts = spark.createDataFrame([("u1", "one"), ("u2", "two"), ("zz", "no")], "url string, raw_content string")
    failed = spark.createDataFrame([("u3",)], "url string")
    got = H.enrich_hits(hits, extracts, failed, date(2025, 3, 10), max_results=3)
    assert rows(got.select("topic", "url", "content")) == [("s", "u1", "one"), ("t", "u1", "one"), ("t", "u2", "two")]
    more = H.enrich_hits(hits, extracts, failed, date(2025, 3, 10), max_results=4)
    assert ("u0", None) in rows(more.select("url", "content"))


# Pages -----------------------------------------------------------------------

@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h1>A</h1><H3 class=x>B</H3>", "# A\n\n### B"),
        ("<ul><li>one</li><li>two</li></ul>", "- one\n- two"),
        ('see <a class="k" href="http://x/y">this</a>', "see [this](http://x/y)"),
        ("<b>x</b> <strong>y</strong> <em>z</em>", "**x** **y** *z*"),
        ("<script>var t='</p>';</script>text<!-- <b>no</b> -->", "text"),
        ("<style>p{}</style><p>a</p><p>b<br/>c</p>", "a\n\nb\nc"),
        ("a &lt; b &amp;lt; c&nbsp;&quot;d&quot;", 'a < b &lt; c "d"'),
        ("<table><tr><th>UF</th><th>%</th></tr><tr><td>SP</td><td>50</td></tr></table>", "| UF | % |\n| SP | 50 |"),
        ("<body><blockquote>q</blockquote></body>", "q"),
        ("  \n\n ", ""),
    ],
)
def test_markdown(spark, html, markdown):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.html_to_markdown("html")).first()[0] == markdown


def test_object_path(spark):
    url = "https://s3.sa-east-1.amazonaws.com/bucket/a/b.csv"
    assert spark.range(1).select(X.to_object_path(F.lit(url))).first()[0] == "s3a://bucket/a/b.csv"


# SQL -------------------------------------------------------------------------

def test_query_sql_reads_only(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert query_sql(spark, "SELECT id FROM numbers ORDER BY id DESC;").count() == 5
    assert [r.id for r in query_sql(spark, "SELECT id FROM numbers ORDER BY id DESC", 2).collect()] == [9, 8]
    assert query_sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x -- note").first().a == 1
    assert query_sql(spark, "SELECT id FROM numbers WHERE id = :n", args={"n": 3}).first().id == 3
    for text in (
        "DROP VIEW numbers", "INSERT INTO numbers SELECT 1", "CREATE TABLE zz AS SELECT 1 AS a",
        "WITH x AS (SELECT 1) INSERT INTO numbers SELECT * FROM x", "SELECT 1) AS a; DROP VIEW numbers; --",
    ):
        with pytest.raises(Exception):
            query_sql(spark, text)
    assert spark.table("numbers").count() == 10


# Sketches and positions ----------------------------------------------------------------

def test_sketched_profile_counts_exactly_what_it_names(spark):
    rng = random.Random(2)
    hot = [f"hot{i}" for i in range(5)]
    data = [(i, hot[i % 5] if i % 3 else f"cold{i}", rng.randrange(4), [i % 2], None if i % 4 else float(i)) for i in range(12_000)]
    df = spark.createDataFrame(data, "id long, name string, `a b` int, parts array<int>, x double")
    exact = {r["column"]: r for r in Q.profile(df, 3).collect()}
    got = {r["column"]: r for r in Q.sketched_profile(df, 3, exact_below=1000, rsd=0.02, tracked=256).collect()}
    assert {c: r.exact for c, r in got.items()} == {"id": False, "name": False, "a b": True, "parts": True, "x": False}
    for c, r in got.items():
        want = exact[c]
        assert (r.null_count, r.min_value, r.max_value) == (want.null_count, want.min_value, want.max_value)
        if r.exact:
            assert (r.unique_count, r.value_counts) == (want.unique_count, want.value_counts)
        assert abs(r.unique_count - want.unique_count) <= 0.06 * want.unique_count
    assert got["name"].value_counts == exact["name"].value_counts and len(got["name"].value_counts) == 3
    assert Q.sketched_profile(df.limit(0), 3).count() == Q.profile(df.limit(0), 3).count()
    everything = Q.sketched_profile(df, 3, exact_below=10**9)
    assert sorted(everything.drop("exact", "value_counts").collect()) == sorted(Q.profile(df, 3).drop("value_counts").collect())


def test_sample_by_position_does_not_depend_on_the_split(spark, tmp_path):
    spark.range(20_000).selectExpr("id div 2 as k").repartition(3).write.parquet(f"{tmp_path}/t")
    found = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.read.parquet(f"{tmp_path}/t")
        found.append((df.rdd.getNumPartitions(), sorted(r.k for r in Q.sample_rows(df, 0.1, by_position=True).collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (few, one), (many, other) = found
    assert few != many and one == other and 1700 < len(one) < 2300
    assert len(set(one)) > 0.9 * len(one)  # equal rows are drawn one by one
    assert Q.sample_rows(spark.read.parquet(f"{tmp_path}/t"), 0.1, seed=7, by_position=True).count() != 0
