"""Dictionary, page and report texts, and ad-hoc SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from casewatch.functions import text as X
from casewatch.operators import dictionary as W
from casewatch.operators.hits import enrich_hits as enrich
from casewatch.plans.fixtures import CASES_SQL, load, load_cases
from casewatch.plans.registry import query
from casewatch.plans.sql import query_sql as ask
from casewatch.sources.reports import find_report


def markdown_sql(column: str) -> str:
    """The page clean-up as nested SQL calls."""

    def patterns(sql, steps):
        for pattern, replacement in steps:
            literal = replacement.replace("$1", r"\1").replace("$2", r"\2")
            sql = f"regexp_replace({sql}, '{pattern}', '{literal}', 'g')"
        return sql

    def texts(sql, steps):
        for plain, replacement in steps:
            sql = f"replace({sql}, '{plain}', '{replacement}')"
        return sql

    sql = texts(patterns(column, X.MARKDOWN_TAGS), X.MARKDOWN_TEXTS)
    sql = texts(patterns(sql, X.MARKDOWN_RUNS), X.MARKDOWN_LINE_ENDS)
    return f"trim({patterns(sql, X.MARKDOWN_PARAGRAPHS)}, '{X.BLANKS}')"


@query("""with t as (select *, sum(case when role <> 'assistant' then 1 else 0 end)
  over (partition by conv_id order by turn) as g from conversations)
select conv_id, min(turn) as turn, max(case when role <> 'assistant' then role end) as role,
  string_agg(text, ' ' order by turn) as text from t where g > 0 group by conv_id, g""")
def stitch_rows(spark, sf_dir):
    """Answers continue the turn before them."""
    turns = load(spark, sf_dir, "conversations").withColumn(
        "role", F.when(F.col("role") != "assistant", F.col("role"))
    )
    return W.stitch_rows(turns, "conv_id", "turn", "role", ["text"])


DICTIONARY_SQL = """select source as "column", regexp_replace(text, '\\n\\s*', ' ', 'g') as description
from documents where {where}
union all select n_name, r_name from nation join region on n_regionkey = r_regionkey"""


def written(spark, sf_dir):
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_name").alias("column"), F.col("r_name").alias("description"))


@query(DICTIONARY_SQL.format(where="source in ('src0', 'src1', 'src2')"))
def column_dictionary(spark, sf_dir):
    """Descriptions of listed codes, plus further ones."""
    documents = load(spark, sf_dir, "documents")
    return W.column_dictionary(
        documents, ["src0", "src1", "src2"], "source", "text", written(spark, sf_dir)
    )


@query("""select doc_id as "column" from documents where doc_id not in (select doc_id from labels)""")
def missing_descriptions(spark, sf_dir):
    """Names without an entry in another table."""
    names = load(spark, sf_dir, "documents").select("doc_id")
    return W.missing_descriptions(names, load(spark, sf_dir, "labels"), "doc_id")


HITS_SQL = """hits as (select url, regexp_extract(url, '/(en|de|fr|es)/', 1) as topic,
  date '2024-01-01' + cast(length(html) % 60 as int) as published_on, length(html) as score from pages),
top as (select *, row_number() over (partition by topic order by score desc, url) as position from hits
  where published_on > date '2024-01-22' and published_on <= date '2024-02-21')
select t.topic, t.url, t.score, cast(t.position as int) as position, p.content
from top t left join (select url, html as content from pages where html like '%<article%') p on p.url = t.url
where position <= 5 and t.url not in (select url from pages where url like '%utm_source%')"""


@query(f"with {HITS_SQL}")
def enrich_hits(spark, sf_dir):
    """Best recent pages per language with their text; tracked URLs failed."""
    pages = load(spark, sf_dir, "pages")
    hits = pages.select(
        "url",
        F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("topic"),
        F.date_add(F.lit(date(2024, 1, 1)), F.length("html") % 60).alias("published_on"),
        F.length("html").cast("bigint").alias("score"),
    )
    extracts = pages.filter(F.col("html").contains("<article")).select("url", F.col("html").alias("raw_content"))
    failed = pages.filter(F.col("url").contains("utm_source")).select("url")
    top = enrich(hits, extracts, failed, date(2024, 2, 21))
    return top.select("topic", "url", "score", "position", "content")


@query(f"select page_id, {markdown_sql('html')} as markdown from pages")
def html_to_markdown(spark, sf_dir):
    """Every page as Markdown."""
    return load(spark, sf_dir, "pages").select("page_id", X.html_to_markdown("html").alias("markdown"))


@query(f"""with r as (select url as path, {markdown_sql('html')} as content,
  date '2024-01-01' + cast(page_id as int) as report_on from pages)
select true as "exists", path, content, 'Report of 2024-02-01 found, returned as Markdown.' as message
from r where report_on = date '2024-02-01'""")
def report_lookup(spark, sf_dir):
    """The page of a day as a stored report."""
    reports = load(spark, sf_dir, "pages").select(
        F.col("url").alias("path"),
        F.date_add(F.lit(date(2024, 1, 1)), F.col("page_id").cast("int")).alias("report_on"),
        "html",
    )
    return find_report(reports, date(2024, 2, 1))


QUESTION = """select outcome, count(*) as n, count(icu_in) as stays from {cases}
where vac_covid = 1 group by outcome order by n desc, outcome"""


@query(f"with {CASES_SQL} {QUESTION.format(cases='cases')} limit 5")
def query_sql(spark, sf_dir):
    """A question in SQL over the case view, capped at five rows."""
    load_cases(spark, sf_dir).createOrReplaceTempView("casewatch_cases")
    return ask(spark, QUESTION.format(cases="casewatch_cases"))
