"""The numbered operators as queries over the whole tables of a folder."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import (
    codes, languages, licenses, mixing, neardup, negatives, packing, privacy, quality, records, substrings, topk, toxicity,
)
from casewatch.llm.tokens import default_path
from casewatch.llm.vectors import held_out
from casewatch.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Always a sort-merge join: what it moves then grows with the documents, not by leaps with the labels' size.
    learnt = labels.where(~held_out("doc_id", 5, 0)).select("doc_id", "toxic").hint("merge")
    known = docs.where(~held_out("doc_id", 5, 0)).select("doc_id", "text").join(learnt, "doc_id")
    scored = toxicity.score(docs, toxicity.train(known))
    return scored.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a record of token ids, and read back."""
    files = records.write_records(table(spark, sf_dir, "documents"), default_path(), end_id=1)
    return records.read_records(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    taken = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)
    return taken.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


@query("""with recursive words as (select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_have
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * both_have >= 80 * (p.n + q.n - both_have)),
edges as (select x, y from links union all select y, x from links),
reached(doc_id, other) as (select doc_id, doc_id from documents
  union select reached.doc_id, y from reached join edges on other = x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from (select doc_id, min(other) as component_id from reached group by doc_id) left join sizes using (doc_id)""")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=80)


@query()
def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    rows = stage(privacy.spotted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = privacy.with_spans(rows, privacy.learn(rows))
    return out.select(
        "doc_id",
        *(privacy.count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(privacy.KINDS)),
        F.sha2(privacy.listed("base"), 256).alias("base_sha256"),
        privacy.listed("spans").alias("spans"),
    )


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    rows = stage(quality.measured(docs).drop("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judged(rows, quality.thresholds(rows)).select("doc_id", *counts, "base_failed", "kept")


@query("""with rows as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from pairs qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5""")
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens along the curve."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), default_path(), end_id=2, size=4096)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = languages.learn_profiles(docs.where(~held_out("doc_id", 4, 2)))
    said = languages.identify(docs, prototypes)
    return said.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query()
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of fifty bytes that an earlier one has."""
    left = substrings.without_repeats(table(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("""with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as positive,
  list_inner_product(a.v, c.v)::bigint as score
  from rows a join rows c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from pairs where positive
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join (select * from pairs where not positive) using (anchor_id)
where 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3""")
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth vector, with every seventh vector under another label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def _codes_sql(rounds: int) -> str:
    """Rounds of assignment and means in plain SQL; distances of whole numbers are exact in a double."""
    square = "list_inner_product(p, p)"
    steps = ["""rows as (select row_number() over (order by vec_id) as r, vec_id, label,
  list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] as p
  from rows, (select unnest([0, 1, 2, 3]) as part)),
book0 as materialized (select part, r - 1 as entry, p from parts where r <= 256)"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} as materialized (select r, part, any_value(parts.p) as p,
  min(({square.replace('p, p', 'parts.p, parts.p')} + {square.replace('p, p', 'b.p, b.p')}
    - 2 * list_inner_product(parts.p, b.p))::bigint * 256 + entry) as best
  from parts join book{i} b using (part) group by r, part)""")
        if i < rounds:
            steps.append(f"""book{i + 1} as materialized (select part, entry, coalesce(m.p, b.p) as p from book{i} b left join (
  select part, entry, list(x order by step) as p from (
    select part, best % 256 as entry, step, floor(sum(p[step]) / count(*)) as x
    from near{i}, (select unnest(generate_series(1, (select max(len(p)) from parts))) as step) group by 1, 2, 3)
  group by 1, 2) m using (part, entry))""")
    return f"""with {", ".join(steps)},
coded as (select vec_id, label, string_agg(printf('%02x', best % 256), '' order by part) as code,
  sum(best // 256)::bigint as error from near{rounds} join rows using (r) group by r, vec_id, label),
book as (select sha256(string_agg(x, ',' order by part, entry)) as codebooks_sha256 from (
  select part, entry, array_to_string(list_transform(p, lambda x: x::bigint), ',') as x from book{rounds}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from coded, book"""


@query(_codes_sql(rounds=4))
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four codebooks of 256 entries, after four rounds."""
    coded, books = codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _licenses_sql(percent: int) -> str:
    """Phrases place by place, and every block of every notice against its words."""
    phrases = " or ".join(
        f"(label = '{label}' and " + " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(licenses.words_of(text), 1)) + ")"
        for text, label in licenses.PHRASES
    )
    bases = ", ".join(f"('{label}')" for _, label in licenses.PHRASES)
    notices = ", ".join(
        f"({at}, '{t.label}', {t.stride}, {t.need}, {len(t.tokens)}, [{', '.join(repr(w) for w in t.tokens)}])"
        for at, t in enumerate(licenses.templates(licenses.NOTICES, percent, {}))
    )
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""with docs as (select doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from documents),
notices(notice, label, stride, need, n, tokens) as (values {notices}),
bases(label) as (values {bases}),
places as (select doc_id, label, i from (select doc_id, words, unnest(range(len(words))) as i from docs), bases where {phrases}),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
  string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id),
tokens as (select notice, label, stride, need, n, unnest(tokens) as w from notices),
hits as (select doc_id, unnest(words) as w, unnest(range(len(words))) as i from docs),
blocks as (select doc_id, label, count(distinct w) / n as share
  from hits join tokens using (w), (select unnest([0, 1]) as back) where i // stride >= back
  group by doc_id, notice, label, need, n, i // stride - back having count(distinct w) >= need),
best as (select doc_id, max(share) as share from blocks group by doc_id),
all_labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from places union all select doc_id, label from blocks) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
  first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1e0 else coalesce(share, 0e0) end as score
from docs left join base using (doc_id) left join best using (doc_id) left join all_labels using (doc_id)"""


@query(_licenses_sql(percent=80))
def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"), percent=80)
