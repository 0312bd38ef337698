"""The pipeline on a whole given table, each stage against plain Python on its own input."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from casewatch.session import stage
from tests.llm.test_text_operators import WORD, luhn, plain_components, plain_spans, plain_targets, whole_ids  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF_DIR)))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_are_the_dealt_ones(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_rejected_documents_go(steps):
    given, kept = by_id(steps[0]), by_id(steps[1])
    for i, r in given.items():
        w = WORD.findall(r["text"] or "")
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        if len(w) < 10 or 100 * len(covered) > 20 * len(w):
            assert i not in kept
    assert all(tuple(given[i]) == tuple(r) for i, r in kept.items())
    assert len(kept) > 0.7 * len(given)


def test_one_document_of_each_group_stays(steps):
    given = steps[1].select("doc_id", "text").collect()
    groups = plain_components([tuple(r) for r in given])
    assert set(by_id(steps[2])) == {component for _, _, component in groups}


def test_personal_data_is_replaced(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_spans(r["text"])
        assert r["n_chars"] == len(r["text"])
        if not plain_spans(before[i]["text"]):
            assert r["text"] == before[i]["text"]


def test_mix_takes_whole_documents(steps):
    given, taken = by_id(steps[3]), Counter(r["doc_id"] for r in steps[4].collect())
    assert max(taken.values()) <= 2 and set(taken) <= set(given)
    size = {i: len(WORD.findall(r["text"] or "")) for i, r in given.items()}
    sizes, got, largest = Counter(), Counter(), Counter()
    for i, r in given.items():
        sizes[r["source"]] += size[i]
        got[r["source"]] += taken[i] * size[i]
        largest[r["source"]] = max(largest[r["source"]], size[i])
    for source, want in plain_targets(sizes).items():
        assert abs(got[source] - want) <= largest[source] / 2 + 1


def test_every_token_is_packed(steps):
    texts = Counter(r["text"] for r in steps[4].collect())
    ids = {t: x + [2] for t, x in zip(texts, whole_ids(list(texts)))}
    want = sum(len(ids[t]) * n for t, n in texts.items())
    pieces = steps[5].collect()
    assert sum(p["length"] for p in pieces) == want
    fill = Counter()
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
        assert len(np.frombuffer(p["ids"], "<u4")) == p["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_pipeline_survives_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = docs.limit(5).unionByName(docs.limit(5)).selectExpr(
        "nullif(doc_id, 1) AS doc_id", "if(doc_id = 2, null, text) AS text", "nullif(lang, 'en') AS lang",
        "cast(null AS string) AS source", "n_chars", "1 AS `key`", "2 AS n", "3 AS row", "4 AS kept",
    )
    for given in (odd, odd.limit(0)):
        out = given
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = stage(step(spark, out, SF_DIR))
            assert out.columns == given.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF_DIR).count() >= 0
