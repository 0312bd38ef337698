"""Hard negatives, vector codes and license scans against plain Python, with every odd case."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewatch.llm import codes, licenses, negatives
from casewatch.llm.registry import QUERIES
from tests.helpers import rows as sorted_rows

# Extra columns with names that operators use inside.
SHAPE = (
    "vec_id long, embedding array<float>, label int, cell long, anchor long, `key` int, v int, code string, "
    "error long, score long, pivots int, _label int, p_ids int"
)
FILLER = (1, 2, 3, 4, "x", 5, 6, 7, 8, 9)


def vectors(seed, n, width, labels):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, -0.25, 0.0, 0.125, 0.5)) for _ in range(width)], rng.choice(labels)) for i in range(n)]
    hot = rows[7]
    rows += [hot] * (n // 3)  # one row holds a third of the table
    rows += [(hot[0], rows[9][1], hot[2]), (hot[0], rows[9][1], 8)]  # one id, other vectors and labels
    rows += [(n, None, 1), (n + 1, [1.0, None], 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] * width, 2)]
    rows += [(n + 4, [], 1), (n + 5, rows[3][1][:2], 1), (n + 6, rows[3][1], None), (-50, rows[2][1], 2), (-7, rows[0][1], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([r + FILLER for r in rows], SHAPE).repartition(5)


def whole_numbered(rows, scale, width):
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            v = [math.floor(scale * x) for x in vector]
            yield vec_id, tuple(v + [0] * (width - len(v))), label


# Hard negatives --------------------------------------------------------------------

def brute_negatives(rows, width, positives, n, low, high):
    known = {r for r in whole_numbered(rows, 256, width) if r[0] is not None and r[2] is not None}
    out = []
    for anchor_id, a, label in known:
        if anchor_id % 50:
            continue
        scores = {(sum(x * y for x, y in zip(a, v)), i, other == label) for i, v, other in known if i != anchor_id}
        ranked = sorted(scores, key=lambda s: (-s[0], s[1]))
        for p, p_id, _ in [s for s in ranked if s[2]][:positives]:
            fit = [s for s in ranked if not s[2] and low * p <= 100 * s[0] <= high * p]
            out += [(anchor_id, p_id, rank, i, p, s) for rank, (s, i, _) in enumerate(fit[:n], 1)]
    return sorted_tuples(out)


def sorted_tuples(rows):
    return sorted(rows, key=lambda r: tuple((c is None, str(c)) for c in r))


@pytest.mark.parametrize("cells", [None, (3, 40)])
def test_hard_negatives(spark, monkeypatch, cells):
    if cells:  # many small cells give the same rows as one
        monkeypatch.setattr(negatives, "ANCHORS", cells[0])
        monkeypatch.setattr(negatives, "ROWS", cells[1])
    rows = vectors(1, 260, 6, (1, 2, 3)) + [(None, [0.5] * 6, 1)]
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted_rows(got)
    assert got == brute_negatives(rows, 6, 5, 3, 50, 95) and len(got) > 30


def test_negatives_of_positives_that_score_zero_or_less(spark):
    rows = [(0, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (3, [0.0, 2.0], 2), (12, [0.0, 3.0], 2), (5, [-1.0, 0.0], 1), (6, [-0.7, 0.0], 2)]
    got = sorted_rows(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0))
    assert got == [(0, 9, 1, 3, 0, 0), (0, 9, 2, 12, 0, 0)]  # at zero those of zero, also with smaller ids; below zero none


def test_negatives_of_huge_components_are_exact(spark):
    big = 2.0**22
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, -1.0], 1), (3, [big * 0.75, 0.0], 2), (4, [big * 0.75, 2.0], 2)]
    got = sorted_rows(negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0))
    assert got == brute_negatives(rows, 2, 5, 3, 50, 95) and len(got) == 4


def test_negatives_without_rows_or_partners(spark):
    assert not negatives.hard_negatives(spark.createDataFrame([], SHAPE), F.col("vec_id") == 0).collect()
    one = frame(spark, [(0, [1.0], 1)])
    assert not negatives.hard_negatives(one, F.col("vec_id") == 0).collect()
    assert not negatives.hard_negatives(one, F.col("vec_id") == 1).collect()


# Vector codes ------------------------------------------------------------------------

def brute_codes(rows, width, parts, entries, rounds):
    known = sorted(whole_numbered(rows, 1024, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // parts
    cut = [[r[1][i * d : (i + 1) * d] for r in known] for i in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def assign(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for i in range(parts):
            members = defaultdict(list)
            for part in cut[i]:
                members[assign(part, books[i])[1]].append(part)
            for k, ps in members.items():
                books[i][k] = tuple(sum(x) // len(ps) for x in zip(*ps))
    out = []
    for at, (vec_id, _, label) in enumerate(known):
        near = [assign(cut[i][at], books[i]) for i in range(parts)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in near), sum(e for e, _ in near)))
    total = defaultdict(int)
    for _, label, _, error in out:
        total[label] += error
    return sorted_tuples([(*r, total[r[1]]) for r in out]), books


@pytest.mark.parametrize("n,width,entries,rounds", [(230, 8, 16, 4), (30, 8, 256, 2), (90, 4, 20, 0)])
def test_vector_codes(spark, n, width, entries, rounds):
    rows = vectors(n, n, width, (1, 2)) + [(None, [0.25] * width, 2), (None, [0.25] * width, None)]
    coded, book = codes.vector_codes(frame(spark, rows), parts=4, entries=entries, rounds=rounds)
    want, books = brute_codes(rows, width, 4, entries, rounds)
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted_rows(coded) == want
    assert [[tuple(e) for e in b] for b in book.tolist()] == books


def test_a_length_that_the_parts_do_not_divide_is_filled_up(spark):
    rows = [(i, [i / 7, -i / 5, i / 3], 1) for i in range(20)]
    padded = [(i, [*v, 0.0], label) for i, v, label in rows]
    plain, filled = (codes.vector_codes(frame(spark, r), parts=2, entries=5)[0] for r in (rows, padded))
    assert sorted_rows(plain) == sorted_rows(filled)


def test_codes_of_an_empty_table(spark):
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        coded, book = codes.vector_codes(frame(spark, rows) if rows else spark.createDataFrame([], SHAPE))
        assert not coded.collect() and book.size == 0


def test_pivots_spare_evaluations_and_lose_no_tie():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (256, 4))
    parts = centres[rng.integers(0, 256, 700)] + rng.integers(-30, 30, (700, 4))
    entries = np.concatenate([centres[:200], centres[:56]])  # repeated entries: ties go to the lower index
    pivots = codes.far_apart(entries, codes.PIVOTS)
    to_pivots = codes.distances(parts, pivots).astype(np.float32).astype(np.float64)
    code, best, evaluated = codes.nearest(parts, to_pivots, entries, codes.distances(entries, pivots))
    exact = ((parts[:, None] - entries) ** 2).sum(axis=2)
    assert (code == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert evaluated < exact.size / 5


# License scans -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_scan(text, phrases, notices, percent):
    words = WORD.findall(lower(text))
    places = []
    for phrase, label in phrases:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    labels, share = {label for _, label in places}, 0.0
    for notice, label in notices:
        tokens, n = set(notice.split()), len(notice.split())
        stride = 1
        while stride < n:
            stride *= 2
        for start in range(0, max(len(words), 1), stride):
            held = len(tokens & set(words[start : start + 2 * stride]))
            if held * 100 >= percent * len(tokens):
                labels.add(label)
                share = max(share, held / len(tokens))
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else share,
    )


DOCS = (
    "doc_id long, text string, row int, words string, segments int, hits int, w string, k int, label string, "
    "start int, need int, places int, mask long"
)


def license_texts():
    rng = random.Random(9)
    vocabulary = [w for text, _ in licenses.NOTICES for w in text.split()] + ["filler", "wort", "été", "日本"]

    def mixed(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def noisy(notice, drop):
        return " ".join(w for w in notice.split() if rng.random() >= drop)

    texts = [None, "", " \n.;", "MIT License", "the (MIT) licenſe, mit\nLICENSE! CC-BY cc_by CC BY cc by cc by"]
    texts += ["apache licenses apache license", "gnu general public", "GNU general public license, v3 and Apache-License", "mit licenŞe"]
    texts += ["worK under the mit license", "K released İ under mit", "x" * 100_000, "cc by " * 3000]
    for notice, _ in licenses.NOTICES:
        texts += [notice.upper(), mixed(rng.randrange(70)) + " " + noisy(notice, 0.15) + ". " + mixed(rng.randrange(200))]
        texts += ["-".join(noisy(notice, 0.25).split())]
    texts += [mixed(3) for _ in range(20)] + [mixed(500) for _ in range(5)] + ["filler " * 60 + licenses.NOTICES[0][0]]
    return texts


def test_license_scan(spark):
    texts = license_texts()
    rows = list(enumerate(texts)) + [(3, texts[3])] * 40 + [(None, texts[4]), (None, None)]
    filler = (1, "a", 2, 3, "b", 4, "c", 5, 6, 7, 8)
    docs = spark.createDataFrame([r + filler for r in rows], DOCS).repartition(4)
    got = licenses.license_scan(docs)
    assert got.columns == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    ]
    want = [(doc_id, *brute_scan(text, licenses.PHRASES, licenses.NOTICES, 80)) for doc_id, text in rows]
    assert sorted_rows(got) == sorted_tuples(want)
    assert any(w[6] and not w[5] for w in want)  # notices without a phrase


@pytest.mark.parametrize("percent", [1, 50, 100])
def test_license_scan_at_other_shares(spark, percent):
    notices = (("a b c d e", "x"), ("c d", "y"), ("a a a b", "z"), ("e", "w"))
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(60)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), (("a b", "p"), ("h", "q")), notices, percent)
    assert sorted_rows(got) == sorted_tuples([(i, *brute_scan(t, (("a b", "p"), ("h", "q")), notices, percent)) for i, t in rows])


def test_a_text_of_megabytes_is_scanned_in_linear_time(spark):
    text = "plain words released under und so weiter " * 60_000 + "released under the mit license"
    (row,) = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_words == 420_005 and row.n_base == 1 and row.first_word == 420_003 and "mit-notice" in row.labels


def test_license_scan_of_an_empty_table(spark):
    assert not licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect()


# The registered queries ------------------------------------------------------------------

@pytest.mark.parametrize("name,columns", [
    ("op11_negatives", "anchor_id:bigint,positive_id:bigint,rank:int,negative_id:bigint,positive_score:bigint,negative_score:bigint"),
    ("op12_codes", "vec_id:bigint,code:string,error:bigint,label_error:bigint,codebooks_sha256:string"),
    ("op13_licenses", "doc_id:bigint,n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double"),
])
def test_registered_queries_give_the_asked_columns(spark, tmp_path, name, columns):
    frame(spark, vectors(5, 120, 64, (0, 9))).write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = spark.createDataFrame(list(enumerate(license_texts())), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert ",".join(f"{n}:{t}" for n, t in df.dtypes) == columns
    assert df.count() > 0
