"""The text operators against plain Python on small tables with every odd case."""

import hashlib
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from casewatch.llm import languages, mixing, neardup, packing, privacy, quality, records, substrings, topk, toxicity
from casewatch.llm.buffers import Texts, slices
from casewatch.llm.components import components
from casewatch.llm.tokens import Encoder, default_path
from casewatch.llm.vectors import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns with names that operators use inside.
SHAPE = (
    "doc_id long, text string, lang string, source string, score double, n int, `class` long, token long, row int, "
    "size long, kept boolean, n_words int, bucket int, `key` long, base int, tie long, pack long"
)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.split()
    near[60] = "Other"
    return [
        None, "", "   \n\t ", "one", "One two", "a b c d e", base, base, base.upper(), " ".join(near),
        words(rng, 40) + "\n\n" + words(rng, 8), "x" * 3000, "ab " * 400, "Ünï çödé — 日本語 テスト 😀 é", words(rng, 6000),
        "mail a.b@c.de_x@y.org, 10.0.0.255 or 999.1.1.1; 4111 1111 1111 1111 +49 (30) 123456-78\n" * 2, "\x1c\x85\xa0 nbsp", "#$% <|endoftext|>",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "ü"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[6], None, None), (None, None, "en", "s1"), (None, "only here once more", "en", "s1")]
    filler = (0.5, 1, 2, 3, 4, 5, True, 6, 7, 8, 9, 10, 11)
    return spark.createDataFrame([r + filler for r in rows], SHAPE).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def whole_ids(texts):
    said = Encoder.of(default_path()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [s.ids for s in said]


# Tokens and records --------------------------------------------------------------

def test_pieces_give_the_ids_of_whole_texts():
    texts = [t or "" for t in odd_texts()] + ["H̱ello ́x", "It's, x'S ÉCOLE!! a×b ..a. ß.", "ΣΑΣ İst ﬁ １２ x²", "É", "a\x00b"]
    encoder = Encoder.of(default_path())
    assert encoder.by_piece
    for a, b, part in slices(pa.array(texts), limit=200):
        ids, ends = encoder.encode(part)
        assert [list(ids[ends[i] : ends[i + 1]]) for i in range(b - a)] == whole_ids(texts[a:b])


def test_checksum_is_the_published_one():
    data = np.frombuffer(b"123456789" + bytes(32) + bytes(range(256)) * 3, np.uint8)
    got = records.crc32c(data, np.array([0, 9, 41]), np.array([9, 32, 768]))
    assert hex(got[0]) == "0xe3069283" and hex(got[1]) == "0x8a9136aa"


def test_records_come_back_in_order(spark, docs, empty):
    manifest = records.write_records(docs, default_path(), end_id=1)
    got = records.read_records(manifest).collect()
    want = collected(docs)
    ids = dict(zip([t for _, t in want], whole_ids([t for _, t in want])))
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == Counter(
        (i, zlib.crc32(np.array(ids[t] + [1], "<u4").tobytes())) for i, t in want
    )
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in ordered] == sorted(r["doc_id"] is not None for r in ordered)
    assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(i for i, _ in want if i is not None)
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    file = max(manifest.collect(), key=lambda r: r["n_records"])
    _, some = records.fetch_record(file["path"], file["n_records"] - 1)
    assert some[-1] == 1
    fs, path = records.filesystem(file["path"])
    data = bytearray(fs.open_input_stream(f"{path}.rec").read())
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(np.frombuffer(bytes(data), np.uint8), np.array([0]))
    assert records.read_records(records.write_records(empty, default_path(), end_id=1)).count() == 0


# Packing ---------------------------------------------------------------------------

def test_curve_moves_one_step_at_a_time():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        order = np.argsort(packing.hilbert(cells, bits))
        assert sorted(packing.hilbert(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_every_id_lies_in_one_piece(docs, empty):
    pieces = packing.pack(docs, default_path(), end_id=2, size=256).collect()
    want = collected(docs)
    ids = Counter((i, tuple(x + [2])) for (i, _), x in zip(want, whole_ids([t for _, t in want])))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    line = []
    for number, sequence in sorted(by_sequence.items()):
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] * 4 == len(p["ids"])
            at += p["length"]
            line.append(p)
        assert at == 256 or number and at & (at - 1) == 0 and at < 256
    built, current = Counter(), []
    for p in line:
        assert p["start"] == len(current)
        current += np.frombuffer(p["ids"], "<u4").tolist()
        if len(current) == p["doc_tokens"]:
            built[(p["doc_id"], tuple(current))] += 1
            current = []
    assert built == ids and not current
    assert packing.pack(empty, default_path(), end_id=2).count() == 0


def test_packing_in_many_parts_is_one_line(spark, monkeypatch):
    rows = [(i, f"word{i % 7} lies here " * (i % 11), "x") for i in range(120)]
    rows += [(None, None, "y"), (None, "", "y"), (5, "again", "z"), (5, "again", "z")] + [(1000 + i, "hot text", "q") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    whole = sorted(packing.pack(docs, default_path(), end_id=2, size=64).collect(), key=str)
    monkeypatch.setattr(packing, "PART_BYTES", 512)
    parted = packing.pack(docs.repartition(5), default_path(), end_id=2, size=64)
    assert sorted(parted.collect(), key=str) == whole
    assert parted.rdd.getNumPartitions() > 3
    fill = defaultdict(list)
    for p in whole:
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == 4 * p["length"]
    for held in fill.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [at for at, _ in sorted(held)] == [0, *ends[:-1]]
        assert ends[-1] == 64 or ends[-1] & (ends[-1] - 1) == 0
    assert sorted(fill) == list(range(len(fill)))


def test_places_sort_by_key_id_and_tie(spark):
    numbers = [-(1 << 63), -5, 0, 3, (1 << 63) - 1]
    rows = [(k, d, t) for k in numbers for d in [None, *numbers] for t in numbers]
    table = spark.createDataFrame(rows, "key long, doc_id long, tie long")
    placed = table.withColumn("place", packing.place_of(F.col("key"), F.col("doc_id"), F.col("tie"))).collect()
    by_place = [(r["key"], r["doc_id"], r["tie"]) for r in sorted(placed, key=lambda r: bytes(r["place"]))]
    assert by_place == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))


# Mixing -----------------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), list(names)
    spare = 1.5 * sum(sizes.values())
    while spare > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += spare * weight[s] / total
        spare = sum(max(0, target[s] - 2 * sizes[s]) for s in names)
        target = {s: min(t, 2 * sizes[s]) for s, t in target.items()}
        open_ = [s for s in open_ if target[s] < 2 * sizes[s]]
    return target


def test_mix_meets_its_targets(spark, docs, empty):
    rng = random.Random(2)
    more = [(100 + i, words(rng, rng.randrange(1, 90)), "en", rng.choice(["s1", "s2", "ü", "b", "c"])) for i in range(150)]
    table = docs.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    )
    got = mixing.mix(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table).collect()), key=str)
    size = {(r["doc_id"], r["source"]): len(WORD.findall(r["text"] or "")) for r in table.collect() if r["doc_id"] is not None}
    taken, sizes, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert r["size"] == size[(r["doc_id"], r["source"])]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for source, want in plain_targets(sizes).items():
        assert target[source] == pytest.approx(want)
        assert abs(taken[source] - want) <= 2
    assert len(got) == table.count() and all(r["source_size"] == sizes[r["source"]] for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


# Near duplicates -----------------------------------------------------------------------

def plain_components(rows):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group))


def test_components_of_near_duplicates(spark, docs, empty):
    rng = random.Random(11)
    rows = [(1000 + i, words(rng, 60)) for i in range(10)]
    for i, t in list(rows)[:4]:
        for k in range(25):  # a group of near copies around each, some of them linked to none
            copy = t.split()
            for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 4])):
                copy[at] = f"n{rng.randrange(10**6)}"
            rows.append((2000 + 100 * i + k, " ".join(copy)))
    rows += [(9000 + i, " ".join(f"c{i + k}" for k in range(40))) for i in range(12)]  # a chain
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter(map(tuple, neardup.near_duplicates(table).collect()))
    assert got == plain_components(collected(table))
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# Personal data ------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and not all(int(p) <= 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_rules(spark, docs, empty):
    rng = random.Random(5)
    parts = ["a", "Z9", "@", ".", "..", "-", "_", "%", "+", " ", "1", "255", "256", "0", "007", "12", "é", "😀", "(", ")", "\n", "4111111111111111", "x@y.z"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(400)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    out = privacy.with_spans(privacy.spotted(table), privacy.Model())
    for r in out.select("text", privacy.listed("base").alias("base"), privacy.listed("spans").alias("spans")).collect():
        assert r["base"] == r["spans"] == ",".join(plain_spans(r["text"])), r["text"]
    assert privacy.redacted_documents(empty).columns == empty.columns


def test_learned_spans_are_added_to_the_rules(spark):
    rng = random.Random(6)
    numbers = [f"call +49 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(100, 999)} now" for _ in range(400)]
    others = [f"order {rng.randrange(10**9, 10**10)}x{rng.randrange(10**4)} sent" for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(numbers + others)), "doc_id long, text string")
    spotted = privacy.spotted(rows)
    model = privacy.learn(spotted)
    assert model.trees and model.thresholds
    out = privacy.with_spans(spotted, model).withColumn("new", privacy.redacted(F.col("text"), "spans")).collect()
    for r in out:
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
        assert ("<phone>" in r["new"]) == (r["doc_id"] < 400)


def test_proposals_of_one_form_are_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(privacy, "SAMPLE", 300)
    texts = ["call +49 123 4567 890 now"] * 1500 + ["order 1234567890x1234 sent"] * 1000
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spotted = privacy.spotted(rows)
    sample = privacy._sampled(privacy._examples(spotted)).collect()
    assert len(sample) < 10 and 200 < sum(r["weight"] for r in sample) < 400
    assert {r["label"] for r in sample} == {0, 1}
    out = privacy.with_spans(spotted, model := privacy.learn(spotted))
    assert model.trees and model.thresholds
    assert {r["spans"] == r["base"] for r in out.collect()} == {True}


def card(rng, sep):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    digits = next(head + c for c in "0123456789" if luhn(head + c))
    return sep.join(digits[k : k + 4] for k in range(0, 16, 4))


def test_disguised_forms_are_added_to_the_rules(spark):
    rng = random.Random(8)
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    group = lambda: f"{rng.randrange(16**3, 16**4):x}"
    hidden = {
        "email": lambda: f"j{number(3)} (at) example{number(2)} (dot) com",
        "ip": lambda: ":".join(group() for _ in range(8)),
        "card": lambda: card(rng, "."),
        "phone": lambda: f"({number(3)}) {number(3)}-{number(4)}",
    }
    plain = [f"mail j{number(3)}@example.com", f"ip 10.{rng.randrange(256)}.0.1", f"pay {card(rng, ' ')} now", f"call +1 {number(3)} {number(4)} {number(3)}"]
    other = [
        lambda: f"look (at) that{number(2)} now", lambda: f"at {rng.randrange(24)}:{rng.randrange(60)}:{rng.randrange(60)}:{rng.randrange(25)} h",
        lambda: f"on 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 10 30 we", lambda: f"sum {number(2)}.{number(5)} {number(5)} and", lambda: f"order {number(10)} sent",
    ]
    rows = [(kind, f"so {make()} is") for kind, make in hidden.items() for _ in range(300)]
    rows += [(None, text) for text in plain for _ in range(50)] + [(None, make()) for make in other for _ in range(200)]
    table = spark.createDataFrame([(i, kind, text) for i, (kind, text) in enumerate(rows)], "doc_id long, hides string, text string")
    spotted = privacy.spotted(table)
    out = privacy.with_spans(spotted, privacy.learn(spotted)).withColumn("new", privacy.redacted(F.col("text"), "spans"))
    for r in out.collect():
        if r["hides"]:
            assert not r["base"] and r["new"] == f"so <{r['hides']}> is", r["text"]
        else:
            assert r["spans"] == r["base"], r["text"]


def test_overlapping_spans_are_redacted_once(spark):
    spans = "array(struct(0 as kind, 2 as start, 5 as end), struct(1 as kind, 4 as start, 8 as end), struct(3 as kind, 9 as start, 10 as end))"
    row = spark.range(1).selectExpr("'é1234567890' AS text", f"cast({spans} as {privacy.SPAN}) AS spans")
    assert row.select(privacy.redacted(F.col("text"), "spans")).first()[0] == "é1<email>8<phone>0"


# Quality -----------------------------------------------------------------------------------------

def test_measures_and_verdicts(spark, docs, empty):
    rng = random.Random(9)
    good = [(100 + i, words(rng, 50 + i), "en", "s1") for i in range(150)]
    bad = [(500, " ".join(f"w{i}{'&' * 3}" for i in range(80)), "en", "s1")]
    table = docs.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    )
    rows = quality.measured(table)
    got = quality.judged(rows, quality.thresholds(rows)).collect()
    assert len(got) == table.count()
    for r in got:
        text = r["text"] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 500:
            assert r["kept"]
        if r["doc_id"] == 500:
            assert not r["kept"]
    assert quality.kept_documents(empty).columns == empty.columns


def test_bounds_follow_the_size_of_a_group_smoothly(spark):
    def share(values, q):
        values = sorted(values)
        return values[max(0, int(np.ceil(q * len(values))) - 1)]

    def drawn(q, *groups):
        out = share(groups[-1], q)
        for g in groups[::-1]:
            out = (len(g) * share(g, q) + quality.PRIOR * out) / (len(g) + quality.PRIOR) if g else out
        return out

    most = {}
    for n in (0, 1, 2, 50, 99, 100, 101, 400):
        # Words of nine letters in the small source, of three in the others of its language, of five elsewhere.
        sizes = [("en", "small", 9, n), ("en", "large", 3, 900), ("de", None, 5, 200)]
        rows = [(" ".join("x" * size for _ in range(12)), lang, source) for lang, source, size, k in sizes for _ in range(k)]
        rows = quality.measured(spark.createDataFrame(rows, "text string, lang string, source string"))
        bounds = {(r["g_lang"], r["g_source"]): r for r in quality.thresholds(rows).collect()}
        lengths = {source: [float(size)] * k for _, source, size, k in sizes}
        english, everything = lengths["small"] + lengths["large"], sum(lengths.values(), [])
        for lang, source, _, k in filter(lambda x: x[3], sizes):
            of_lang = english if lang == "en" else lengths[None]
            low, high = (drawn(q, lengths[source], of_lang, everything) for q in (0.25, 0.75))
            reach = quality.REACH * max(high - low, 1.5)
            assert abs(bounds[lang, source]["most_mean_word"] - high - reach) < quality.GRID + 1e-9
            assert abs(bounds[lang, source]["least_mean_word"] - low + reach) < quality.GRID + 1e-9
        if n:
            most[n] = bounds["en", "small"]["most_mean_word"]
    assert most[1] < most[50] < most[99] <= most[100] <= most[101] < most[99] + 0.2 and most[101] < most[400]


# Top k --------------------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(400, 6)), 2)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows[7] = (7, None)
    rows[8] = (8, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    rows[50] = (50, [float("nan")] * 6)
    rows[9] = (9, [float("inf")] * 6)
    rows += [rows[3], (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    used = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and i not in (7, 8, 9, 50)}
    assert set(got) == {i for i in used if i % 50 == 0}
    for q, found in got.items():
        best = sorted((-int(used[q] @ v), i) for i, v in used.items() if i != q)[:5]
        assert found == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    few = table.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_proofs_skip_segments_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 16))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.int64)
    vectors = vectors[np.argsort(topk.curve_key(pd.Series(list(vectors)), 16), kind="stable")]
    ids, asked = np.arange(8000), np.arange(0, 8000, 50)
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -(2**62)  # itself
    floors, read, found = np.sort(scores, axis=1)[:, -5], 0, defaultdict(list)
    for at in range(0, 8000, 1000):
        group = pd.DataFrame({"part": 0, "seq": at, "vec_id": ids[at : at + 1000], "v": list(vectors[at : at + 1000])})
        block = topk.Block(topk.index_block(group, 16).iloc[0].to_dict(), 16)
        rows, near, values, n = block.top(vectors[asked], asked, 5, floors)
        read += n
        for row, vec_id, score in zip(rows, near, values):
            found[row].append((-score, vec_id))
    for row in range(len(asked)):
        best = np.lexsort((ids, -scores[row]))[:5]
        assert sorted(found[row])[:5] == [(-scores[row, i], i) for i in best]
    assert read < 0.5 * len(asked) * 8 * 16 * topk.SEGMENTS


def test_top_k_in_several_parts_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "BLOCKS_A_PART", 2)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 5)).round(2)
    vectors[:100] = vectors[0]  # a third of all rows on one point
    rows = [(i, v.tolist()[: 3 + i % 3], 1, 2, "x") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int, key int, floor string")
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 10 == 0, k=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    used = np.zeros((300, 5), np.int64)
    for i, v, *_ in rows:
        used[i, : len(v)] = np.floor(256 * np.array(v))
    assert sorted(got) == list(range(0, 300, 10))
    for q, found in got.items():
        best = sorted((-int(used[q] @ used[i]), i) for i in range(300) if i != q)[:3]
        assert found == [(i, -s) for s, i in best]


# Language and toxicity ------------------------------------------------------------------------------

def test_languages_are_told_apart(spark, docs, empty):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ber", "ein"], None: ["zz"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(12)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = languages.learn_profiles(table.where(~held_out("doc_id", 4, 2)))
    assert set(learned) == {"aa", "bb"}
    said = {r["doc_id"]: r for r in languages.identify(table, learned).collect()}
    assert all(said[i]["lang_pred"] == lang and 0 <= said[i]["score"] <= 1 for i, _, lang in rows if lang)
    odd = languages.identify(docs, learned).collect()
    assert len(odd) == docs.count()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert {r["lang_pred"] for r in languages.identify(docs, languages.learn_profiles(empty)).collect()} == {"und"}


def test_toxicity_learns_from_a_bounded_sample(spark):
    rng = random.Random(12)
    own = [(words(rng, 30) + (" vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    hot = [("the same again and again", 0)] * 200 + [(None, 0), ("", 0), ("", 0)]
    everything = [(i, *row) for i, row in enumerate(own + hot)]
    table = spark.createDataFrame(everything, "doc_id long, text string, toxic int").repartition(5)
    rows = table.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").alias("label"))
    kept = np.arange(1 << toxicity.TABLE_BITS)

    def sample(max_rows, max_features):
        return toxicity.bounded_sample(rows, kept, max_rows, max_features).collect()

    whole = sample(1000, 1 << 24)
    assert sum(r["weight"] for r in whole) == len(own + hot)
    assert sorted(r["weight"] for r in whole)[-2:] == [3, 200] and len(whole) == len(set(own)) + 2
    features = set()
    for t in {t for t, _ in own}:
        data = np.frombuffer(t.encode(), np.uint8)
        features.add(tuple(toxicity.present(Texts(data, np.array([0, len(data)])))[1].tolist()))
    assert features <= {tuple(r["features"]) for r in whole}
    some = sample(100, 1 << 24)
    assert 60 <= len(some) <= 100
    few = sample(1000, 10_000)
    assert 5_000 < sum(len(r["features"]) for r in few) <= 10_000
    assert sample(1000, 0) == [] or all(not r["features"] for r in sample(1000, 0))
    for model in (toxicity.train(table, least=5), toxicity.train(table, least=5, max_rows=150)):
        scored = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
        assert all((scored[i] >= 0.5) == bool(t) for i, _, t in everything)


def test_toxic_texts_score_high(spark, docs, empty):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        text, toxic = words(rng, 30), i % 4 == 0
        rows.append((i, text + " vile" + rng.choice(["ness", "ly", "st"]) if toxic else text, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.where(~held_out("doc_id", 5, 0)))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    assert all((scored[i] >= 0.5) == bool(t) for i, _, t in rows)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    nothing = toxicity.train(table.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5}


# Repeated passages ---------------------------------------------------------------------------------

def plain_removal(rows, length=50):
    first, out = {}, Counter()
    for order, i, t in sorted((i is None, i or 0, t or "") for i, t in rows):
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (order, i))
    for i, t in rows:
        b, gone = (t or "").encode(), set()
        own = (i is None, i or 0)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < own:
                gone.update(range(p, p + length))
        kept = bytes(c for p, c in enumerate(b) if p not in gone)
        spans = sum(1 for p in gone if p - 1 not in gone)
        out[(i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_passages_go(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(substrings, "PACK_BYTES", 3000)
    rng = random.Random(13)
    passage = "".join(rng.choice("abcd ") for _ in range(180))
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abcdefgh é\n") for _ in range(rng.randrange(0, 300)))
        if i % 3 == 0:
            a = rng.randrange(0, 100)
            text += passage[a : a + rng.randrange(40, 80)] + text[:60]
        rows.append((1000 + i, text))
    rows += [(2000, "ab" * 200), (2001, "x" + "ab" * 90), (2002, passage[:49]), (2003, passage[:50]), (2003, passage)]
    table = docs.select("doc_id", "text").where("length(text) < 5000 OR text IS NULL")
    table = table.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = substrings.without_repeats(table).withColumn("kept", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == plain_removal(collected(table))
    assert substrings.without_repeats(empty).count() == 0


def hot_texts(rng, n):
    passage = "".join(rng.choice("abcd ") for _ in range(200))
    noise = lambda: "".join(rng.choice("efghijkl") for _ in range(60))
    return [noise() + passage + noise() for _ in range(n)]


def test_hot_passages_are_met_by_strings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 20)
    rng = random.Random(15)
    texts = hot_texts(rng, 80) + [words(rng, 30) for _ in range(40)]
    texts += [t[40:] for t in texts[:30]] + ["ab" * 200, "b" + "ab" * 90] * 15
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = substrings.without_repeats(table).withColumn("kept", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == plain_removal(collected(table))


def test_pieces_shards_and_cells_change_no_result(monkeypatch):
    rng = random.Random(17)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    texts = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(0, 400))) for _ in range(90)]
    for i in range(0, 90, 3):
        a = rng.randrange(0, 300)
        texts[i] += passage[a : a + rng.randrange(40, 100)] + texts[i][:90]
    texts += [texts[5], texts[5][10:], "ab" * 300, "x" + "ab" * 200, "", passage[:49]]
    expected = plain_removal(list(enumerate(texts)))
    sizes = {"CUT_BYTES": (64, 1000, 64 << 10), "PIECE_BYTES": (300, 5000, 1 << 20), "SHARD_BYTES": (1, 700, 1 << 20), "CELLS": (1, 7, 256)}
    for k in range(3):
        for name, values in sizes.items():
            monkeypatch.setattr(substrings, name, values[k])
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        monkeypatch.setattr(substrings, "PACK_BYTES", 3000)
        monkeypatch.setattr(substrings.TaskContext, "get", classmethod(lambda _: types.SimpleNamespace(partitionId=lambda: 0)))
        packs = [r for batch in substrings._pack(iter([rows])) for r in batch.to_pylist()]
        assert len(packs) > 5

        def by_bucket(batches, function):
            table = pa.Table.from_batches(list(batches))
            for b in set(table.column("bucket").to_pylist()):
                yield from function(table.filter(pa.compute.equal(table.column("bucket"), b))).to_pylist()

        def asked(answers):
            return iter([pa.RecordBatch.from_pylist([p | answers[p["pack"]]]) for p in packs])

        answers = defaultdict(lambda: {"replies": [], "hot": [], "found": []})
        plain = iter([pa.RecordBatch.from_pylist([p]) for p in packs])
        for r in by_bucket(substrings._anchors(plain, 50, 8), lambda t: substrings._repeated(t, 10)):
            answers[r["pack"]]["replies"].append(r["hashes"])
            answers[r["pack"]]["hot"].append(r["hot"])
        for r in by_bucket(substrings._fragments(asked(answers), 50, 8), lambda t: substrings._merge(t, 50)):
            answers[r["pack"]]["found"].append(r)
        got = Counter()
        for batch in substrings._remove(asked(answers), 50, 8):
            for r in batch.to_pylist():
                got[(*list(r.values())[:-1], hashlib.sha256(r["kept"]).hexdigest())] += 1
        assert got == expected


def test_no_bucket_holds_the_edges_of_a_hot_passage():
    texts, buckets, packs = hot_texts(random.Random(16), 400), 64, []
    for k in range(4):
        own = [t.encode() for t in texts[k::4]]
        ids, sizes = np.arange(k, 400, 4), np.array([len(t) for t in own])
        packs.append({"pack": k, "doc_ids": ids.tobytes(), "known": b"\1" * 100, "sizes": sizes.tobytes(), "data": b"".join(own)})
    asked = [pa.RecordBatch.from_pylist([p]) for p in packs]
    blobs = pa.Table.from_batches(list(substrings._anchors(iter(asked), 50, buckets)))

    def largest(**most):
        answers = defaultdict(lambda: {"replies": [], "hot": []})
        for b in set(blobs.column("bucket").to_pylist()):
            part = blobs.filter(pa.compute.equal(blobs.column("bucket"), b))
            for r in substrings._repeated(part, **most).to_pylist():
                answers[r["pack"]]["replies"].append(r["hashes"])
                answers[r["pack"]]["hot"].append(r.get("hot", b""))
        sent = [pa.RecordBatch.from_pylist([p | answers[p["pack"]]]) for p in packs]
        fragments, total = Counter(), 0
        for batch in substrings._fragments(iter(sent), 50, buckets):
            for r in batch.to_pylist():
                fragments[r["bucket"]] += len(r["lengths"])
                total += len(r["lengths"])
        return max(fragments.values()), total

    most, total = largest(most=10**9)
    assert most >= 400
    most, total = largest(most=100)
    assert most < 3 * total / buckets


def test_merged_transforms_sort_all_suffixes():
    rng = np.random.default_rng(3)
    texts = [np.concatenate([rng.integers(97, 100, n).astype(np.uint8), [0]]).astype(np.uint8) for n in (40, 1, 77, 20)]
    block, orders = substrings.merged_blocks(texts, 10)
    at, seen = 0, {}
    for text, order in zip(texts, orders):
        circle = np.concatenate([text] * 12)
        for p in order:
            seen.setdefault(int(block[at]), set()).add(circle[p : p + 10].tobytes())
            at += 1
    assert all(len(s) == 1 for s in seen.values())
    assert len(set.union(*seen.values())) == len(seen)
    ordered = [next(iter(seen[b])) for b in sorted(seen)]
    assert ordered == sorted(ordered)


def test_merged_transforms_keep_to_the_suffixes_asked_for(monkeypatch):
    """Blocks of marked suffixes alone, in rounds that sort no other entries."""
    rng = np.random.default_rng(4)
    sizes, sort = [], np.sort
    for letters, depth, count in ((3, 10, 5), (1, 7, 3), (255, 20, 4), (2, 50, 300)):
        texts = [np.append(rng.integers(1, letters + 1, rng.integers(0, 150)), 0).astype(np.uint8) for _ in range(count)]
        begins = [(rng.random(len(t)) < 0.2) & (np.arange(len(t)) + depth < len(t)) for t in texts]
        orders = [substrings.shard_order(t, depth) for t in texts]
        with monkeypatch.context() as patched:
            patched.setattr(substrings, "shard_order", lambda t, _: orders[next(i for i, x in enumerate(texts) if x is t)])
            patched.setattr(np, "sort", lambda x: sizes.append(len(x)) or sort(x))
            sizes.clear()
            block, found = substrings.merged_blocks(texts, depth, begins)
        asked = sum(int(b.sum()) for b in begins)
        assert asked > 0 and set(sizes) == {asked}
        assert [sorted(o) for o in found] == [list(np.flatnonzero(b)) for b in begins]
        strings = [t[p : p + depth].tobytes() for t, o in zip(texts, found) for p in o]
        rank = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert block.tolist() == [rank[s] for s in strings]


def test_shard_order_sorts_each_circle():
    rng = np.random.default_rng(5)
    for n, letters in ((1, 1), (2, 1), (300, 1), (300, 2), (500, 256), (999, 20)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]  # long repeats take several rounds
        circle = np.concatenate([text] * (2 + 70 // n)).tobytes()
        order = substrings.shard_order(text, 70)
        assert sorted(order) == list(range(n))
        found = [circle[p : p + 70] for p in order]
        assert found == sorted(found)


def test_values_are_sorted_by_keys_of_any_width():
    key = np.random.default_rng(6).integers(0, 50, 400).astype(np.uint64)
    for bits in (6, 64):
        values, new = substrings._sorted_by(key << np.uint64(58 if bits == 64 else 0), np.arange(400), bits)
        assert (np.diff(key[values].astype(int)) >= 0).all() and sorted(values) == list(range(400))
        assert new.tolist() == [True, *(np.diff(key[values].astype(int)) > 0).tolist()]


def test_fragments_are_sent_compressed():
    texts = [t.encode() for t in hot_texts(random.Random(19), 60)]
    sizes, ids = np.array([len(t) for t in texts]), np.arange(60)
    pack = {"pack": 0, "doc_ids": ids.tobytes(), "known": b"\1" * 60, "sizes": sizes.tobytes(), "data": b"".join(texts)}
    anchors = substrings.Pack(pack, 50).anchor
    sent = pa.RecordBatch.from_pylist([pack | {"replies": [np.unique(anchors).tobytes()], "hot": []}])
    rows = [r for batch in substrings._fragments(iter([sent]), 50, 1) for r in batch.to_pylist()]
    n_bytes = sum(int(np.frombuffer(r["lengths"], np.uint8).sum()) for r in rows)
    assert 0 < sum(len(r["data"]) for r in rows) < 0.7 * n_bytes
