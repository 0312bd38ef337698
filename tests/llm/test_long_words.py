"""Words whose letters follow the parity of their place's bits: running sums modulo 2**64 cannot tell them apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from casewatch.llm import neardup, packing, records, substrings
from casewatch.llm.buffers import PIECE, slices
from casewatch.llm.tokens import Encoder, default_path
from tests.llm.test_text_operators import whole_ids


def parity_words(n, a="a", b="b"):
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return "".join(np.where(bits, a, b)), "".join(np.where(bits, b, a))


@pytest.mark.parametrize("n", [256, 1024, 4096, 70_000])
@pytest.mark.parametrize("letters", ["ab", "a7", "éx"])
def test_hashes_tell_parity_words_apart(n, letters):
    one, other = parity_words(n, *letters)
    (_, _, texts), = slices(pa.array([one, other, one, one.upper()]))
    start, end, _ = texts.words()
    exact, folded = texts.hashes(start, end), texts.hashes(start, end, lower=True)
    assert exact[0] == exact[2] and len(set(exact.tolist())) == 3
    if letters.isascii():
        assert folded[0] == folded[2] == folded[3] and folded[0] != folded[1]


@pytest.mark.parametrize("n", [1024, 4096, 70_000])
def test_operators_tell_parity_words_apart(spark, n):
    one, other = parity_words(n)
    texts = [one, other, f"{one} x", f"{other} x", one.upper()]
    want = whole_ids(texts)
    assert want[0] != want[1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    files = records.write_records(docs, default_path(), end_id=1)
    read = {r["doc_id"]: zlib.crc32(bytes(r["ids"])) for r in records.read_records(files).collect()}
    assert read == {i: zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for i, ids in enumerate(want)}
    pieces = packing.pack(docs, default_path(), end_id=2).orderBy("doc_id", "start").collect()
    for i, ids in enumerate(want):
        assert b"".join(bytes(p["ids"]) for p in pieces if p["doc_id"] == i) == np.array([*ids, 2], "<u4").tobytes()
    linked = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, percent=80).collect()}
    assert linked == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    left = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs.limit(2), length=50).collect()}
    data = one.encode(), other.encode()
    repeated = {data[0][i : i + 50] for i in range(n - 49)}
    gone = {j for i in range(n - 49) if data[1][i : i + 50] in repeated for j in range(i, i + 50)}
    assert left[1] == len(gone)


def test_a_text_longer_than_a_piece_is_hashed_alike():
    words = [f"w{i % 977}" for i in range(PIECE // 4)]
    (_, _, texts), = slices(pa.array([" ".join(words)]))
    assert len(texts.data) > PIECE
    start, end, _ = texts.words()
    (_, _, once), = slices(pa.array([" ".join(words[:977])]))
    first, last, _ = once.words()
    known = once.hashes(first, last)
    assert (texts.hashes(start, end) == known[np.arange(len(words)) % 977]).all()
    ids, _ = Encoder.of(default_path()).encode(texts)
    assert ids.tolist() == whole_ids([" ".join(words)])[0]


def test_the_spread_of_points_does_not_depend_on_the_order(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(500, 4)) * 1e-3]
    shape = ", ".join(f"{c} float" for c in packing.POINT)
    found = [packing.spread(spark.createDataFrame(r, shape).repartition(n)) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert found[0] == found[1]
    for (mean, deviation), axis in zip(found[0], np.array(rows).T):
        assert abs(mean - axis.mean()) < 1e-6 and abs(deviation - axis.std(ddof=1)) < 1e-6
    assert packing.spread(spark.createDataFrame([], shape)) == [(0.0, 1.0)] * 4
