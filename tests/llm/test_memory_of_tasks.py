"""What a task holds at a time follows neither the size of a batch nor of a text."""

import tracemalloc

import numpy as np
import pyarrow as pa

from casewatch.llm import neardup, packing, toxicity
from casewatch.llm.buffers import Texts
from casewatch.session import BATCH_SETTING, stage


def texts_of(*texts: str) -> Texts:
    parts = [t.encode() for t in texts]
    return Texts(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def random_text(n: int, seed: int) -> str:
    return "".join(map(chr, np.random.default_rng(seed).integers(97, 103, n)))


def peak(function) -> int:
    function()  # tables that are kept come first
    tracemalloc.start()
    try:
        function()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_ngrams_are_the_same_however_they_are_cut(monkeypatch):
    texts = texts_of(random_text(3000, 1), "", "ab", random_text(7, 2), "aaaaaaaa", random_text(900, 3))
    whole = toxicity.present(texts)
    for held in (1, 5, 64, 1000):
        monkeypatch.setattr(toxicity, "HELD", held)
        for a, b in zip(whole, toxicity.present(texts)):
            assert np.array_equal(a, b)
    for doc in range(len(texts)):
        text = texts.text(doc).decode()
        grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}
        assert len(grams) * 0.99 <= np.count_nonzero(whole[0] == doc) <= len(grams)  # few meet in the table


def test_memory_of_scoring_follows_neither_batch_nor_text():
    class Shared:
        value = toxicity.Classifier(np.ones(1 << toxicity.TABLE_BITS, np.float32), 0.0)

    def held(texts: list[str]) -> int:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        return peak(lambda: [None for _ in toxicity._score(iter([batch]), Shared)])

    assert held([random_text(2000, i) for i in range(2000)]) < 80 << 20  # 4 MB of texts
    assert held([random_text(3_000_000, 0)]) < 110 << 20


def test_staged_python_steps_get_small_batches(spark):
    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    before = spark.conf.get(BATCH_SETTING)
    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 10000) as text")
    got = stage(rows.mapInArrow(size, "bytes long, n long")).collect()
    assert sum(r["n"] for r in got) == 3000  # 30 MB
    assert max(r["bytes"] for r in got) < 6 << 20
    assert spark.conf.get(BATCH_SETTING) == before


def test_a_task_sends_the_set_of_copies_once():
    class Sieve:
        value = np.ones(1 << neardup.SIEVE_BITS, bool)

    texts = [random_text(400, 1).replace("a", " ")] * 500 + [random_text(400, 2).replace("a", " "), "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = pa.Table.from_batches(neardup._sets(iter([batch, batch]), Sieve))
    assert got.num_rows == len(set(got.column("class").to_pylist())) == 2


def test_pairs_are_verified_however_many_come_at_once(monkeypatch):
    sets = [np.arange(k, k + 10 + k % 3, dtype=np.uint64) for k in range(40)]
    pairs = [(a, b) for a in range(40) for b in range(a, 40)]
    columns = [[a for a, _ in pairs], [b for _, b in pairs]]
    columns += [pa.array([sets[p[i]].tobytes() for p in pairs], pa.binary()) for i in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "x", "y"]).slice(3)

    def linked(a, b):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        return 100 * len(x & y) >= 80 * len(x | y)

    for at_once in (1, 7, 1 << 11):
        monkeypatch.setattr(neardup, "PAIRS", at_once)
        got = pa.Table.from_batches(neardup._verify(iter([batch]), 80)).to_pydict()
        assert list(zip(got["a"], got["b"])) == [p for p in pairs[3:] if linked(*p)]


def test_points_are_the_same_however_documents_come():
    lengths = np.random.default_rng(1).integers(0, 300, 200)
    ids = np.random.default_rng(2).integers(0, 49_000, lengths.sum()).astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    alone = [packing.points(ids[a:b], np.array([0, b - a])) for a, b in zip(ends, ends[1:])]
    assert np.array_equal(np.concatenate(alone), packing.points(ids, ends))
