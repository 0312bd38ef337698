"""Hard negatives by a secondary sort of pair scores.

Anchors meet all rows in cells of a bounded number of anchors and rows. A cell passes on,
of each anchor, only scores that can be among the first of the whole table. These are
packed into keys (anchor, descending score, id), dealt by anchor and sorted within the
partitions by the shuffle. One pass over a partition then sees an anchor's scores from the
best down: a positive opens its window of scores, and negatives that fall into open
windows are given out at once. No anchor's scores are ever held together.

The shuffle runs twice: for the positives, whose scores bound what the second one must carry,
and for positives and negatives together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm.topk import quantised
from casewatch.session import stage

ANCHORS, ROWS, RUN = 2048, 8192, 1024  # anchors and rows of a cell; rows scored in one step
MEMBER = "cell long, kind int, anchor long, vec_id long, label string, v array<long>, p_ids array<long>, p_scores array<long>"
PAIR = "anchor long, anchor_id long, key binary"
LEAST = np.iinfo(np.int64).min
FLIP_SIGN, KEEP_SIGN = np.uint64(1 << 63), np.uint64((1 << 63) - 1)
KEY = np.dtype([("anchor", ">u8"), ("fall", ">u8"), ("negative", "u1"), ("id", ">u8")])


def packed(anchor, score, negative, vec_id) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, positives before negatives, and id."""
    keys = np.empty(len(score), KEY)
    keys["anchor"], keys["negative"] = anchor, negative
    keys["fall"] = np.asarray(score, np.int64).view(np.uint64) ^ KEEP_SIGN
    keys["id"] = np.asarray(vec_id, np.int64).view(np.uint64) ^ FLIP_SIGN
    ends = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def unpacked(column: pa.Array) -> tuple[list, list, list]:
    """Scores, whether negative, and ids of packed keys."""
    keys = np.frombuffer(b"".join(column.to_pylist()), KEY)
    score = (keys["fall"].astype(np.uint64) ^ KEEP_SIGN).view(np.int64)
    vec_id = (keys["id"].astype(np.uint64) ^ FLIP_SIGN).view(np.int64)
    return score.tolist(), keys["negative"].tolist(), vec_id.tolist()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond 64 bits they wrap."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class First:
    """The k first distinct (score, id) of each row: higher scores, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k, self.least = k, np.full(rows, LEAST)
        self.row = self.score = self.id = np.empty(0, np.int64)

    def offer(self, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(row):
            return
        new = zip((self.row, self.score, self.id), (row, score, vec_id))
        row, score, vec_id = (np.concatenate(pair) for pair in new)
        order = np.lexsort((vec_id, ~score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(score) != 0) | (np.diff(vec_id) != 0)
        row, score, vec_id = row[new], score[new], vec_id[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], vec_id[kept]
        last = place == self.k - 1
        self.least[row[last]] = score[last]


class Members:
    """Rows of a cell as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.anchor = np.asarray(batch.column("anchor").fill_null(-1))
        self.id = np.asarray(batch.column("vec_id"))
        self.label = np.array(batch.column("label").to_pylist(), object)
        vectors = batch.column("v")
        length = np.asarray(vectors.value_lengths()).astype(np.int64)
        self.v = np.zeros((len(length), width), np.int64)
        self.v[np.arange(width) < length[:, None]] = np.asarray(vectors.flatten())
        self.p_ids, self.p_scores = (batch.column(c).to_pylist() for c in ("p_ids", "p_scores"))


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, Members]]:
    """Cell, kind and members of each run of rows, a thousand rows at most."""
    for batch in batches:
        cell, kind = (np.asarray(batch.column(c)).astype(np.int64) for c in ("cell", "kind"))
        turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
        edges = np.unique(np.concatenate([turn, np.arange(0, len(cell), RUN), [len(cell)]]))
        for a, b in zip(edges, edges[1:]):
            yield int(cell[a]), int(kind[a]), Members(batch.slice(a, b - a), width)


def _joined(parts: list[Members]) -> Members:
    whole = object.__new__(Members)
    for name in ("anchor", "id", "label", "v"):
        setattr(whole, name, np.concatenate([getattr(p, name) for p in parts]))
    for name in ("p_ids", "p_scores"):
        setattr(whole, name, [x for p in parts for x in getattr(p, name)])
    return whole


def _same_label(anchors: Members, others: Members) -> np.ndarray:
    codes = np.unique(np.concatenate([anchors.label, others.label]), return_inverse=True)[1]
    n = len(anchors.label)
    return codes[:n, None] == codes[None, n:]


def _met(batches: Iterator[pa.RecordBatch], width: int, slots: int, begin, step, end) -> Iterator[pa.RecordBatch]:
    """Anchors of each cell, which come first in it, against the rows of the cell run by run."""
    at, parts, anchors, state = None, [], None, None
    for cell, kind, members in _runs(batches, width):
        if cell != at:
            if anchors is not None:
                yield from end(anchors, state, at % slots == 0)
            at, parts, anchors = cell, [], None
        if kind == 0:
            parts.append(members)
            continue
        if anchors is None and parts:
            anchors = _joined(parts)
            state = begin(anchors)
        if anchors is not None:
            step(anchors, state, members, product(anchors.v, members.v))
    if anchors is None and parts:
        anchors = _joined(parts)
        state = begin(anchors)
    if anchors is not None:
        yield from end(anchors, state, at % slots == 0)


def _pairs(anchors: Members, row, score, negative, vec_id) -> Iterator[pa.RecordBatch]:
    if len(row):
        columns = [pa.array(anchors.anchor[row]), pa.array(anchors.id[row])]
        columns.append(packed(anchors.anchor[row], score, negative, vec_id))
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "anchor_id", "key"])


def _positive_scores(batches, width: int, slots: int, positives: int) -> Iterator[pa.RecordBatch]:
    """Of each anchor, the cell's first rows of its own label."""

    def step(anchors, best, others, scores):
        fit = _same_label(anchors, others) & (anchors.id[:, None] != others.id)
        row, column = np.nonzero(fit & (scores >= best.least[:, None]))
        best.offer(row, scores[row, column], others.id[column])

    def end(anchors, best, _):
        yield from _pairs(anchors, best.row, best.score, np.zeros(len(best.row), np.uint8), best.id)

    return _met(batches, width, slots, lambda anchors: First(len(anchors.id), positives), step, end)


class Windows:
    """The scores that negatives of each positive may have, and the cell's first of them."""

    def __init__(self, anchors: Members, low: int, high: int, negatives: int):
        known = [(i, p, s) for i, pair in enumerate(zip(anchors.p_ids, anchors.p_scores)) for p, s in zip(*map(_or_none, pair))]
        self.row, self.id, self.score = np.array(known, np.int64).reshape(-1, 3).T
        self.first = First(len(self.row), negatives)
        exact = self.score.tolist()
        self.low = np.array([-(-low * p // 100) for p in exact], np.int64)
        self.high = np.array([high * p // 100 for p in exact], np.int64)


def _or_none(values) -> list:
    return values or []


def _window_scores(batches, width: int, slots: int, low: int, high: int, negatives: int) -> Iterator[pa.RecordBatch]:
    """Positives of each anchor and, for each, the cell's first negatives in its window."""

    def step(anchors, windows, others, scores):
        other = ~_same_label(anchors, others) & (anchors.id[:, None] != others.id)
        scores = np.where(other, scores, LEAST)
        for at in range(0, len(windows.row), RUN):
            some = slice(at, at + RUN)
            seen = scores[windows.row[some]]
            floor = np.maximum(windows.low[some], windows.first.least[some])
            row, column = np.nonzero((seen >= floor[:, None]) & (seen <= windows.high[some, None]) & (seen != LEAST))
            windows.first.offer(row + at, seen[row, column], others.id[column])

    def end(anchors, windows, opens):
        if opens:  # one of an anchor's cells passes the positives on
            yield from _pairs(anchors, windows.row, windows.score, np.zeros(len(windows.row), np.uint8), windows.id)
        first = windows.first
        yield from _pairs(anchors, windows.row[first.row], first.score, np.ones(len(first.row), np.uint8), first.id)

    begin = partial(Windows, low=low, high=high, negatives=negatives)
    return _met(batches, width, slots, begin, step, end)


def _take_positives(batches: Iterator[pa.RecordBatch], positives: int) -> Iterator[pa.RecordBatch]:
    """First scores of each anchor, of keys in order."""
    at, out = None, []
    for batch in batches:
        scores, _, ids = unpacked(batch.column("key"))
        for anchor, score, vec_id in zip(batch.column("anchor").to_pylist(), scores, ids):
            if anchor != at:
                at, taken, last = anchor, 0, None
            if taken < positives and (score, vec_id) != last:
                taken, last = taken + 1, (score, vec_id)
                out.append((anchor, vec_id, score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "p_id", "p_score"])
            out = []


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _open_windows(batches: Iterator[pa.RecordBatch], low: int, high: int, negatives: int) -> Iterator[pa.RecordBatch]:
    """Negatives of each positive, from keys in order: what is kept is the open windows of one anchor."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    at, windows, last = None, [], None
    for batch in batches:
        out = []
        columns = (batch.column("anchor").to_pylist(), batch.column("anchor_id").to_pylist(), *unpacked(batch.column("key")))
        for anchor, anchor_id, score, negative, vec_id in zip(*columns):
            if anchor != at:
                at, windows, last = anchor, [], None
            if not negative:
                windows.append([vec_id, score, 0])
                continue
            if (score, vec_id) == last:  # found for several windows; given out to all of them the first time
                continue
            last = (score, vec_id)
            for window in windows:
                if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                    window[2] += 1
                    out.append((anchor_id, window[0], window[2], vec_id, window[1], score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _sorted(pairs: DataFrame) -> DataFrame:
    """Pairs dealt by anchor, each partition in key order."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def hard_negatives(
    table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, id_col="vec_id", vector_col="embedding", label_col="label",
) -> DataFrame:
    """For each anchor and each of its positives, the first negatives within a window of scores.

    A score is the inner product of vectors whose components are floor(scale * x); higher ones
    come first, ties by smaller id. `anchors` picks rows by `vec_id`. An anchor's positives are its first
    rows of the same label, a positive's negatives the first rows of other labels that
    score from `low` to `high` percent of it: none where the positive's score is below zero, and at
    zero those of zero. Gives anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without id, label or vector, or with a null or non-finite component, take no part.
    Shorter vectors count as filled up with zeros. Rows equal in id, label and vector count
    once. Rows that share an id and differ otherwise are anchors and candidates each; rows of an
    anchor's own id are never its partners, and of several with one id and one score toward
    an anchor, alike in having its label or not, one counts. Only the three named columns are read. Fewer partners than asked for:
    all of them. An empty table gives no rows. Stages the rows and acts at once.
    """
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        quantised(vector_col, scale).alias("v"),
    )
    rows = stage(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates())
    asked = stage(rows.where(anchors).withColumn("anchor", F.monotonically_increasing_id()))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    groups, slots, width = max(1, -(-asked.count() // ANCHORS)), max(1, -(-n // ROWS)), width or 0
    group = F.pmod(F.xxhash64(F.lit(1), "anchor"), F.lit(groups))
    slot = F.pmod(F.xxhash64(F.lit(2), "vec_id", "label", "v"), F.lit(slots))

    def cells(askers: DataFrame) -> DataFrame:
        """Every cell's anchors and then its rows."""
        each_slot = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: group * slots + i))
        each_group = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * slots + slot))
        none = F.lit(None).cast("array<long>")
        first = askers.select(each_slot.alias("cell"), F.lit(0).alias("kind"), "anchor", "vec_id", "label", "v", "p_ids", "p_scores")
        others = rows.select(
            each_group.alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label", "v",
            none.alias("p_ids"), none.alias("p_scores"),
        )
        both = first.unionByName(others).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]})" for c in MEMBER.split(", ")))
        return both.repartition("cell").sortWithinPartitions("cell", "kind")

    none = F.lit(None).cast("array<long>")
    scored = cells(asked.withColumns({"p_ids": none, "p_scores": none}))
    pairs = scored.mapInArrow(partial(_positive_scores, width=width, slots=slots, positives=positives), PAIR)
    taken = _sorted(pairs).mapInArrow(partial(_take_positives, positives=positives), "anchor long, p_id long, p_score long")
    lists = taken.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("p_score")).alias("fall"), "p_id"))).alias("p")
    )
    lists = lists.select("anchor", F.col("p.p_id").alias("p_ids"), F.transform("p.fall", lambda x: -x).alias("p_scores"))
    known = stage(asked.join(lists, "anchor"))
    window = dict(low=low, high=high, negatives=negatives)
    pairs = cells(known).mapInArrow(partial(_window_scores, width=width, slots=slots, **window), PAIR)
    return _sorted(pairs).mapInArrow(partial(_open_windows, **window), FOUND)
