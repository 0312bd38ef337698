"""Toxicity of a text by a linear classifier on character n-grams.

A feature is the presence of an n-gram, hashed to a fixed table. It is scaled by its naive
Bayes log-count ratio: how much likelier labelled toxic texts hold it than others do. A
logistic regression on the scaled features gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.buffers import code_points, mix, powers, slices
from casewatch.llm.vectors import PARTS, chunks, part_batch, summed
from casewatch.session import stage

ORDERS = (3, 4, 5)
TABLE_BITS = 20
PLACES = 1 << 40  # of text hashes in the order of a sample
SEEN_TEXTS = 1 << 16
HELD = 1 << 18  # code points whose n-grams are held at a time, some 100 bytes each
TEXT_BYTES = 1 << 19  # of texts whose n-grams are looked at together


class Classifier(NamedTuple):
    """Weight per hashed n-gram and the constant."""

    weights: np.ndarray
    bias: float


def present(texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and table place of each distinct n-gram of each text, lower-cased."""
    codes, offsets = code_points(texts)
    found = [np.empty(0, np.uint64)]
    for at in range(0, len(codes), HELD):  # n-grams that start here; a few of the next piece come twice
        end = min(at + HELD + ORDERS[-1] - 1, len(codes))
        found.append(_cells(codes[at:end], np.diff(np.clip(offsets, at, end))))
    cells = found[-1] if len(found) <= 2 else _distinct(np.concatenate(found))
    return (cells >> np.uint64(TABLE_BITS)).astype(np.int64), (cells & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def _cells(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Document and table place in one number, of the n-grams within documents of these lengths."""
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    values = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers(len(codes)), out=sums[1:])
    down, found = powers(len(codes) + 1, inverse=True), [np.empty(0, np.uint64)]
    for n in ORDERS:
        if len(codes) < n:
            continue
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        key = (sums[n:] - sums[:-n]) * down[: len(codes) - n + 1] * np.uint64(0xD6E8FEB86659FD93)
        key = mix(key + np.uint64(n)) >> np.uint64(64 - TABLE_BITS)
        found.append((doc[: len(whole)] << np.uint64(TABLE_BITS) | key)[whole])
    return _distinct(np.concatenate(found))


def _distinct(cells: np.ndarray) -> np.ndarray:
    cells.sort()
    return cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold an n-gram."""
    totals = np.zeros((2, (1 << TABLE_BITS) + 1))
    for batch in batches:
        labels = np.asarray(batch.column(1)).astype(np.int64)
        for a, b, texts in slices(batch.column(0), TEXT_BYTES):
            doc, place = present(texts)
            for label in (0, 1):
                totals[label, :-1] += np.bincount(place[labels[a:b][doc] == label], minlength=1 << TABLE_BITS)
                totals[label, -1] += np.count_nonzero(labels[a:b] == label)
    salt = TaskContext.get().partitionId()
    for label in (0, 1):
        yield from part_batch(chunks(str(label), totals[label], salt))


def log_count_ratios(counts: np.ndarray, n: tuple[float, float], smoothing: float, least: float) -> np.ndarray:
    """Log of how much likelier class 1 holds a feature than class 0; 0 for features of few texts."""
    share = [(counts[k] + smoothing) / (n[k] + 2 * smoothing) for k in (0, 1)]
    return np.where(counts.sum(axis=0) >= least, np.log(share[1] / share[0]), 0.0)


def _rows(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Features of texts; a text that this task has had before is left out where it is remembered."""
    seen = set()
    for batch in batches:
        fresh = []
        for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            fresh.append(x not in seen)
            seen.add(x)
        if len(seen) > SEEN_TEXTS:
            seen.clear()
        batch = batch.filter(pa.array(fresh, pa.bool_()))
        for a, b, texts in slices(batch.column(0), TEXT_BYTES):
            doc, place = present(texts)
            column = np.searchsorted(kept, place)
            hit = (column < len(kept)) & (kept[np.minimum(column, len(kept) - 1)] == place)
            ends = np.searchsorted(doc[hit], np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(column[hit].astype(np.int32)))
            columns = [batch.column(i).slice(a, b - a) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([lists, *columns], ["features", "label", "key"])


def bounded_sample(rows: DataFrame, kept: np.ndarray, max_rows: int, max_features: int) -> DataFrame:
    """features, label and weight of distinct labelled texts, those with the smallest text hashes.

    Equal texts of a label are one row, and their number is its weight, so a text that is very often there
    takes no more room than another. At most `max_rows` rows with `max_features` features in
    all are returned: rows are taken in order of hash, bin by bin, while both hold.
    """
    keyed = rows.withColumn("key", F.xxhash64("text")).withColumn("place", F.pmod("key", F.lit(PLACES)))
    alike = stage(keyed.groupBy("key", "label").agg(F.count("*").alias("weight")))
    # Half as many again as are asked for, so that the bounds and not chance end the sample.
    end = int(PLACES * min(1.0, 1.5 * max_rows / max(1, alike.count()))) or 1
    near = keyed.where(F.col("place") < end).select("text", "label", "key")
    found = near.mapInArrow(partial(_rows, kept=kept), "features array<int>, label int, key long")
    found = found.groupBy("key", "label").agg(F.first("features").alias("features"))
    found = found.join(alike, ["key", "label"])
    found = stage(found.withColumn("bin", F.floor(F.pmod("key", F.lit(PLACES)) * (4 * max_rows) / end).cast("int")))
    sizes = found.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.size("features")).alias("m")).orderBy("bin").collect()
    end, n, m = 0, 0, 0
    for row in sizes:  # at most 4 * max_rows of them
        n, m = n + row["n"], m + row["m"]
        if n > max_rows or m > max_features:
            break
        end = row["bin"] + 1
    return found.where(F.col("bin") < end).select("features", "label", "weight")


def fit_logistic(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, counts: np.ndarray, l2: float, steps=60
):
    """Weights and constant of a sparse logistic regression on rows that count several times, by L-BFGS."""
    n, width, counts = len(labels), len(values), counts / counts.sum()

    def loss(w):
        z = np.bincount(rows, (w[:-1] * values)[columns], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        value = counts @ (np.logaddexp(0, z) - labels * z) + l2 / 2 * (w[:-1] @ w[:-1])
        g = (p - labels) * counts
        return value, np.append(np.bincount(columns, g[rows], width) * values + l2 * w[:-1], g.sum())

    w, past = np.zeros(width + 1), []
    value, slope = loss(w)
    for _ in range(steps):
        q = slope.copy()
        shares = []
        for s, y in reversed(past):
            shares.append((s @ q) / (s @ y))
            q -= shares[-1] * y
        if past:
            q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), share in zip(past, reversed(shares)):
            q += (share - (y @ q) / (s @ y)) * s
        step = 1.0 if past else 1.0 / max(np.linalg.norm(q), 1e-12)
        while step > 1e-10:
            new, turned = loss(w - step * q)
            if new <= value - 1e-4 * step * (slope @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, turned - slope
        w, done = w + s, value - new < 1e-7 * max(value, 1e-9)
        value, slope = new, turned
        if s @ y > 1e-12:
            past = [*past, (s, y)][-10:]
        if done:
            break
    return w[:-1], float(w[-1])


def train(
    labelled: DataFrame,
    text_col="text",
    label_col="toxic",
    max_rows: int = 20_000,
    max_features: int = 1 << 24,
    smoothing: float = 1.0,
    least: float = 10,
    ratio: float = 1.5,
    l2: float = 1e-3,
) -> Classifier:
    """Classifier from labelled texts.

    Counts, and so the ratios, cover all labelled rows. The regression is fitted on a sample that the driver
    holds: distinct texts with the smallest hashes, weighted by how often they occur, at most
    `max_rows` with `max_features` features in all. Features count that have a ratio of at least `ratio`
    either way and that at least `least` texts hold. Rows without label do not count; with one
    class only, the score is that class's share. A null text is like an empty one.
    """
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = stage(rows.where("label in (0, 1)"))
    sums = summed(rows.mapInArrow(_count, PARTS), (1 << TABLE_BITS) + 1)
    counts = np.stack([sums.get(k, np.zeros((1 << TABLE_BITS) + 1)) for k in ("0", "1")])
    n, counts = (counts[0, -1], counts[1, -1]), counts[:, :-1]
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    if not min(n):
        return Classifier(weights, float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    ratios = log_count_ratios(counts, n, smoothing, least)
    kept = np.flatnonzero(np.abs(ratios) >= ratio)
    if not len(kept):
        return Classifier(weights, float(np.log(n[1] / n[0])))
    table = bounded_sample(rows, kept, max_rows, max_features).toArrow()
    features = table.column("features").combine_chunks()
    labels, counts = (np.asarray(table.column(c)).astype(float) for c in ("label", "weight"))
    if not len(labels):  # not even the first text has room
        return Classifier(weights, float(np.log(n[1] / n[0])))
    of = np.repeat(np.arange(len(labels)), np.diff(np.asarray(features.offsets)))
    w, bias = fit_logistic(of, np.asarray(features.values), ratios[kept], labels, counts, l2)
    weights[kept] = w * ratios[kept]
    return Classifier(weights, bias)


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    weights, bias = shared.value
    for batch in batches:
        for a, b, texts in slices(batch.column(1), TEXT_BYTES):
            doc, place = present(texts)
            z = np.bincount(doc, weights[place], b - a) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """Score of every text between 0 and 1; a null or empty text gets that of no features.

    One row per row; only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_score, shared=shared), "doc_id long, score double")
