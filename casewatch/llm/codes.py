"""Vector codes from whole-numbered codebooks, found with the help of fixed pivots.

Every vector is cut into parts, and each part position has a codebook. The distances of a part
to a few fixed pivots are computed once and stored. In a round, the distances of the
codebook's entries to the same pivots give, by the triangle inequality, a lower bound of every
distance between part and entry. Entries are looked at in order of that bound, in whole numbers,
until the bound exceeds the best distance found: no entry beyond can be as near.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.topk import quantised
from casewatch.llm.vectors import PARTS, chunks, part_batch, summed
from casewatch.session import stage

PIVOTS = 12
RUN, WAVE = 512, 16  # parts handled together; entries looked at in one step
SLACK = 1e-6  # more than what rounding can take from a bound


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to n entries, each the farthest from those before it; ties to the lower index."""
    if not len(entries):
        return entries
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of whole numbers, from exact squares."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2).astype(np.float64))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part, its squared distance, and how many distances were evaluated."""
    n, evaluated = len(parts), 0
    bound = np.zeros((n, len(entries)))
    for p in range(entry_pivots.shape[1]):
        a, b = to_pivots[:, p, None], entry_pivots[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound * (1 - SLACK)
    order = np.argsort(bound, axis=1, kind="stable")
    best, code = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    alive = np.arange(n)
    for at in range(0, len(entries), WAVE):
        some = order[alive, at : at + WAVE]
        possible = np.take_along_axis(bound[alive], some, axis=1) <= best[alive, None]
        row, column = np.nonzero(possible)
        if not len(row):
            break
        entry, row = some[row, column], alive[row]
        evaluated += len(row)
        distance = ((parts[row] - entries[entry]) ** 2).sum(axis=1)
        first = np.lexsort((entry, distance, row))
        first = first[np.diff(row[first], prepend=-1) != 0]
        row, entry, distance = row[first], entry[first], distance[first]
        better = (distance < best[row]) | (distance == best[row]) & (entry < code[row])
        best[row[better]], code[row[better]] = distance[better], entry[better]
        alive = alive[possible[:, 0]]  # bounds rise along the order: one that is beyond ends the row
    return code, best, evaluated


class Book:
    """Codebooks and pivots of all part positions: arrays of part, entry, place within the part."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.to_pivots = [distances(e, p) for e, p in zip(entries, pivots)]

    def parts_of(self, column: pa.Array) -> np.ndarray:
        """Vectors as parts, filled up with zeros."""
        positions, _, place = self.entries.shape
        length = np.asarray(column.value_lengths()).astype(np.int64)
        whole = np.zeros((len(length), positions * place), np.int64)
        whole[np.arange(positions * place) < length[:, None]] = np.asarray(column.flatten())
        return whole.reshape(len(length), positions, place)

    def assigned(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First row, parts, codes and squared distances of each run of a batch's rows."""
        parts = self.parts_of(batch.column("v"))
        stored = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.float32)
        stored = stored.reshape(len(parts), len(self.entries), -1)
        for at in range(0, len(parts), RUN):
            some = parts[at : at + RUN]
            found = [
                nearest(some[:, i], stored[at : at + RUN, i].astype(np.float64), self.entries[i], self.to_pivots[i])
                for i in range(len(self.entries))
            ]
            yield at, some, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _measure(batches: Iterator[pa.RecordBatch], book: Book) -> Iterator[pa.RecordBatch]:
    """Rows with the distances of their parts to the pivots."""
    for batch in batches:
        parts = book.parts_of(batch.column("v"))
        stored = [distances(parts[:, i], book.pivots[i]).astype(np.float32) for i in range(len(book.pivots))]
        column = pa.array([row.tobytes() for row in np.stack(stored, axis=1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "pivots"])


def _sums(batches: Iterator[pa.RecordBatch], book: Book) -> Iterator[pa.RecordBatch]:
    """Per entry the sum of its parts and, behind them, their number; one vector a task."""
    positions, n, place = book.entries.shape
    total = np.zeros((positions, n, place + 1), np.int64)
    for batch in batches:
        for _, parts, code, _ in book.assigned(batch):
            for i in range(positions):
                np.add.at(total[i, :, :place], code[:, i], parts[:, i])
                total[i, :, place] += np.bincount(code[:, i], minlength=n)
    yield from part_batch(chunks(None, total.ravel(), TaskContext.get().partitionId(), "<i8"))


def _code(batches: Iterator[pa.RecordBatch], book: Book) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, parts, code, error in book.assigned(batch):
            some = [batch.column(c).slice(at, len(parts)) for c in ("vec_id", "label")]
            text = pa.array([bytes(row).hex() for row in code.astype(np.uint8)], pa.string())
            columns = [*some, text, pa.array(error.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])


def vector_codes(
    table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0,
    id_col="vec_id", vector_col="embedding", label_col="label",
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors (vec_id, label, code, error, label_error) and the codebooks.

    Components become floor(scale * x). A vector is cut into `parts` equal parts; the codebook of
    a part position starts as that part of the vectors with the smallest ids, up to `entries` (256
    at most). Each round assigns every part to its nearest entry, by squared Euclidean distance in
    whole numbers and ties to the lower index, and moves each used entry to the floor of its
    parts' mean. A last assignment gives `code`, two hex digits a part, `error`, the squared
    distances summed over the parts, and `label_error`, the errors summed over equal labels.

    Rows with a null vector or a null or non-finite component take no part. Rows without
    label have one label together; rows without id come after all ids. Repeated rows are
    coded and counted each; of rows with one id the smaller vector starts earlier. Shorter vectors
    count as filled up with zeros, and so does a length that `parts` does not divide. An
    empty table gives no rows and empty codebooks. Only the three named columns are read. Distances
    are 64-bit: components of 2**29 and more, scaled, are beyond it. Acts at once; the driver
    sees the codebooks only, and a round's sums over all rows.
    """
    assert 0 < entries <= 256
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), quantised(vector_col, scale).alias("v")
    ).where("v IS NOT NULL")
    label = rows.schema["label"].dataType.simpleString()
    rows = stage(rows)
    start = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    place = -(-width // parts)
    first = np.zeros((len(start), parts * place), np.int64)
    for row, v in zip(first, start):
        row[: len(v)] = v
    first = np.ascontiguousarray(first.reshape(len(start), parts, place).transpose(1, 0, 2))
    book = Book(first, np.stack([far_apart(e, PIVOTS) for e in first]))
    shape = f"vec_id long, label {label}, v array<long>, pivots binary"
    measured = stage(rows.mapInArrow(partial(_measure, book=book), shape))
    for _ in range(rounds if start else 0):
        moved = summed(measured.mapInArrow(partial(_sums, book=book), PARTS), first[..., :1].size * (place + 1), "<i8")
        total = moved[None].reshape(*first.shape[:2], place + 1)
        n = total[..., place:]
        book = Book(np.where(n > 0, total[..., :place] // np.maximum(n, 1), book.entries), book.pivots)
    coded = stage(measured.mapInArrow(partial(_code, book=book), f"vec_id long, label {label}, code string, error long"))
    by_label = stage(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    whole = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return whole.select("vec_id", "label", "code", "error", "label_error"), book.entries
