"""Fixed-length training sequences from documents that lie near each other on a space-filling curve.

Each document becomes a hashed vector of its tokens, projected to a few dimensions; the
place of that point on a Hilbert curve is its key. Documents are range-sorted by key and
laid end to end, and the line is cut at every sequence length. What is left at the end is
cut to powers of two, so nothing needs padding.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.llm.buffers import mix, slices, text_arrays
from casewatch.llm.records import with_end
from casewatch.llm.tokens import ENCODED_BYTES, Encoder
from casewatch.session import stage

HASHED, AXES, BITS = 256, 4, 12
LEAST = -(1 << 63)
PART_BYTES = 16 << 20  # of ids in a part of the line
STEPS = 1 << 24  # to a unit, of coordinates that are added up
POINT = [f"c{i}" for i in range(AXES)]
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


@lru_cache(maxsize=None)
def _projection() -> np.ndarray:
    return np.random.default_rng(8).standard_normal((HASHED, AXES)).astype(np.float32)


def points(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Projected hashed vector of each document; one without tokens lies at the origin."""
    n = len(offsets) - 1
    hashed = mix(ids.astype(np.uint64) + np.uint64(1))
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    cell = doc * HASHED + (hashed % np.uint64(HASHED)).astype(np.int64)
    vectors = np.bincount(cell, sign, n * HASHED).reshape(n, HASHED)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    if n == 1:  # a single row would be multiplied by another routine, which rounds otherwise
        return (vectors.repeat(2, axis=0).astype(np.float32) @ _projection())[:1]
    return vectors.astype(np.float32) @ _projection()


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates, one row each."""
    x = cells.astype(np.int64).T.copy()
    axes, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the sub-cubes, coarse to fine
        low = q - 1
        for i in range(axes):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(tokenizer)
    kind = "<u2" if encoder.width == 2 else "<u4"
    for batch in batches:
        for a, b, texts in slices(batch.column(1), ENCODED_BYTES):
            ids, offsets = encoder.encode(texts)
            at = points(ids, offsets)
            ids, offsets = with_end(ids, offsets, end_id)
            packed = _binary(ids.astype(kind), offsets * encoder.width)
            columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(offsets))]
            columns += [packed, *(pa.array(at[:, i]) for i in range(AXES))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n", "ids", *POINT])


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]
    )


def _key(*axes: pd.Series) -> pd.Series:
    spread = np.stack([1 / (1 + np.exp(-np.clip(1.702 * a.to_numpy(np.float64), -50, 50))) for a in axes], axis=1)
    cells = np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return pd.Series(hilbert(cells, BITS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First place of a part and how many ids it has, of light rows in order."""
    first, total = None, 0
    for batch in batches:
        if batch.num_rows:
            first = first if first is not None else batch.column(0)[0].as_py()
            total += int(np.asarray(batch.column(1)).sum())
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([total])], ["place", "n"])


def _part_of(places: pd.Series, firsts: list[bytes]) -> pd.Series:
    """Part whose first place is the last one not behind a row's."""
    return pd.Series([bisect_right(firsts, place) - 1 for place in places], dtype="int32")


def place_of(key: Column, doc_id: Column, tie: Column) -> Column:
    """Bytes that sort by key, id (null first) and tie."""

    def rising(number: Column) -> Column:  # signed, as bytes that sort alike
        return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(LEAST))), 16, "0"))

    known = F.when(doc_id.isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1"))
    return F.concat(rising(key), known, rising(F.coalesce(doc_id, F.lit(0).cast("long"))), rising(tie))


class Line:
    """Sequences of a line of ids: full ones, then the rest by powers of two."""

    def __init__(self, total: int, size: int):
        self.size, self.full, rest = size, total // size, total % size
        parts = [1 << b for b in reversed(range(size.bit_length())) if rest >> b & 1]
        self.tail = self.full * size + np.concatenate([[0], np.cumsum(parts)]).astype(np.int64)

    def sequence(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < self.tail[0], at // self.size, self.full + np.searchsorted(self.tail, at, "right") - 1)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        beyond = np.clip(sequence - self.full, 0, len(self.tail) - 1)
        return np.where(sequence <= self.full, sequence * self.size, self.tail[beyond])


def _cut(batches: Iterator[pa.RecordBatch], bases: list[int], line: Line, width: int) -> Iterator[pa.RecordBatch]:
    """Pieces of documents in order, part by part."""
    at_part, end = None, 0
    for batch in batches:
        part = np.asarray(batch.column(0))
        turns = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *turns], [*turns, len(part)]):
            if a == b:
                continue
            if part[a] != at_part:
                at_part, end = part[a], bases[part[a]]
            _, doc_id, n, ids = batch.slice(a, b - a).columns
            n = np.asarray(n).astype(np.int64)
            lowest = end + np.cumsum(n) - n
            end += int(n.sum())
            yield from _pieces(doc_id, n, ids, lowest, line, width)


def _pieces(doc_id, n, ids, lowest, line: Line, width: int) -> Iterator[pa.RecordBatch]:
    first = line.sequence(lowest)
    pieces = line.sequence(lowest + n - 1) - first + 1
    row = np.repeat(np.arange(len(n)), pieces)
    sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = line.start(sequence)
    start = np.maximum(lowest[row], starts)
    length = np.minimum((lowest + n)[row], line.start(sequence + 1)) - start
    data = text_arrays(ids)[0].view("<u2" if width == 2 else "<u4").astype("<u4")
    edges = np.concatenate([[0], np.cumsum(length)])
    at = 0
    while at < len(row):  # offsets of an Arrow binary column end at 2**31 bytes
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + (4 << 20), "right")) - 1)
        columns = [doc_id.take(pa.array(row[at:to])), pa.array((start - lowest[row])[at:to])]
        columns += [pa.array(length[at:to]), pa.array(n[row][at:to]), pa.array(sequence[at:to])]
        columns += [pa.array((start - starts)[at:to])]
        columns += [_binary(data[edges[at] : edges[to]], (edges[at : to + 1] - edges[at]) * 4)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])
        at = to


def spread(points: DataFrame) -> list[tuple[float, float]]:
    """Mean and deviation of each axis, from sums of whole numbers, which no order of adding changes."""
    steps = [F.round(F.col(c) * STEPS).cast("decimal(38,0)") for c in POINT]
    sums = [f.cast("string") for x in steps for f in (F.sum(x), F.sum(x * x))]
    n, *sums = points.agg(F.count("*"), *sums).first()
    out = []
    for total, square in zip(sums[::2], sums[1::2]):
        total, square = int(total or 0), int(square or 0)
        deviation = math.sqrt(max(0, n * square - total * total) / max(1, n * (n - 1))) / STEPS
        out.append((total / max(1, n) / STEPS, deviation or 1.0))
    return out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Pieces of all documents in sequences of `size` ids; `ids` holds a piece's ids, four bytes each.

    Documents are cut where a sequence ends. A null or empty text is its end id. Equal
    keys are ordered by id (null first) and a hash of the text, so reruns agree; rows equal
    in both are interchangeable. Only the two named columns are read. An empty table gives
    no pieces. Encodes and sorts at once; the driver sees one total per part of the line.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    shape = "doc_id long, tie long, n long, ids binary, " + ", ".join(f"{c} float" for c in POINT)
    encoded = stage(rows.mapInArrow(partial(_encode, tokenizer=tokenizer, end_id=end_id), shape))
    centre = spread(encoded)
    scaled = [(F.col(c) - mean) / deviation for c, (mean, deviation) in zip(POINT, centre)]
    keyed = encoded.withColumn("key", F.pandas_udf(_key, "long")(*scaled)).drop(*POINT)
    keyed = keyed.withColumn("place", place_of(F.col("key"), F.col("doc_id"), F.col("tie")))
    # Where the parts begin is found on light rows; ids then move once and are cut where they arrive.
    n_parts = max(1, -(-(encoded.agg(F.sum("n")).first()[0] or 0) * Encoder.of(tokenizer).width // PART_BYTES))
    light = keyed.select("place", F.col("n").cast("long")).repartitionByRange(n_parts, "place").sortWithinPartitions("place")
    parts = sorted(light.mapInArrow(_sums, "place binary, n long").collect())
    if not parts:
        return spark.createDataFrame([], PIECES)
    firsts, sums = [bytes(p["place"]) for p in parts], [p["n"] for p in parts]
    bases = [0, *accumulate(sums)]

    def part_of(places: pd.Series) -> pd.Series:
        return _part_of(places, firsts)

    dealt = keyed.withColumn("part", F.pandas_udf(part_of, "int")("place")).repartitionById(len(parts), "part")
    along = dealt.sortWithinPartitions("place").select("part", "doc_id", "n", "ids")
    cut = partial(_cut, bases=bases, line=Line(bases[-1], size), width=Encoder.of(tokenizer).width)
    return along.mapInArrow(cut, PIECES)
