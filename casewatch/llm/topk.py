"""Exact top-k inner products over an impact-ordered index.

Vectors are range-sorted along a space-filling curve and cut into blocks, so a block holds
vectors that lie near each other. Within a block, every dimension lists its vectors by
value, in posting segments of similar values. A segment's impact for a query is what its
best value adds to a score, quantised to a byte. Queries read the segments of a block by
falling impact, many queries in one matrix step; a vector whose segments of some
dimensions are unread may still gain the most that these have left. A query ends in a
block as soon as few vectors can reach the k-th best score known, and rescores those
exactly. The bounds are proofs, so nothing is lost however early it stops. Blocks whose
best possible score is below a query's floor are not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casewatch.llm.packing import hilbert
from casewatch.session import stage

BLOCK, BLOCKS_A_PART, QUERIES = 4096, 16, 1024
SEGMENTS, FEW, BATCH = 16, 64, 256  # of a dimension; vectors to rescore at once; queries of a matrix step
IMPACTS, CUTS = 255, (0.125, 0.25, 0.5)  # steps of an impact; shares of the segments after which a proof is tried
AXES, BITS = 4, 8
INDEX = "part int, seq int, ids binary, vectors binary, segments binary, high binary, low binary, highest array<long>, lowest array<long>"
STORED = ("ids", "vectors", "segments", "high", "low")
FOUND = "query_id long, vec_id long, score long"
LEAST = np.iinfo(np.int64).min


def quantised(vector: str, scale: float = 256.0) -> Column:
    """Whole components floor(scale * x); null where the vector or a component is not a number."""
    values = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One whole-numbered vector per id."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col).alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def product(a: np.ndarray, b: np.ndarray, terms: int | None = None) -> np.ndarray:
    """Exact a @ b.T of whole numbers with `terms` products a sum, in the narrowest type that holds it; beyond 64 bits they wrap."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(terms or a.shape[1], 1)
    if most >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    kind = np.float32 if most < 2**24 else np.float64
    return (a.astype(kind, copy=False) @ b.astype(kind, copy=False).T).astype(np.int64)


def curve_key(vectors: pd.Series, width: int) -> pd.Series:
    """Place on a space-filling curve of a vector's direction, projected to a few axes."""
    matrix = _matrix(vectors, width).astype(np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    at = matrix @ np.random.default_rng(7).standard_normal((width, AXES))
    cells = (1 / (1 + np.exp(-1.702 * at)) * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
    return pd.Series(hilbert(cells, BITS))


def _place(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Part of the line and block of each row, of rows in order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        seq = pa.array((np.arange(at, at + n) // size).astype(np.int32))
        at += n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), seq, *batch.columns], ["part", "seq", "vec_id", "v"])


def index_block(group: pd.DataFrame, width: int) -> pd.DataFrame:
    """One block: of every vector and dimension its segment, and each segment's range of values."""
    group = group.sort_values("vec_id")
    ids, matrix = group["vec_id"].to_numpy(np.int64), _matrix(group["v"], width)
    n = len(ids)
    order = np.argsort(-matrix, axis=0, kind="stable")
    starts = np.linspace(0, n, SEGMENTS + 1).astype(np.int64)
    place = np.searchsorted(starts, np.arange(n), "right") - 1
    segments = np.empty((n, width), np.uint8)
    np.put_along_axis(segments, order, np.broadcast_to(place[:, None], (n, width)).astype(np.uint8), axis=0)
    by_rank = np.take_along_axis(matrix, order, axis=0)
    high = by_rank[starts[:-1].clip(max=n - 1)]
    low = np.minimum(high, by_rank[(starts[1:] - 1).clip(min=0)])  # a small block has empty segments
    row = {"part": [int(group["part"].iloc[0])], "seq": [int(group["seq"].iloc[0])]}
    row |= {name: [x.tobytes()] for name, x in zip(STORED, (ids, matrix, segments, high, low))}
    row |= {"highest": [matrix.max(axis=0)], "lowest": [matrix.min(axis=0)]}
    return pd.DataFrame(row)


class Block:
    """An index block as queries read it."""

    def __init__(self, row: dict, width: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, width)
        self.segments = np.frombuffer(row["segments"], np.uint8).reshape(n, width)
        self.high, self.low = (np.frombuffer(row[c], np.int64).reshape(SEGMENTS, width) for c in ("high", "low"))
        self._postings = None

    @property
    def postings(self) -> np.ndarray:
        """One row per vector with a one for each segment that lists it."""
        if self._postings is None:
            n, width = self.segments.shape
            self._postings = np.zeros((n, width * SEGMENTS), np.float32)
            at = np.arange(width) * SEGMENTS + self.segments
            np.put_along_axis(self._postings, at, 1, axis=1)
        return self._postings

    def _floors(self, queries, own, k, reach, floors):
        """Floors raised to the k-th exact score among the vectors that lead now."""
        n = reach.shape[1]
        if n <= k:  # the own row may be among them
            return floors
        lead = np.argpartition(reach, n - k - 1, axis=1)[:, n - k - 1 :]
        scores = np.einsum("qkd,qd->qk", self.vectors[lead], queries)
        scores = np.where(self.ids[lead] == own[:, None], LEAST, scores)
        return np.maximum(floors, np.sort(scores, axis=1)[:, 1])  # k of the k + 1, without the least

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query rows, ids and scores of the block's best, and how many segments were read.

        `floors` are scores that k vectors have anywhere (the least number if unknown);
        smaller ones are not needed.
        """
        width = queries.shape[1]
        best = np.where(queries[:, None] > 0, self.high, self.low) * queries[:, None]  # by query, segment, dimension
        alive = np.flatnonzero(best.max(axis=1, initial=LEAST).sum(axis=1) >= floors)
        out = []
        queries, own, floors, best = queries[alive], own[alive], floors[alive], best[alive]
        read, n_read = 0, np.zeros(len(alive), np.int64)
        least = best.min(axis=1)
        gain = best - least[:, None]
        impact = -(-gain * IMPACTS // np.maximum(gain.max(axis=(1, 2), initial=0), 1)[:, None, None])
        for cut in (*CUTS, 1.0):
            if not len(alive):
                break
            if cut < 1 and width:
                order = np.sort(impact.reshape(len(alive), -1), axis=1)
                done = impact >= order[:, -int(order.shape[1] * cut) or -1][:, None, None]
                left = np.where(done, 0, gain).max(axis=1)  # what a dimension can still give
                reading = np.where(done, gain, left[:, None])
                flat = reading.transpose(0, 2, 1).reshape(len(alive), width * SEGMENTS)
                read, n_read = read + int(done.sum() - n_read.sum()), done.sum(axis=(1, 2))
                reach = product(flat, self.postings, width) + least.sum(axis=1)[:, None]
            else:  # all are read: a dimension gives its segment's best value
                up, down = np.maximum(queries, 0), np.minimum(queries, 0)
                dims = np.arange(width)
                reach = product(up, self.high[self.segments, dims]) + product(down, self.low[self.segments, dims])
                read += len(alive) * width * SEGMENTS - int(n_read.sum())
            reach = np.where(self.ids == own[:, None], LEAST, reach)
            floors = self._floors(queries, own, k, reach, floors)
            possible = (reach >= floors[:, None]) & (self.ids != own[:, None])
            ended = (possible.sum(axis=1) <= FEW) | (cut == 1)
            row, doc = np.nonzero(possible[ended])
            row = np.flatnonzero(ended)[row]
            scores = np.concatenate(
                [np.einsum("pd,pd->p", self.vectors[doc[a : a + 65536]], queries[row[a : a + 65536]]) for a in range(0, len(row), 65536)]
                or [np.zeros(0, np.int64)]
            )
            order = np.lexsort((self.ids[doc], ~scores, row))
            row, doc, scores = row[order], doc[order], scores[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((alive[row[kept]], self.ids[doc[kept]], scores[kept]))
            on = ~ended
            alive, queries, own, floors = alive[on], queries[on], own[on], floors[on]
            least, gain, impact, n_read = least[on], gain[on], impact[on], n_read[on]
        rows, ids, scores = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 3))
        return rows, ids, scores, read


def _search(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Queries of each cell against its block; those of the block itself only where the cell says so."""
    block, at = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {name: batch.column(name)[i] for name in batch.schema.names}
            place = (cell["part"].as_py(), cell["seq"].as_py())
            if place != at:
                block, at = Block({c: cell[c].as_py() for c in STORED}, width), place
            asked = [q for q in cell["q"].as_py() if cell["home"].as_py() or (q["part"], q["seq"]) != place]
            ids = np.array([q["vec_id"] for q in asked], np.int64)
            floors = np.array([LEAST if q["floor"] is None else q["floor"] for q in asked], np.int64)
            for a in range(0, len(ids), BATCH):
                some = slice(a, a + BATCH)
                vectors = _matrix([q["v"] for q in asked[some]], width)
                rows, found, scores, _ = block.top(vectors, ids[some], k, floors[some])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some][rows], found, scores)], ["query_id", "vec_id", "score"])


def _range(q: Column, pick) -> Column:
    """Per dimension the highest or lowest component of a list of queries; missing ones are zero."""
    none = F.lit(0).cast("long")
    both = lambda a, b: pick(F.coalesce(a, none), F.coalesce(b, none))
    return F.aggregate(q, q[0]["v"], lambda so_far, one: F.zip_with(so_far, one["v"], both))


def _within_reach() -> Column:
    """Whether the best score of any query within a range with any vector of a block can reach the floor."""
    best = lambda pair: F.greatest(*(pair[q].cast("double") * pair[b] for q in ("q_high", "q_low") for b in ("highest", "lowest")))
    arrays = [F.col(c) for c in ("q_high", "q_low", "highest", "lowest")]
    products = F.transform(F.arrays_zip(*arrays), lambda pair: F.coalesce(best(pair), F.lit(0.0)))
    total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    rounding = F.aggregate(products, F.lit(0.0), lambda a, x: a + F.abs(x)) * 1e-9
    return total + rounding >= F.col("least")


def top_k(
    table: DataFrame, queries: Column, k: int = 5, id_col="vec_id", vector_col="embedding"
) -> DataFrame:
    """The k best of all other vectors for each query: query_id, rank, vec_id, score.

    `queries` picks the query rows by `vec_id`. Ties go to the smaller id. Vectors that are
    null or hold null or non-finite components take no part, nor do rows without id; of
    rows with one id the smallest vector counts; shorter vectors count as filled up with
    zeros. Fewer others than k: all of them. Only the two named columns are read. An empty table
    gives no rows. A query first meets the block it lies in, which gives it a floor, and then,
    in groups of a thousand or so from one part of the curve, the other blocks that can reach it.
    Acts at once.
    """
    rows = stage(vectors_of(table, id_col, vector_col))
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width, parts = width or 0, max(1, -(-n // (BLOCK * BLOCKS_A_PART)))

    def key(vectors: pd.Series) -> pd.Series:
        return curve_key(vectors, width)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return index_block(group, width)

    line = ["key", "vec_id"]
    along = rows.withColumn("key", F.pandas_udf(key, "long")("v")).repartitionByRange(parts, *line).sortWithinPartitions(*line)
    placed = stage(along.select("vec_id", "v").mapInArrow(partial(_place, size=BLOCK), "part int, seq int, vec_id long, v array<long>"))
    index = stage(placed.groupBy("part", "seq").applyInPandas(build, INDEX))
    blocks = index.select("part", "seq", *STORED)
    asked = placed.where(queries)
    splits = max(1, -(-asked.count() // (QUERIES * parts)))
    one = F.sort_array(F.collect_list(F.struct("vec_id", "part", "seq", "v", "floor")))

    def search(cells: DataFrame) -> DataFrame:
        met = cells.join(blocks, ["part", "seq"]).select("part", "seq", "home", "q", *STORED)
        return met.mapInArrow(partial(_search, k=k, width=width), FOUND)

    own = asked.withColumn("floor", F.lit(None).cast("long")).groupBy("part", "seq").agg(one.alias("q"))
    first = stage(search(own.withColumn("home", F.lit(True))))
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
    known = asked.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")

    split = F.pmod(F.xxhash64("vec_id"), F.lit(splits))
    groups = known.groupBy(F.col("part").alias("q_part"), split.alias("split"))
    groups = groups.agg(one.alias("q"), F.min(F.coalesce("floor", F.lit(LEAST))).alias("least"))
    groups = groups.withColumns({"q_high": _range(F.col("q"), F.greatest), "q_low": _range(F.col("q"), F.least)})
    last = index.groupBy("part").agg(F.max("seq").alias("last"))
    cells = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(last, "part")
    cells = cells.withColumn("seq", F.explode(F.sequence(F.lit(0), "last")))
    cells = cells.join(index.select("part", "seq", "highest", "lowest"), ["part", "seq"]).where(_within_reach())
    found = first.unionByName(search(cells.withColumn("home", F.lit(False))))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
