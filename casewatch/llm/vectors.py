"""Sums of long vectors over all tasks, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 13
PARTS = "key string, chunk int, salt int, value binary"


def chunks(key: str | None, vector: np.ndarray, salt: int, kind: str = "<f8") -> list[tuple]:
    """Rows of `PARTS` with the non-zero chunks of a vector."""
    vector = vector.astype(kind)
    return [
        (key, i, salt % 256, vector[at : at + CHUNK].tobytes())
        for i, at in enumerate(range(0, len(vector), CHUNK))
        if vector[at : at + CHUNK].any()
    ]


def part_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows as one batch, if there are any."""
    if rows:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "salt", "value"])


def _sum(group: pd.DataFrame, kind: str) -> pd.DataFrame:
    total = np.frombuffer(group["value"].iloc[0], kind).copy()
    for value in group["value"].iloc[1:]:
        total += np.frombuffer(value, kind)
    return group.iloc[:1].assign(value=[total.tobytes()])


def summed(parts: DataFrame, size: int, kind: str = "<f8") -> dict[str | None, np.ndarray]:
    """Vectors per key, added up in two steps; the driver receives one vector per key."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return _sum(group, kind)

    for groups in (["key", "chunk", "salt"], ["key", "chunk"]):
        parts = parts.groupBy(*groups).applyInPandas(add, PARTS)
    out: dict[str | None, np.ndarray] = {}
    for row in parts.select("key", "chunk", "value").toArrow().to_pylist():  # one job, however many partitions
        vector = out.setdefault(row["key"], np.zeros(size, kind))
        value = np.frombuffer(row["value"], kind)
        vector[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(value)] = value
    return out


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id, as text, leaves a remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
