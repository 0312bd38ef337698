"""Language of a text by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram of letters binds (multiplies)
its letters' vectors, each rotated by the letter's place; a text bundles (adds) those of
all its n-grams. A language's prototype bundles the unit vectors of its texts. A text has the
language whose prototype lies at the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.buffers import code_points, slices
from casewatch.llm.vectors import PARTS, chunks, part_batch, summed

DIMENSIONS, ORDER = 1024, 3
UNDETERMINED = "und"
TYPES_AT_ONCE, DOCS_AT_ONCE = 16384, 128
TABLE = 1 << 23


@lru_cache(maxsize=None)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=1 << 14)
def _letter(code: int) -> np.ndarray:
    """The vector of a letter; code 0 is the gap between words."""
    return np.random.default_rng([9, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def _distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers under `below` and the place of each value among them; by a table while that is small."""
    if below > TABLE:
        return np.unique(values, return_inverse=True)
    present = np.zeros(below, bool)
    present[values] = True
    found = np.flatnonzero(present)
    place = np.zeros(below, np.int32)
    place[found] = np.arange(len(found))
    return found, place[values]


def _grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams spelled out, and a document and n-gram index of each occurrence.

    Runs of anything but letters count as one gap; every text starts and ends with one.
    """
    codes, offsets = code_points(texts)
    length = np.diff(offsets)
    letters = np.zeros(len(codes) + 2 * len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    letters[np.arange(len(codes)) + 2 * owner + 1] = np.where(_is_letter()[np.minimum(codes, 0x10FFFF)], codes, 0)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), length + 2)
    keep = letters > 0
    keep[1:] |= keep[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    doc, letters = doc[keep], letters[keep]
    has = np.zeros(len(texts), bool)
    has[doc[letters > 0]] = True
    alphabet, small = _distinct(letters, 0x110000)
    n = max(len(small) - ORDER + 1, 0)
    gram = np.zeros(n, np.int64)
    for i in range(ORDER):
        gram = gram * len(alphabet) + small[i : n + i]
    whole = (doc[:n] == doc[ORDER - 1 : n + ORDER - 1]) & has[doc[:n]]
    types, index = _distinct(gram[whole], len(alphabet) ** ORDER)
    spelled = np.empty((len(types), ORDER), np.int64)
    for i in reversed(range(ORDER)):
        spelled[:, i], types = alphabet[types % len(alphabet)], types // len(alphabet)
    return spelled, doc[:n][whole], index


def _bind(spelled: np.ndarray) -> np.ndarray:
    letters, at = np.unique(spelled, return_inverse=True)
    table = np.stack([_letter(int(c)) for c in letters])
    at = at.reshape(spelled.shape)
    out = np.ones((len(spelled), DIMENSIONS), np.int8)
    for i in range(ORDER):
        out *= np.roll(table, ORDER - 1 - i, axis=1)[at[:, i]]
    return out


def profiles(texts) -> np.ndarray:
    """Bundled vector of each text, zero where it has no letter."""
    spelled, doc, index = _grams(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(spelled), TYPES_AT_ONCE):
        block = _bind(spelled[at : at + TYPES_AT_ONCE]).astype(np.float32)
        for low in range(0, len(texts), DOCS_AT_ONCE):
            a, b = np.searchsorted(doc, [low, low + DOCS_AT_ONCE])
            rows, places = doc[a:b] - low, index[a:b] - at
            if len(spelled) > TYPES_AT_ONCE:
                mine = (places >= 0) & (places < len(block))
                rows, places = rows[mine], places[mine]
            height = min(DOCS_AT_ONCE, len(texts) - low)
            cells = rows.astype(np.int64) * len(block) + places
            counts = np.bincount(cells, minlength=height * len(block)).reshape(height, len(block))
            out[low : low + height] += counts.astype(np.float32) @ block
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), object)
        for a, b, texts in slices(batch.column(0)):
            units = _unit(profiles(texts)).astype(np.float64)
            for language in set(languages[a:b]):
                total = sums.setdefault(language, np.zeros(DIMENSIONS))
                total += units[languages[a:b] == language].sum(axis=0)
    salt = TaskContext.get().partitionId()
    rows = [row for language, total in sums.items() for row in chunks(language, total, salt)]
    yield from part_batch(rows)


def learn_profiles(docs: DataFrame, lang_col="lang", text_col="text") -> dict[str, np.ndarray]:
    """A unit prototype per language. Rows without language do not count.

    Each task adds up its own texts, so a language that holds most rows costs no more than
    another; the driver keeps one vector of fixed length per language.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = summed(known.mapInArrow(_bundle, PARTS), DIMENSIONS)
    return {language: _unit(total) for language, total in sums.items()}


def _compare(batches: Iterator[pa.RecordBatch], names: list[str], prototypes: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = np.array([*names, UNDETERMINED], object)
    for batch in batches:
        for a, b, texts in slices(batch.column(1)):
            vectors = _unit(profiles(texts))
            cosine = vectors @ prototypes.T
            known = vectors.any(axis=1) & bool(len(prototypes))
            best = np.where(known, cosine.argmax(axis=1) if len(prototypes) else 0, len(names) - 1)
            score = np.where(known, np.clip(cosine.max(axis=1, initial=0.0), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))],
                ["doc_id", "lang_pred", "score"],
            )


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col="doc_id", text_col="text") -> DataFrame:
    """Nearest language of each text and the cosine with it, at least 0.

    A null text and one without a letter are `und` with score 0, and so is every text when
    nothing was learned. Of equal angles the language first by code point is taken. Only
    the two named columns are read; the result is one row per row.
    """
    names = sorted(prototypes)
    table = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_compare, names=names, prototypes=table), "doc_id long, lang_pred string, score double")
