"""Near-duplicate documents: an exact Jaccard join on word shingles by rare-first prefixes.

A document's shingles are ordered by how many documents have them, rare ones first. Two
sets with the asked similarity share one of their first few shingles, are about equally
long, and have enough left behind the first one they share. Documents with the same set
are one class, and only classes are joined. In every list of classes with a common prefix
shingle, the one with the least before it is compared with the others first; pairs that are
connected by then are not looked at again, so a large group of near copies does not
become all its pairs. Each remaining pair is verified once, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casewatch.llm.buffers import Texts, mix, slices, text_arrays
from casewatch.llm.components import components
from casewatch.llm.vectors import PARTS, chunks, part_batch, summed
from casewatch.session import stage

WORDS = 5
COUNTER_BITS = 20
SEEN_CLASSES = 1 << 16
TEXT_BYTES = 1 << 20  # of texts whose shingles are held at a time
PAIRS = 1 << 11  # of sets that are compared at a time
SIEVE_BITS = 20  # places of a table of fixed size that tells which texts can be of wanted classes
PARTS_OF_SET = 64
_LOW = np.uint64((1 << 56) - 1)


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, by document and value, and where those of each document start.

    Words are compared with A-Z in lower case. A document of fewer than five words has its
    whole sequence as its only shingle.
    """
    start, end, doc = texts.words()
    words = texts.hashes(start, end, lower=True)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    found, owner = [], []
    if len(words) >= WORDS:
        value = np.zeros(len(words) - WORDS + 1, np.uint64)
        for i in range(WORDS):
            value = mix(value * np.uint64(31) + words[i : len(words) - WORDS + 1 + i] + np.uint64(WORDS))
        whole = doc[: len(value)] == doc[WORDS - 1 :]
        found.append(value[whole])
        owner.append(doc[: len(value)][whole])
    for length in range(1, WORDS):
        short = np.flatnonzero(n == length)
        value = np.zeros(len(short), np.uint64)
        for i in range(length):
            value = mix(value * np.uint64(31) + words[first[short] + i] + np.uint64(length))
        found.append(value)
        owner.append(short)
    value, doc = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for batch in batches:
        for _, _, texts in slices(batch.column(0), TEXT_BYTES):
            value, _ = shingles(texts)
            place = (value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
            counts += np.bincount(place, minlength=len(counts))
    counts = np.minimum(counts, (1 << 32) - 1)
    yield from part_batch(chunks("", counts, TaskContext.get().partitionId(), "<u4"))


def levels(docs: DataFrame, text_col="text") -> np.ndarray:
    """How frequent shingles are, by a table of counters of fixed size, on a log scale.

    Only the order of shingles within a prefix depends on it, never which pairs are found.
    """
    counted = docs.select(text_col).mapInArrow(_count, PARTS)
    counts = summed(counted, 1 << COUNTER_BITS, "<u4").get("", np.zeros(1 << COUNTER_BITS))
    return np.minimum(255, 8 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8)


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _classes(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same number for equal sets, of a length that goes with it."""
    return mix(_sum_by(mix(value + np.uint64(0x51ED270B)), offsets))


def _fresh(own: np.ndarray, n: np.ndarray, seen: set) -> np.ndarray:
    """Which classes a task has not had before, as far as it remembers."""
    fresh = np.zeros(len(n), bool)
    for i, key in enumerate(zip(own.tolist(), n.tolist())):
        if key not in seen:
            fresh[i] = True
            seen.add(key)
            if len(seen) > SEEN_CLASSES:
                seen.clear()
    return fresh


def _prefixes(batches: Iterator[pa.RecordBatch], shared, percent: int) -> Iterator[pa.RecordBatch]:
    level, seen = shared.value, set()
    for batch in batches:
        for a, b, texts in slices(batch.column(1), TEXT_BYTES):
            value, offsets = shingles(texts)
            n = np.diff(offsets)
            own = _classes(value, offsets)
            token = level[(value >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
            token |= value & _LOW
            doc = np.repeat(np.arange(len(n)), n)
            token = token[np.lexsort((token, doc))]
            place = np.arange(len(token)) - offsets[:-1][doc]
            length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            # A class that this task has had before adds nothing to the lists.
            length = np.where(_fresh(own, n, seen), length, 0)
            kept = place < length[doc]
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), _int64(token[kept]))
            columns = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int32)), _int64(own)]
            columns += [pa.array([x.tobytes() for x in _signature(value, offsets)], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "class", "signature", "prefix"])


def _signature(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many shingles of each set lie in each of some equal intervals of hash values."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * PARTS_OF_SET + (value >> np.uint64(58)).astype(np.int64)
    return np.bincount(cell, minlength=n * PARTS_OF_SET).reshape(n, PARTS_OF_SET).astype("<u4")


def _suffix(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Suffix filter: parts of equal hash intervals can share no more than the smaller has."""
    for batch in batches:
        x, y = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, PARTS_OF_SET).astype(np.int64)
            for i in (2, 3)
        )
        both, total = np.minimum(x, y).sum(axis=1), x.sum(axis=1) + y.sum(axis=1)
        yield batch.select([0, 1]).filter(pa.array(100 * both >= percent * (total - both)))


def _places(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(np.uint64) + np.uint64(0)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(1 << SIEVE_BITS, np.int64)
    for batch in batches:
        marks[_places(np.asarray(batch.column(0)))] = 1
    yield from part_batch(chunks("", marks, TaskContext.get().partitionId(), "<u4"))


def _sets(batches: Iterator[pa.RecordBatch], sieve) -> Iterator[pa.RecordBatch]:
    """Sets of wanted classes; a class that this task has had before is not sent again."""
    marks, seen = sieve.value, set()
    for batch in batches:
        for _, _, texts in slices(batch.column(0), TEXT_BYTES):
            value, offsets = shingles(texts)
            own = _classes(value, offsets)
            n = np.diff(offsets)
            chosen = np.flatnonzero(marks[_places(own.view(np.int64))] & (n > 0))
            chosen = chosen[_fresh(own[chosen], n[chosen], seen)]
            sets = [value[offsets[i] : offsets[i + 1]].tobytes() for i in chosen]
            yield pa.RecordBatch.from_arrays([_int64(own[chosen]), pa.array(sets, pa.binary())], ["class", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAIRS):
            some = batch.slice(at, PAIRS)
            (x, x_at), (y, y_at) = (text_arrays(some.column(i)) for i in (2, 3))
            x, y, x_at, y_at = x.view(np.uint64), y.view(np.uint64), x_at // 8, y_at // 8
            n, m = np.diff(x_at), np.diff(y_at)
            both = np.array(
                [
                    len(np.intersect1d(x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]], assume_unique=True))
                    for i in range(len(n))
                ],
                np.int64,
            )
            yield some.select([0, 1]).filter(pa.array(100 * both >= percent * (n + m - both)))


def _fits(n: str, m: str, before: str, other: str, percent: int) -> Column:
    """Length and positional filter: what follows the first common shingle must suffice."""
    n, m, before, other = F.col(n), F.col(m), F.col(before), F.col(other)
    least = percent * (n + m) / (100 + percent)  # what both must share
    equal = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return equal & (F.least(n - before, m - other) >= least)


def _linked(pairs: DataFrame, texts: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose whole sets are similar enough; each pair is verified once."""
    spark = pairs.sparkSession
    a = signatures.select(F.col("class").alias("a"), F.col("signature").alias("x"))
    b = signatures.select(F.col("class").alias("b"), F.col("signature").alias("y"))
    likely = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    pairs = stage(likely.mapInArrow(partial(_suffix, percent=percent), "a long, b long"))
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    marks = summed(wanted.mapInArrow(_mark, PARTS), 1 << SIEVE_BITS, "<u4").get("", np.zeros(1 << SIEVE_BITS))
    sieve = spark.sparkContext.broadcast(marks > 0)
    sets = texts.select("text").mapInArrow(partial(_sets, sieve=sieve), "class long, shingles binary")
    # Equal sets become one in the tasks, then one per task, before they meet the classes.
    sets = sets.dropDuplicates(["class"]).join(wanted, F.col("class") == wanted["a"], "left_semi")
    sets = stage(sets)
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    whole = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return stage(whole.mapInArrow(partial(_verify, percent=percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest id that links reach.

    Two documents are linked when 100 * shared >= percent * (all of both). A null text, or
    one without words, has no shingles and stays alone under its own id. Rows with equal
    text are linked whatever their ids; a null id counts as none, so a component of such
    rows only has a null id. Only the two named columns are read. Acts at once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = spark.sparkContext.broadcast(levels(rows))  # a table of fixed size
    shape = "doc_id long, n int, class long, signature binary, prefix array<long>"
    light = stage(rows.mapInArrow(partial(_prefixes, shared=level, percent=percent), shape))
    listed = light.select("class", "n", F.posexplode("prefix").alias("before", "token"))
    first = W.partitionBy("token").orderBy("before", "n", "class")
    whole = W.partitionBy("token")
    lists = listed.select(
        "token", "class", "n", "before",
        *(F.first(c).over(first).alias(f"p_{c}") for c in ("class", "n", "before")),
        F.min("class").over(whole).alias("low"),
        F.max("class").over(whole).alias("high"),
    )
    lists = stage(lists.where("low <> high").drop("low", "high"))

    reps = light.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    signatures = light.where("size(prefix) > 0").dropDuplicates(["class"]).select("class", "signature")

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    stars = lists.where(F.col("class") != F.col("p_class")).where(_fits("n", "p_n", "before", "p_before", percent))
    edges = _linked(pairs(stars, "class", "p_class"), rows, signatures, percent)
    group = components(edges)

    grouped = lists.join(group, lists["class"] == group["node"], "left")
    grouped = grouped.select("token", "class", "n", "before", F.coalesce("component", "class").alias("group"))
    several = F.min("group").over(whole) != F.max("group").over(whole)
    open_ = stage(grouped.withColumn("several", several).where("several").drop("several"))
    other = open_.select("token", *(F.col(c).alias(f"o_{c}") for c in ("class", "n", "before", "group")))
    apart = open_.join(other, "token").where("class < o_class AND group <> o_group")
    apart = apart.where(_fits("n", "o_n", "before", "o_before", percent))
    more = stage(pairs(apart, "class", "o_class"))
    if more.head(1):
        group = components(edges.unionByName(_linked(more, rows, signatures, percent)))

    named = reps.join(group, reps["class"] == group["node"], "left")
    named = stage(named.select("class", "doc_id", F.coalesce("component", "class").alias("group")))
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "group").select("class", "component_id")
    out = light.where("n > 0").join(named, "class")
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = light.where("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, percent: int = 80, id_col="doc_id", text_col="text") -> DataFrame:
    """One document of each component, the one with the smallest id (null last), with the columns it has.

    Documents without words stay. Of rows equal in id and text one stays, whatever else
    they hold.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), F.xxhash64(id_col, text_col).alias("key"))
    plain = keyed.select("key", F.col(f"row.{id_col}").cast("long").alias("own"), F.col(f"row.{text_col}").alias("text"))
    group = near_duplicates(plain, percent, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    ids = plain.select("key", "own").distinct()
    first = F.min(F.struct(F.col("own").isNull().alias("unknown"), "own", "key"))
    kept = group.distinct().join(ids, "key").groupBy("component_id").agg(first.alias("first"))
    kept = stage(kept.select(F.col("first.key").alias("key")))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
