"""Mix of sources by target weights: entropy balancing and rounding to copies.

Every source has a token target. Among all document rates that meet the targets, those
nearest to one copy each (in relative entropy, at most `cap`) are exponentially tilted by
the document's size: rate = min(cap, exp(multiplier * size / mean size)). The multipliers
solve a convex dual, by Newton steps over the whole table of sizes. Rates become copies by
a threshold on a hash of the document, chosen so that each source meets its target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.session import stage

WORD = r"[^\x20\x09-\x0D]+"
POINTS, STEP = 41, 9  # bits of a document's rounding point, and those settled in one pass
NEWTON_STEPS, TOLERANCE = 60, 1e-9
PLAN = (
    "source string, source_size long, target double, multiplier double, mean double, "
    "point long, tied_size long, rest double"
)


class Source(NamedTuple):
    name: str | None
    size: int
    n: int
    target: float


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, tuple[int, int]], weights: Sequence[float], share: float, cap: float) -> list[Source]:
    """Targets of sources by code point, null last: shares of `share` of all sizes by the
    repeated weights, none above `cap` times its source; the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(n for n, _ in sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s][0]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(cap * sizes[s][0]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return [Source(s, *sizes[s], target[s]) for s in names]


def _rate(cap: float) -> Column:
    return F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))


def _joined(df: DataFrame, rows: list[tuple], shape: str) -> DataFrame:
    """The frame with a small table of sources; Spark broadcasts it while it is small."""
    small = df.sparkSession.createDataFrame(rows, shape).withColumnRenamed("source", "_source")
    return df.join(small, df["source"].eqNullSafe(small["_source"])).drop("_source")


def _multipliers(by_size: DataFrame, sources: list[Source], cap: float) -> dict[str | None, float]:
    """Solution of the dual for each source; infinite where all documents are at the cap."""
    found = {s.name: math.inf if s.target >= cap * s.size else 0.0 for s in sources}
    open_ = {s.name: [s, -math.inf, math.inf] for s in sources if 0 < s.target < cap * s.size}
    shape = "source string, multiplier double, mean double"
    x = F.col("size") / F.col("mean")
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        rows = [(name, found[name], s.size / s.n) for name, (s, _, _) in open_.items()]
        rated = _joined(by_size, rows, shape).withColumn("tokens", _rate(cap) * F.col("size") * F.col("n"))
        free = F.col("multiplier") * x < math.log(cap)
        sums = rated.groupBy("source").agg(F.sum("tokens"), F.sum(F.when(free, x * F.col("tokens"))))
        for name, tokens, slope in sums.collect():
            s, low, high = open_[name]
            miss = tokens - s.target
            if abs(miss) <= TOLERANCE * s.target:
                del open_[name]
                continue
            low, high = (low, found[name]) if miss > 0 else (found[name], high)
            new = found[name] - miss / slope if slope else math.nan
            if not low < new < high:  # a step out of what is known is replaced by halving or doubling
                if math.isinf(high):
                    new = 2 * max(low, 0.5)
                else:
                    new = (low + high) / 2 if math.isfinite(low) else 2 * min(high, -0.5)
            found[name], open_[name] = new, [s, low, high]
    return found


def _drawn(sized: DataFrame, cap: float) -> DataFrame:
    """Rate, whole copies and rounding point of each document."""
    rate = F.when(F.isnan("multiplier") | (F.col("multiplier") == math.inf), F.lit(float(cap))).otherwise(_rate(cap))
    out = sized.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    uniform = F.pmod("draw", F.lit(1 << 40)) / F.lit(float(1 << 40))
    point = F.floor((uniform - (F.col("rate") - F.col("whole")) + 1) * F.lit(float(1 << 40)))
    can = (F.col("whole") < cap) & (F.col("size") > 0)
    return out.withColumn("at", F.when(can, F.least(F.greatest(point, F.lit(0)), F.lit((1 << POINTS) - 1))))


def plan(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source: its target, multiplier and rounding point.

    `sized` has source, size and draw (a hash) per document. Sums per source reach the
    driver, never documents. The source without rows does not occur; one without words
    has target 0.
    """
    sizes = {r["source"]: (r["size"], r["n"]) for r in _totals(sized).collect()}
    sources = targets(sizes, weights, share, cap)
    by_size = stage(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    found = _multipliers(by_size, sources, cap)
    shape = "source string, multiplier double, mean double"
    rows = [(s.name, found[s.name], max(s.size, 1) / s.n) for s in sources]
    drawn = stage(_drawn(_joined(sized, rows, shape), cap).select("source", "size", "whole", "at"))
    taken = dict(drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("size"))).collect())
    rest = {s.name: max(0.0, s.target - (taken[s.name] or 0)) for s in sources}
    prefix, tied = {s.name: 0 for s in sources}, {}
    shift = POINTS
    while shift:  # settle the next bits of the point at which a source has its words
        step = min(STEP, shift)
        inside = _joined(drawn.where("at IS NOT NULL"), list(prefix.items()), "source string, prefix long")
        inside = inside.where(F.shiftright("at", shift) == F.col("prefix"))
        shift -= step
        bins = inside.groupBy("source", F.shiftright("at", shift).alias("bin")).agg(F.sum("size").alias("size"))
        by_source: dict[str | None, list] = {}
        for source, place, size in bins.collect():
            by_source.setdefault(source, []).append((place, size))
        prefix = {}
        for source, places in by_source.items():
            for place, size in sorted(places):
                prefix[source], tied[source] = place, size
                if rest[source] < size:
                    break
                rest[source] -= size
            else:  # all of them fit
                prefix[source], tied[source] = place + 1, 0
    rows = [
        (s.name, s.size, s.target, found[s.name], max(s.size, 1) / s.n, prefix.get(s.name, 0), tied.get(s.name, 0))
        + (float(rest[s.name]),)
        for s in sources
    ]
    return sized.sparkSession.createDataFrame(rows, PLAN)


def _totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def draw_of(id_col: str, text_col: str) -> Column:
    """What a document's rounding depends on; the same in every run."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def apply_plan(sized: DataFrame, planned: DataFrame, cap: int = 2, cut: bool = True) -> DataFrame:
    """Rate, copies and taken words of each document, besides what it has.

    With `cut`, the document at a source's rounding point gives only the words that are
    still missing, so the target is met to a word; several documents at one point share
    them by size. Without, it is taken whole if at least half of it is missing.
    """
    planned = planned.withColumnRenamed("source", "_source")
    joined = sized.join(planned, sized["source"].eqNullSafe(planned["_source"])).drop("_source")
    drawn = _drawn(joined, cap)
    part = F.when(F.col("tied_size") > 0, F.col("rest") / F.col("tied_size")).otherwise(0.0)
    last = F.round(F.col("size") * part) if cut else F.when(part >= 0.5, F.col("size")).otherwise(0)
    more = F.when(F.col("at") < F.col("point"), F.col("size")).when(F.col("at") == F.col("point"), last).otherwise(0)
    drawn = drawn.withColumn("taken", (F.col("whole") * F.col("size") + F.coalesce(more, F.lit(0))).cast("long"))
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.col("whole"))
    return drawn.withColumn("copies", full.cast("int")).drop(
        "multiplier", "mean", "point", "tied_size", "rest", "whole", "at", "draw"
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, cap=2, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, taken and copies of every document.

    A null text has size 0; documents without words have rate and copies but no words. A
    null source is a source of its own, last in order. Rows equal in id and text share one
    rounding point. An empty table gives no rows. Only the three named columns are read.
    """
    sized = stage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            draw_of(id_col, text_col).alias("draw"),
        )
    )
    return apply_plan(sized, plan(sized, weights, share, cap), cap)


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share=1.5, cap=2, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, whole; columns as given."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("source"))
    row = row.withColumn("size", n_words(F.col(f"row.{text_col}")))
    sized = row.withColumn("draw", draw_of(f"row.{id_col}", f"row.{text_col}"))
    planned = plan(stage(sized.drop("row")), weights, share, cap)
    taken = apply_plan(sized, planned, cap, cut=False)
    often = taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select("row.*")
