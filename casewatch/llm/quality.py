"""Quality rules with thresholds learned per language and source.

Measures of a text are computed inside its row. For each language and source, mergeable
quantile sketches hold their distributions; a document fails where it lies far outside the
middle half of its own group. The quartiles of a group are blended with those of its language, and
these with those of all documents, each by how many values it has: n / (n + `PRIOR`). So no
group's rule changes at some size. Only DataFrame functions are used.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    """A measure, the least spread that counts as one, and whether small values fail too."""

    measure: str
    spread: float
    both_sides: bool = False


RULES = (
    Rule("mean_word", 1.5, both_sides=True),
    Rule("symbols_per_word", 0.05),
    Rule("dup_line_share", 0.1),
    Rule("repeat_share", 0.05),
)
SKETCH_SIZE, REACH, PRIOR, GRID = 2000, 3.0, 100, 0.05


def measured(docs: DataFrame, text_col="text") -> DataFrame:
    """The rows with the measures of their texts; a null text has no words.

    Repeated words are those in any window of five that the text has twice or more, the
    first included. Windows are compared by 64-bit hashes within their text only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_words", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))),
    )
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_spans", F.when(F.col("n_words") >= WINDOW, spans).otherwise(none)).drop("_words")
    again = F.size(F.array_distinct("_spans")) < F.size("_spans")
    placed = F.sort_array(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(again, placed)).drop("_spans")
    twice = F.filter(
        "_placed",
        lambda x, k: (F.get("_placed", k - 1)["h"] == x["h"]) | F.coalesce(F.get("_placed", k + 1)["h"] == x["h"], F.lit(False)),
    )
    places = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + WINDOW - 1))))
    out = out.withColumn("n_repeat_words", F.when(F.col("_placed").isNotNull(), F.size(places)).otherwise(0).cast("long"))
    out = out.drop("_placed").withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_lines", F.size("_lines").cast("long"))
    out = out.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_lines"))).drop("_lines")
    return out.withColumn("word_chars", F.length(F.translate(text, SEPARATORS, "")).cast("long")).withColumn(
        "n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    )


def base_failed() -> Column:
    """The plain rules: too few words, or too many of them repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(above: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(above) / F.col(below))


def _shares(rows: DataFrame) -> DataFrame:
    """The measures that rules look at, null where the text has no word."""
    return (
        rows.withColumn("mean_word", _ratio("word_chars", "n_words"))
        .withColumn("symbols_per_word", _ratio("n_symbols", "n_words"))
        .withColumn("dup_line_share", _ratio("n_dup_lines", "n_lines"))
        .withColumn("repeat_share", _ratio("n_repeat_words", "n_words"))
    )


def _blended(share: float, *sketches: Column) -> Column:
    """Quantile of the first sketch, drawn towards that of the second, itself drawn towards the next."""
    out = F.lit(None).cast("double")
    for sketch in reversed(sketches):
        n = F.kll_sketch_get_n_double(sketch)
        own = F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
        out = F.coalesce((n * own + PRIOR * F.coalesce(out, own)) / (n + PRIOR), out)
    return out


def thresholds(rows: DataFrame, lang_col="lang", source_col="source") -> DataFrame:
    """Lowest and highest passing value of each rule, per language and source.

    One sketch per group, measure and task is merged on the way, so no group is gathered;
    bounds are rounded outwards to a grid, which steadies them against the sketches' error.
    A measure that no document of a group has is judged by the wider group alone; one that
    none has at all gets null bounds. Repeated rows count as often as they occur. An empty table gives no bounds.
    """
    names = [r.measure for r in RULES]
    groups = _shares(rows).groupBy(F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"))
    own = groups.agg(
        F.count("n_words").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_SIZE)).alias(m) for m in names)
    )
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_SIZE)).alias(m) for m in names)]
    by_lang = own.groupBy(F.col("g_lang").alias("l_lang")).agg(*merged)
    of_all = own.agg(*merged)

    def renamed(df, prefix):
        return df.select(*(F.col(c).alias(f"{prefix}_{c}" if c in ("n", *names) else c) for c in df.columns))

    levels = own.join(renamed(by_lang, "lang"), F.col("g_lang").eqNullSafe(F.col("l_lang")))
    levels = levels.withColumn("all", of_all.select(F.struct(*names)).scalar())  # one row
    out = [F.col("g_lang"), F.col("g_source")]
    for rule in RULES:
        sketches = [F.col(c) for c in (rule.measure, f"lang_{rule.measure}", f"all.{rule.measure}")]
        low, high = (_blended(q, *sketches) for q in (0.25, 0.75))
        reach = REACH * F.greatest(high - low, F.lit(rule.spread))
        out.append((F.ceil((high + reach) / GRID) * GRID).alias(f"most_{rule.measure}"))
        if rule.both_sides:
            out.append((F.floor((low - reach) / GRID) * GRID).alias(f"least_{rule.measure}"))
    return levels.select(*out)


def judged(rows: DataFrame, bounds: DataFrame, lang_col="lang", source_col="source") -> DataFrame:
    """The measured rows with `base_failed` and `kept`; a measure that a text does not have passes.

    Repeated rows are judged alike, each once. An empty table stays empty.
    """
    own = F.col(lang_col).eqNullSafe(F.col("g_lang")) & F.col(source_col).eqNullSafe(F.col("g_source"))
    passed = F.lit(True)
    for rule in RULES:
        passed &= F.coalesce(F.col(rule.measure) <= F.col(f"most_{rule.measure}"), F.lit(True))
        if rule.both_sides:
            passed &= F.coalesce(F.col(rule.measure) >= F.col(f"least_{rule.measure}"), F.lit(True))
    joined = _shares(rows).join(bounds, own, "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed)


def kept_documents(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """The documents that pass, with the columns they have.

    Measures are written to the shared folder with the rows, once; thresholds then read
    the measures alone. Null languages and sources are groups of their own. An empty table stays empty.
    """
    names = docs.columns
    row = docs.select(
        F.struct(*names).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    rows = stage(measured(row).drop("text"))
    return judged(rows, thresholds(rows)).where("kept").select("row.*")
