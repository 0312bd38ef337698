"""License notices by phrases and by an exact set-similarity join with notice templates.

A template is a set of words. Texts are cut into overlapping blocks of words, of a length that
suits each template, so that a notice wherever it stands lies whole in a block. A block matches
if it holds at least a given share of the template's words. The words of all templates are
ordered by how often they occur in the whole table, rarest first. A block that matches must
hold a word of the template's prefix, the words that are more than it may lack; only there is
a block looked at, and first by its number of template words (length filter) and how many
of them can still follow the common word (positional filter).

All of it is built from DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.session import stage

# --- Fixed values: phrases and notices of published licenses --------------------
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation either version 3 of the license or at your"
     " option any later version", "gpl-3.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at"
     " http www apache org licenses license 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is"
     " distributed on an as is basis without warranties or conditions of any kind either express or implied",
     "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation"
     " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license",
     "cc-by-sa-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", "isc"),
)
# --- end of fixed values ---------------------------------------------------------

# In lower case: all ASCII but letters and digits. One by one, as a class of single signs is matched by one look-up.
NO_WORD = "[" + "".join(f"\\x{c:02X}" for c in range(0x80) if chr(c) not in string.ascii_lowercase + string.digits) + "]+"


@dataclass(frozen=True)
class Template:
    """A notice as the join sees it: words rarest first, and what a match needs."""

    tokens: tuple[str, ...]
    label: str
    stride: int  # blocks start at its multiples and are twice as long
    need: int  # words of the template that a block must hold

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def words_of(text: str) -> list[str]:
    """Words of a short text, as the columns have them."""
    lower = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return [w for w in re.split(NO_WORD, lower) if w]


def templates(notices, percent: int, count: dict[str, int]) -> list[Template]:
    """Templates with their words by rising count."""
    out = []
    for text, label in notices:
        words = words_of(text)
        if not words:
            raise ValueError(f"a notice without words: {label}")
        tokens = sorted(set(words), key=lambda w: (count.get(w, 0), w))
        out.append(Template(tuple(tokens), label, 1 << (len(words) - 1).bit_length(), math.ceil(percent * len(tokens) / 100)))
    return out


def _words(text: Column) -> Column:
    """Words in order, in lower case."""
    # the one sign beyond ASCII with a lower-case form in ASCII, the Kelvin sign, stays beyond it
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.filter(F.split(lower, NO_WORD), lambda w: w != "")


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """How often each word of the vocabulary occurs in all texts."""
    words = F.filter(_words(F.col(text_col)), lambda w: w.isin(vocabulary))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in counted}


def scanned(docs: DataFrame, vocabulary: list[str], rare: list[str], size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row its number of words and its segments: number `k` and the places of words that matter, `hits`.

    A segment is `size` words and as many of the next one, so that every block that begins in it lies in it.
    Those without a word of `rare` are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(size))

    def both(start: Column) -> Column:
        return F.slice("words", start + 1, 2 * size)

    def segment(start: Column) -> Column:
        hits = F.transform(
            both(start), lambda w, j: F.when(w.isin(vocabulary), F.struct((start + j).alias("i"), w.alias("w")))
        )
        return F.struct(F.floor(start / size).cast("int").alias("k"), F.array_compact(hits).alias("hits"))

    some = F.filter(starts, lambda start: F.exists(both(start), lambda w: w.isin(rare)))
    segments = F.transform(some, segment)
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.exists("words", lambda w: w.isin(rare)), segments).alias("segments"),
    )


def phrase_places(phrases, size: int) -> Column:
    """Places of phrases that begin in a segment: array of first word `i` and `bit` of the label."""
    bits = {label: 1 << at for at, label in enumerate(sorted({label for _, label in phrases}))}
    assert len(bits) < 64 and all(len(words_of(text)) <= size for text, _ in phrases)

    def stands(hit: Column, at: Column, text: str) -> Column:
        first, *others = words_of(text)
        whole = hit["w"] == first
        for step, word in enumerate(others, 1):
            later = F.get("hits", at + step)
            whole = whole & (later["w"] == word) & (later["i"] == hit["i"] + step)
        return F.coalesce(whole, F.lit(False))

    def found(hit: Column, at: Column) -> Column:
        known = [
            F.when(stands(hit, at, text), F.struct(hit["i"].alias("i"), F.lit(bits[label]).cast("long").alias("bit")))
            for text, label in phrases
        ]
        return F.array_compact(F.array(*known))

    own = F.col("k") * size
    return F.filter(F.flatten(F.transform("hits", found)), lambda place: place["i"] < own + size)


def named(mask: Column, phrases) -> Column:
    """Labels of a mask of bits, sorted."""
    labels = sorted({label for _, label in phrases})
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << at) != 0, F.lit(x)) for at, x in enumerate(labels)]))


def template_matches(segments: DataFrame, known: list[Template], ranked: list[str], size: int) -> DataFrame:
    """Per row the labels of templates that a block of it matches, and the greatest share held.

    `ranked` has the words of all templates, rarest first. Of the places in a block, only the
    first one of the first common word goes on, so each block is verified once.
    """
    entries = [
        {"word": word, "tokens": t.tokens, "label": t.label, "stride": t.stride, "need": t.need}
        for t in known
        for word in t.prefix
    ]
    shape = "array<struct<word string, tokens array<string>, label string, stride int, need int>>"
    # A row per template and prefix word, a table of the templates' size whatever the documents'.
    prefixes = segments.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(entries)), shape)))
    rare = sorted({e["word"] for e in entries})
    hits = segments.select("row", "k", "hits", F.explode(F.filter("hits", lambda h: h["w"].isin(rare))).alias("hit"))
    met = hits.join(prefixes, F.col("hit.w") == F.col("word"))
    last = F.floor(F.col("hit.i") / F.col("stride")).cast("int") * F.col("stride")
    blocks = met.withColumn("start", F.explode(F.array(last, last - F.col("stride"))))
    blocks = blocks.where((F.col("start") >= F.col("k") * size) & (F.col("start") < (F.col("k") + 1) * size))

    def inside(h: Column) -> Column:
        return (h["i"] >= F.col("start")) & (h["i"] < F.col("start") + 2 * F.col("stride"))

    earlier = F.exists("hits", lambda h: inside(h) & (h["w"] == F.col("word")) & (h["i"] < F.col("hit.i")))
    block = F.transform(F.filter("hits", inside), lambda h: h["w"])
    blocks = blocks.where(~earlier).withColumn("block", F.array_intersect(F.array(*map(F.lit, ranked)), block))
    following = F.size("block") - F.array_position("block", F.col("word")) + 1
    blocks = blocks.where((F.size("block") >= F.col("need")) & (following >= F.col("need")))
    verified = blocks.withColumn("common", F.array_intersect("tokens", "block"))
    verified = verified.where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
    share = F.size("common") / F.size("tokens")
    return verified.groupBy("row").agg(F.collect_set("label").alias("matched"), F.max(share).alias("share"))


def license_scan(
    docs: DataFrame, phrases=PHRASES, notices=NOTICES, percent: int = 80, id_col="doc_id", text_col="text"
) -> DataFrame:
    """License phrases and notices of every text.

    Words are runs of ASCII letters, in lower case, digits and all other characters beyond ASCII. `n_base`
    counts the places where the words of a phrase stand one after the other, `first_word` and
    `last_word` are the least and greatest of their starts (null without any), `base_labels` their
    labels. A notice with n words has blocks of 2 s words at the multiples of s, the least power of two
    not below n; it is found where a block holds `percent` of its distinct words. `labels` has
    the labels of both, sorted and joined by commas, empty without any; `score` is 1 with a phrase,
    else the greatest share of a notice that is found, else 0.

    A null or empty text has no words. Repeated rows, or rows without id, have a result each. Only the two
    named columns are read. An empty table gives no rows. Counts words and stages their
    places at once; the driver sees one count per word of the templates.
    """
    vocabulary = sorted({w for text, _ in (*phrases, *notices) for w in words_of(text)})
    size = max(t.stride for t in templates([*phrases, *notices], percent, {}))
    count = word_counts(docs, vocabulary, text_col)
    known = templates(notices, percent, count)
    ranked = sorted({w for t in known for w in t.tokens}, key=lambda w: (count.get(w, 0), w))
    # A phrase must have all its words, so its rarest one is its prefix.
    rare = {w for t in known for w in t.prefix} | {t.tokens[0] for t in templates(phrases, 100, count)}
    rows = stage(scanned(docs, vocabulary, sorted(rare), size, id_col, text_col))
    segments = rows.select("row", F.inline("segments"))
    matches = template_matches(segments, known, ranked, size)
    placed = segments.select("row", phrase_places(phrases, size).alias("places")).where(F.size("places") > 0)
    starts = F.transform("places", lambda p: p["i"])
    mask = F.aggregate("places", F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(p["bit"]))
    base = placed.groupBy("row").agg(
        F.sum(F.size("places")).alias("places"),
        F.min(F.array_min(starts)).cast("long").alias("first_word"),
        F.max(F.array_max(starts)).cast("long").alias("last_word"),
        F.bit_or(mask).alias("mask"),
    )
    whole = rows.drop("segments").join(base, "row", "left").join(matches, "row", "left")
    whole = whole.withColumn("n_base", F.coalesce("places", F.lit(0)).cast("long"))
    own = named(F.coalesce("mask", F.lit(0)), phrases)
    both = F.array_union(own, F.coalesce("matched", F.array().cast("array<string>")))
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
