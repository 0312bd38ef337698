"""Personal data in texts: fixed rules, and learned spans beside them.

The rules give the base spans. Looser patterns propose further, overlapping spans; boosted
trees score each by its format and its surroundings, and a proposal becomes a span
where its score reaches the threshold at which held-out proposals of its kind were nearly
always right, those beside the base spans above all. A proposal is a positive example if it is a
base span, or if its canonical form, without disguises and odd separators, is one of its kind by
itself or by a word before it. Only DataFrame and SQL functions touch the texts; the trees
are written out as one expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewatch.session import stage

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:int,start:int,end:int>>"

# The rules' patterns, written without backtracking; a match cannot begin later within the
# same run of characters, unless the match before ended there.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL = _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
RULES = (EMAIL, IP, CARD, PHONE)
PROPOSALS = (
    _LOCAL + r"(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}",
    r"[0-9](?:[\x20./-]?+[0-9]){11,}+",
    r"[+(]?[0-9][\x20()./0-9-]{5,}[0-9]",
)
# What a text must have for a kind to occur in it; cheap to look for.
_NEEDS = (r"[@]|[(\[]at[)\]]", r"[0-9A-Fa-f][.:][0-9A-Fa-f]", r"[0-9]", r"[0-9]")
# What a proposal's canonical form has to be, and the words that stand before one of its kind.
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
FORMS = (
    rf"^[A-Za-z0-9._%+-]+{_DOMAIN}$",
    r"^(?=.*[0-9A-Fa-f]{3})[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$",
    r"^(?:[0-9]{12,19}|[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20./-])[0-9]{6}\2[0-9]{4,5})$",
    r"^(?:\+.*|00[1-9][0-9]{0,2}[\x20./(-].*|\([0-9]{2,5}\)[\x20./-]?[0-9]{2,}(?:[\x20./-][0-9]{2,})*"
    r"|(?:1[\x20.-])?[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}|0[1-9][0-9]{1,4}[\x20/-][0-9]{2,}(?:[\x20/-][0-9]{2,})*)$",
)
_DATE = r"(?<![0-9])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9])"
_WORDS = ("mail|contact|write", "ip|ipv4|ipv6|host|server|address", "card|visa|mastercard|amex", "tel|telephone|phone|mobile|call|fax|fon")
HINTS = tuple(rf"(?i)(?<!\p{{L}})(?:{words})(?!\p{{L}})[^0-9@]{{0,12}}$" for words in _WORDS)
CONTEXT = 20
FEATURES = (
    "length digits letters signs groups plus at luhn bytes distinct before after hint form bounded kind_email kind_ip kind_card"
).split()
SAMPLE, TREES, DEPTH, PRECISION, SUPPORT, BINS = 20_000, 10, 4, 0.99, 20, 50


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits pass the check sum of card numbers."""
    digits = F.reverse(_digits(text))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _valid(kind: int, text: Column) -> Column:
    if KINDS[kind] == "ip":
        return text.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if KINDS[kind] == "card":
        return F.length(_digits(text)).between(13, 19) & _luhn(text)
    if KINDS[kind] == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _validator(kind: int):
    return lambda x: _valid(kind, x["text"])


def _located(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern with their places in code points, from what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    pairs = F.filter(pairs, lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<kind:int,start:int,end:int,text:string>>")

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["match"])
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("text"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(found)).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = F.aggregate(pairs, empty, place, lambda done: done["out"])
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(none)


def _sort_of(c: Column) -> Column:
    """Class of the character beside a span: none, letter, digit, white space, other."""
    return (
        F.when(c == "", 0.0).when(c.rlike(r"\p{L}"), 1.0).when(c.rlike("[0-9]"), 2.0).when(c.rlike(r"\s"), 3.0).otherwise(4.0)
    )


def _of_kind(kind: Column, values) -> Column:
    """The value of the kind."""
    return reduce(lambda rest, k: F.when(kind == k, values[k]).otherwise(rest), range(len(values) - 1), values[-1])


def _form(x: Column) -> Column:
    """2 where a proposal's canonical form is one of its kind, 1 where only a word before it can tell, else 0."""
    span = x["text"]
    plain = F.regexp_replace(F.regexp_replace(span, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    digits, sums = F.length(_digits(span)), _valid(2, span)
    number = _valid(3, span) & ~span.rlike(_DATE)
    return _of_kind(x["kind"], (
        F.when(plain.rlike(FORMS[0]), 2).otherwise(0),
        F.when(_valid(1, span) | span.rlike(FORMS[1]), 2).when(
            span.rlike("^[^.]+$") & (_valid(1, F.translate(span, ":", ".")) | (F.size(F.split(span, ":")) == 8)), 1).otherwise(0),
        F.when(digits.between(13, 19) & span.rlike(FORMS[2]) & sums, 2).when(sums, 1).otherwise(0),
        F.when(number & span.rlike(FORMS[3]), 2).when(number & span.rlike(r"^[0-9(]"), 1).otherwise(0),
    ))


def _features(text: Column, x: Column) -> Column:
    """Format of a proposal and what stands around it."""
    span, digits = x["text"], _digits(x["text"])
    near = F.greatest(x["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, near + 1, x["start"] - near)
    after = F.substring(text, x["end"] + 1, F.lit(2))
    values = (
        F.length(span),
        F.length(digits),
        F.length(F.regexp_replace(span, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")),
        F.size(F.split(F.regexp_replace(span, "[^0-9]+", " "), " ")),
        span.startswith("+").cast("int"),
        span.contains("@").cast("int"),
        _luhn(span).cast("int"),
        _valid(1, span).cast("int"),
        F.size(F.array_distinct(F.split(digits, ""))),
        _sort_of(F.right(before, F.lit(1))),
        _sort_of(F.left(after, F.lit(1))),
        _of_kind(x["kind"], [before.rlike(h) for h in HINTS]).cast("int"),
        _form(x),
        (~before.rlike(r"[\p{L}0-9]$|[0-9A-Fa-f][.:/-]$") & ~after.rlike(r"^(?:[\p{L}0-9]|[.:/-][0-9A-Fa-f])")).cast("int"),
        *((x["kind"] == k).cast("int") for k in range(3)),
    )
    return F.array(*(v.cast("double") for v in values))


def spotted(docs: DataFrame, text_col="text") -> DataFrame:
    """The rows with `base`, their base spans by kind and start, and `proposed` spans with features.

    A null text has none. Proposals that equal a base span are kept as examples. `seed` is a hash of
    the whole row, by which `learn` draws.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = [F.col(f"`{name}`") for name, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]
    base = [F.filter(_located(text, p, k), _validator(k)) for k, p in enumerate(RULES)]
    out = docs.withColumns({"seed": F.xxhash64(*hashed), "base": F.concat(*base)})
    bare = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    out = out.withColumn("base", bare).withColumn("_p", F.concat(*(_located(text, p, k) for k, p in enumerate(PROPOSALS))))

    def described(x: Column) -> Column:
        touches = F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        same = F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["start"] == x["start"]) & (b["end"] == x["end"]))
        return F.struct(
            x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), touches.alias("touches"),
            same.alias("same"), _features(text, x).alias("features"),
        )

    def labelled(x: Column) -> Column:
        hint, form, bounded = (x["features"][FEATURES.index(f)] for f in ("hint", "form", "bounded"))
        meant = (bounded == 1) & ((form == 2) | (form == 1) & (hint == 1))
        return x.withField("label", (x["same"] | meant).cast("int")).dropFields("same")

    return out.withColumn("proposed", F.transform(F.transform("_p", described), labelled)).drop("_p")


def _tree(node, features: Column) -> Column:
    """A fitted tree as an expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        features[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), features)
    ).otherwise(_tree(node.rightChild(), features))


class Model:
    """Boosted trees and a threshold per kind; a kind without one adds nothing."""

    def __init__(self, trees=(), weights=(), thresholds=None):
        self.trees, self.weights, self.thresholds = list(trees), list(weights), thresholds or {}

    def margin(self, features: Column) -> Column:
        parts = [F.lit(float(w)) * _tree(t.rootNode(), features) for t, w in zip(self.trees, self.weights)]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    def score(self, features: Column) -> Column:
        return 1 / (1 + F.exp(-2 * self.margin(features)))


def _examples(rows: DataFrame) -> DataFrame:
    """The proposals, each with `draw` from 0 to 1 and `fold` of its own, by hashes of its row and place."""
    spread = rows.select("seed", F.posexplode("proposed").alias("place", "x"))
    draw = F.pmod(F.xxhash64("seed", "place"), F.lit(1 << 52)) / float(1 << 52)
    fold = F.pmod(F.xxhash64(F.lit(7), "seed", "place"), F.lit(4))
    return spread.select("x.kind", "x.touches", "x.label", "x.features", draw.alias("draw"), fold.alias("fold"))


def _sampled(examples: DataFrame) -> DataFrame:
    """Labels and features of about `SAMPLE` proposals; equal ones become one row with their number as weight.

    Those beside the base spans make up half of them, where there are as many.
    """
    n = {r["touches"]: r["count"] for r in examples.groupBy("touches").count().collect()}
    touching, own = n.get(True, 0), n.get(False, 0)
    own_share = min(1.0, max(SAMPLE / 2, SAMPLE - touching) / max(own, 1))
    share = min(1.0, max(SAMPLE / 2, SAMPLE - own) / max(touching, 1))
    chosen = examples.where(F.col("draw") < F.when(F.col("touches"), share).otherwise(own_share))
    return chosen.groupBy("label", "features").agg(F.count("*").cast("double").alias("weight"))


def learn(rows: DataFrame) -> Model:
    """Trees and thresholds from spotted rows.

    Trees are fitted on about `SAMPLE` proposals, drawn one by one; the thresholds
    are set on all proposals that a second hash holds out. Those that touch no base span, to which
    alone a threshold is applied, must reach `PRECISION`; if fewer than `SUPPORT` of them are right, the
    others count for the support and must reach it too. Without both classes, or where no
    threshold of a kind does, nothing is added.
    """
    examples = _examples(rows)
    chosen = _sampled(examples.where("fold != 0")).select(
        F.col("label").cast("double"), "weight", "features", *(F.col("features")[i].alias(f) for i, f in enumerate(FEATURES))
    )
    if chosen.select("label").distinct().count() < 2:
        return Model()
    table = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(chosen).select("label", "weight", "features", "x")
    table = table.coalesce(2).sortWithinPartitions("label", "features")
    trees = GBTClassifier(labelCol="label", featuresCol="x", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(table)
    model = Model(trees._java_obj.trees(), trees.treeWeights)
    scored = examples.where("fold = 0").withColumn("bin", F.floor(model.score(F.col("features")) * BINS).cast("int"))
    sums = [F.count("*").alias("n"), F.sum("label").alias("right")]
    sums += [F.sum(v * (~F.col("touches")).cast("int")).alias(k) for k, v in (("n_own", F.lit(1)), ("right_own", F.col("label")))]
    counts = scored.groupBy("kind", "bin").agg(*sums).collect()
    for kind in range(len(KINDS)):
        n, right, n_own, right_own = 0, 0, 0, 0
        for row in sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, right = n + row["n"], right + row["right"]
            n_own, right_own = n_own + row["n_own"], right_own + row["right_own"]
            known = right_own >= SUPPORT or right >= SUPPORT and right >= PRECISION * n
            if known and right_own >= PRECISION * n_own:
                model.thresholds[kind] = row["bin"] / BINS
    return model


def with_spans(rows: DataFrame, model: Model) -> DataFrame:
    """The spotted rows with `spans`: the base ones and those that the model adds, by kind and start."""
    def fits(x: Column) -> Column:
        if not model.thresholds:
            return F.lit(False)
        bound = F.lit(math.inf)
        for kind, threshold in model.thresholds.items():
            bound = F.when(x["kind"] == kind, threshold).otherwise(bound)
        return ~x["touches"] & (model.score(x["features"]) >= bound)

    added = F.transform(
        F.filter("proposed", fits), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )
    return rows.withColumn("spans", F.sort_array(F.concat(F.col("base").cast(SPAN), added.cast(SPAN))))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redacted(text: Column, spans: str) -> Column:
    """The text with every stretch of spans replaced by the kind of the first of them."""
    none = F.array().cast(SPAN)
    ordered = F.array_sort(
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    )

    def merge(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        own = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        touches = (F.size(done) > 0) & (x["start"] < last["end"])
        return F.when(touches, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(own))
        )

    whole = F.aggregate(ordered, none, merge)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def cut(done: Column, x: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        return F.struct(x["end"].alias("at"), F.concat(done["out"], kept, F.get(names, x["kind"])).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(whole, empty, cut, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted_documents(docs: DataFrame, text_col="text", length_col="n_chars") -> DataFrame:
    """The documents with their personal data replaced, and their length counted anew where it is a column."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.col(text_col).alias("text"))
    rows = stage(spotted(row).drop("text"))
    out = with_spans(rows, learn(rows)).withColumn("new", redacted(F.col(f"row.{text_col}"), "spans"))
    changed = F.size("spans") > 0

    def value(name: str) -> Column:
        if name == text_col:
            return F.col("new").alias(name)
        if name == length_col:
            old = F.col(f"row.{name}")
            return F.when(changed, F.length("new").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return F.col(f"row.{name}")

    return out.select(*(value(n) for n in names))
