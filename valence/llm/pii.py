"""Personal data: candidates of high recall, boosted trees, calibrated thresholds. DataFrame functions only.

**Base.** E-mail addresses, IP addresses, card and phone numbers by fixed patterns and checks. They always stay.

**Candidates.** Wider patterns propose spans that may overlap each other and the base: runs of digits and punctuation, dotted
numbers, anything around an @, long mixed tokens. Features are the format of a span (length, shares of
digits, letters and punctuation, groups, first and last character) and its context (the characters beside it, words such as
``token`` or ``tel`` before it, a sign or an assignment).

**Trees.** Gradient-boosted trees learn from candidates whose label is known without them: a candidate that is exactly a base span, or
a long token that is assigned to a name for a secret, is 1; all others are 0. What the checks look at (the check digit, the value of an octet) is not
among the features, so trees also recognise data whose check fails, like a card number with a typing error. They learn from a bounded sample, the
candidates of at most SAMPLE rows, those with the smallest hash of the text. An isotonic regression on a held-out part of the sample turns scores into
probabilities, and a candidate is selected from THRESHOLD up, low because a missed one costs more than a hidden one, if it doesn't overlap the base.

Positions are code points, end exclusive. The patterns are found with ``regexp_extract_all``, their places by the lengths of what ``split`` leaves between
them. They start where a run starts or the last match ended, so each character is looked at a bounded number of times.

Defined: null and empty texts have no spans. Rows may repeat or have no id. If the sample lacks positive or negative candidates nothing is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from valence.llm.common import numbered
from valence.session import written

#: Kinds in the order of the output; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "number", "dotted", "address", "token")
SAMPLE, TREES, DEPTH, THRESHOLD, BESIDE = 4000, 10, 4, 0.35, 24
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){5,24}",
    "dotted": r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){2,7}",
    "address": r"(?<!\S)[^\s@]++@[^\s@]++",
    "token": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What is longer than the patterns above take is proposed whole too, beside their parts, as a part may lie beside the base where the whole doesn't.
LONGER = {"number": r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){25,}+", "dotted": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,}+"}
#: What a text must have for a kind; a token needs nothing.
NEEDS = {"email": "@", "address": "@", "token": ""} | dict.fromkeys(("ip", "card", "phone", "number", "dotted"), "[0-9]")
_SECRET = r"(?i)(token|secret|key|passw(or)?d|pwd)[\"']?\s*[:=]\s*[\"']?$"
FEATURES = (
    "length", "digits", "letters", "others", "groups", "dots", "at", "upper", "starts_digit", "ends_digit",
    "before_blank", "after_blank", "before_plus", "before_digit", "after_digit", "assigned", "named", "kind_number",
)


def matches(kind: str, body: Column, longer: bool = False) -> Column:
    """The matches of a pattern, or of the one for longer ones (of a base kind those that pass its check), as structs with kind, start, end, match, and what is before and after."""
    pattern = (LONGER if longer else PATTERNS)[kind]
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    gaps = F.split(body, pattern, -1)
    # Places: a running sum over gaps and matches.
    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        span = F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(x["match"])).alias("end"),
            x["match"].alias("match"), F.right(x["gap"], F.lit(BESIDE)).alias("before"), F.left(x["next"], F.lit(BESIDE)).alias("after"),
        )
        good = passes(span) if KINDS.index(kind) < 4 else F.lit(True)
        if longer and kind == "dotted":  # not what the other pattern takes whole
            good = ~x["match"].rlike(r"^[0-9]{1,5}(\.[0-9]{1,5}){2,7}$")
        # Only what counts is kept, as each addition copies the list.
        return F.struct(span["end"].alias("at"), F.when(good, F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    none = F.lit([]).cast(_SPANS)
    n = F.size(found)
    # Zipped once; looking gaps up by number would split the text again for each match.
    zipped = F.arrays_zip(found, F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n))
    rows = zipped.cast("array<struct<match: string, gap: string, next: string>>")
    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(none)


_SPANS = "array<struct<kind: int, start: int, end: int, match: string, before: string, after: string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i))
    return F.pmod(total, F.lit(10)) == 0


def passes(span: Column) -> Column:
    """The checks of the base kinds."""
    digits = _digits(span["match"])
    n = F.length(digits)
    octets = F.transform(F.split(span["match"], r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    ip = F.forall(octets, lambda x: (F.length(x) <= 3) & (F.coalesce(F.when(F.length(x) <= 3, x).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return F.when(span["kind"] == 0, True).when(span["kind"] == 1, ip).when(span["kind"] == 2, card).otherwise(n.between(10, 15))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, h (hash of the text), ``base`` and ``wider`` (the spans of the base, and all candidates)."""
    body = F.col("body")
    none = F.lit([]).cast(_SPANS)

    def all_of(kind: str) -> Column:
        parts = matches(kind, body)
        if kind in LONGER:
            parts = F.concat(parts, matches(kind, body, longer=True))
        return F.when(body.rlike(NEEDS[kind]), parts).otherwise(none) if NEEDS[kind] else parts

    found = {k: all_of(k) for k in KINDS}
    rows = numbered(docs, text, id_column).select(
        "row", F.col(f"own_{id_column}").alias("id"), F.xxhash64("body").alias("h"), *[found[k].alias(k) for k in KINDS]
    )
    return rows.select("row", "id", "h", F.concat(*KINDS[:4]).alias("base"), F.concat(*KINDS[4:]).alias("wider"))


def featured(found: DataFrame) -> DataFrame:
    """A row per candidate with its features, its label, and whether it overlaps the base.

    A candidate and the base are compared in one sort of a row's spans: what began before it and ends after its start, or begins before its end.
    """
    every = F.concat(F.transform("base", lambda x: F.struct(x.alias("span"), F.lit(True).alias("sure"))),
                     F.transform("wider", lambda x: F.struct(x.alias("span"), F.lit(False).alias("sure"))))
    one = found.filter(F.size("wider") > 0).select("row", "h", F.explode(every).alias("x")).select("row", "h", "x.sure", "x.span.*")
    here = Window.partitionBy("row").orderBy("start", "end", "kind", "sure")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    later = here.rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("row", "start", "end")
    sure_end, sure_start = F.when(F.col("sure"), F.col("end")), F.when(F.col("sure"), F.col("start"))
    one = one.select(
        "*", F.coalesce(F.max(sure_end).over(past) > F.col("start"), F.lit(False)).alias("past"),
        F.coalesce(F.min(sure_start).over(later) < F.col("end"), F.lit(False)).alias("later"),
        F.max(F.col("sure").cast("int")).over(same).alias("exact"),
    ).filter(~F.col("sure"))
    m, before, after = F.col("match"), F.col("before"), F.col("after")
    n = F.length(m)

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(m, pattern, ""))

    secret = (F.col("kind") == KINDS.index("token")) & before.rlike(_SECRET) & m.rlike("[0-9]")
    values = {
        "length": n, "digits": kept("[^0-9]") / n, "letters": kept("[^A-Za-z]") / n, "others": kept("[A-Za-z0-9]") / n,
        "groups": F.size(F.split(m, "[^A-Za-z0-9]+")), "dots": kept("[^.]"), "at": kept("[^@]"), "upper": kept("[^A-Z]") / n,
        "starts_digit": m.rlike("^[0-9]"), "ends_digit": m.rlike("[0-9]$"), "before_blank": before.rlike(r"(^|\s)$"),
        "after_blank": after.rlike(r"^(\s|$)"), "before_plus": before.rlike(r"\+$"), "before_digit": before.rlike(r"[0-9][.\x20()-]*$"),
        "after_digit": after.rlike(r"^[.\x20()-]*[0-9]"), "assigned": before.rlike(r"[:=]\s*[\"']?$"),
        "named": before.rlike(r"(?i)(token|secret|key|passw|pwd|tel|phone|mail|card|ip)\W*$"), "kind_number": F.col("kind"),
    }
    return one.select(
        "row", "h", "kind", "start", "end", (F.col("past") | F.col("later") | (F.col("exact") == 1)).alias("overlaps"),
        F.when((F.col("exact") == 1) | secret, 1.0).otherwise(0.0).alias("label"),
        *[v.cast("double").alias(f"f_{k}") for k, v in values.items()],
    )


def selected(candidates: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """row, kind, start, end and probability of the candidates that are selected."""
    nothing = candidates.limit(0).select("row", "kind", "start", "end", F.col("label").alias("probability"))
    chosen = candidates.select("h", "row").distinct().orderBy("h", "row").limit(sample)
    vectors = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")
    learn = written(vectors.transform(candidates.join(chosen, ["h", "row"], "left_semi")).select("h", "features", "label"), "sample")
    part = F.pmod("h", F.lit(4)) == 0
    both = learn.groupBy(part.alias("held")).agg(F.min("label").alias("low"), F.max("label").alias("high")).collect()
    if len(both) < 2 or any(r.low == r.high for r in both):
        return nothing
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(learn.filter(~part))

    def scored(df: DataFrame) -> DataFrame:
        out = trees.transform(df)
        return out.withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")

    curve = IsotonicRegression(featuresCol="raw", predictionCol="probability").fit(scored(learn.filter(part)))
    known = curve.transform(scored(vectors.transform(candidates.filter(~F.col("overlaps")))))
    return known.filter(F.col("probability") >= threshold).select("row", "kind", "start", "end", "probability")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: row, id, base and added (spans with kind number, start, end)."""
    found = written(spans(docs, id_column, text), "spans")
    candidates = written(featured(found), "candidates")
    added = selected(candidates).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    empty = F.lit([]).cast("array<struct<kind: int, start: int, end: int>>")
    return found.select("row", "id", plain.alias("base")).join(added, "row", "left").withColumn("added", F.coalesce("added", empty))
