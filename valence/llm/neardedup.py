"""Near duplicates by DartMinHash: weighted signatures, bands, exact verification, components.

A text is the multiset of its five-word shingles (words: runs of letters and digits, in lower
case). Its similarity to another is the weighted Jaccard of the two: the sum of the smaller counts
over the sum of the larger ones. 0.8 or more is a link, and linked texts form a class.

**Signature** (Christiani 2020). Each shingle owns a strip as wide as its count and without end in
rank. Hashes throw darts into the strips, one per unit of area on average, and the same ones for every text.
A dart falls to one of k coordinates; the earliest dart of a coordinate is its value. Two texts
agree in a coordinate with a probability that is exactly their weighted Jaccard. Only the first few ranks are
looked at, about k log k darts a text, however long it is; texts with a coordinate still empty look further.

**Bands.** 32 bands of 5 coordinates: a pair of similarity 0.8 shares none with a probability
of 3e-6. Texts with the same shingle multiset are put together first, so exact copies cost one row.
In each bucket all are compared with a pivot, the one that shares most buckets with others (in a group of edited
copies that is the least edited one); those that aren't linked to it are compared with a second pivot among them, and so on for
ROUNDS rounds, each linear in the bucket. Then components are made. What is left are pairs of one bucket in different classes: they
are compared too, unless something rules a link out: the sizes, the distances to the first pivot (1 - similarity is a metric), the number of
shingles that no other candidate has (an edited copy with many of its own can't reach 0.8 with anything), or the signatures.
The last is by four bits of all 160 coordinates, of which a pair of 0.8 shares fewer than ALIKE with a probability below 1e-6. No bucket is cut.

Defined: a text without words is alone. One of fewer than five words is a single shingle. Null counts as
empty. Rows may repeat or have a null id; the class id is the smallest id in the class, null
if none has one; of rows with equal ids the first is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from valence.llm.common import (
    Words, bloom_filter, fixed, may_hold, mixed, numbered, of_rows, pieces, shingles, signed, signed_back, spread,
)
from valence.llm.components import components
from valence.session import written

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
ROUNDS = 3
ALIKE = 105 / 160  # of the coordinates
_PACKED = 16  # coordinates of four bits in a long
_SEED = np.uint64(0x51A7D3C2B4E6F809)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.uint64(0xD1B54A32D192ED03)


def strips(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the region [0, weight) into [0, 1), [1, 2), [2, 4), [4, 8)...: element, lower end, width."""
    number = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    element = np.repeat(np.arange(len(weight)), number)
    k = np.arange(len(element)) - np.repeat(np.cumsum(number) - number, number)
    low = np.where(k > 0, np.exp2(k - 1.0), 0.0)
    return element, low, np.where(k > 0, low, 1.0)


def dart_signatures(key: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """The signature of each weighted set, ``texts`` by k values.

    ``key`` (64-bit hash), ``text`` (number of the set) and ``weight`` (above 0) are by element; an
    element is named once per set. Sets without elements get zeros.
    """
    total = np.bincount(text, weight, texts)
    best = np.zeros((texts, k), np.uint64)
    todo = total > 0
    reach = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    mine = np.arange(len(key))
    while len(mine):
        ids, low, width = strips(weight[mine])
        own = mine[ids]
        cells = np.maximum(1, np.ceil(reach[text[own]] * width)).astype(np.int64)
        where = np.repeat(np.arange(len(own)), cells)
        cell = np.arange(len(where)) - np.repeat(np.cumsum(cells) - cells, cells)
        own, low, width = own[where], low[where], width[where]
        with np.errstate(over="ignore"):
            h = mixed(key[own] ^ (cell.astype(np.uint64) * _STEP + low.astype(np.uint64) * _LATE + _SEED))
        at = np.zeros(len(h))
        place, rank, dart = [], [], []
        while len(h):
            with np.errstate(over="ignore"):
                h = h * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            at = at - np.log(((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            r = (cell + at) / width
            live = np.flatnonzero((at < 1) & (r <= reach[text[own]]))
            h, at, own, low, width, cell, r = h[live], at[live], own[live], low[live], width[live], cell[live], r[live]
            name = mixed(h ^ _LATE)
            height = low + width * ((mixed(name) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = np.flatnonzero(height < weight[own])
            coordinate = ((name[hit] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            place.append(text[own[hit]] * k + coordinate.astype(np.int64))
            rank.append(r[hit])
            dart.append(name[hit])
        place, rank, dart = np.concatenate(place), np.concatenate(rank), np.concatenate(dart)
        late_first = np.argsort(-rank, kind="stable")
        flat = np.zeros(texts * k, np.uint64)
        full = np.zeros(texts * k, bool)
        flat[place[late_first]] = dart[late_first]
        full[place] = True
        ready = todo & full.reshape(texts, k).all(1)
        best[ready] = flat.reshape(texts, k)[ready]
        todo &= ~ready
        reach = reach * 2
        mine = mine[todo[text[mine]]]
    return best


def shingle_counts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text and how often they are there: hash, text, count."""
    key, text, _ = shingles(words, width)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return key[at], text[at], np.diff(at, append=len(key))


def _summed(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    out = np.zeros(texts, np.uint64)
    at = np.flatnonzero(np.diff(text, prepend=-1))
    if len(at):
        with np.errstate(over="ignore"):
            out[text[at]] = np.add.reduceat(values, at)
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(values)))


def _signatures(bands: int, rows: int, width: int):
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, "plain")
                key, text, count = shingle_counts(w, width)
                best = dart_signatures(key, text, count.astype(np.float64), w.texts, k)
                band = np.zeros((w.texts, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        band = band * _STEP + best[:, r::rows][:, :bands]
                    band = mixed(band + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _LATE)
                    # Sums of two hashes of (shingle, count): equal for equal multisets.
                    pair = mixed(key + count.astype(np.uint64) * _STEP)
                    prints = [_summed(pair, text, w.texts), _summed(mixed(pair ^ _SEED), text, w.texts)]
                size = np.bincount(text, count, w.texts).astype(np.int64)
                held = np.where(size > 0, bands, 0)
                few = np.zeros((w.texts, -(-k // _PACKED)), np.uint64)
                for c in range(k):
                    few[:, c // _PACKED] |= (best[:, c] & np.uint64(15)) << np.uint64(4 * (c % _PACKED))
                yield pa.record_batch(
                    [batch["row"].slice(i, w.texts), batch["id"].slice(i, w.texts), pa.array(size),
                     *[pa.array(signed(p)) for p in prints], _lists(band[size > 0].ravel(), held),
                     _lists(few.ravel(), np.full(w.texts, few.shape[1]))],
                    ["row", "id", "size", "print", "print2", "bands", "sketch"],
                )

    return sign


def _elements(picked, width: int):
    """The multiset as a set: the i-th occurrence of a shingle is an element of its own."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(picked.value, signed_back(batch["h"].to_numpy()))))
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, "plain")
                key, text, count = shingle_counts(w, width)
                which = np.repeat(np.arange(len(key)), count)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                with np.errstate(over="ignore"):
                    element = mixed(key[which] + nth.astype(np.uint64) * _STEP)
                sizes = np.bincount(text[which], minlength=w.texts)
                yield pa.record_batch([batch["row"].slice(i, w.texts), _lists(element, sizes)], ["row", "elements"])

    return listed


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b and their exact similarity; ``held`` has the elements of all rows."""
    with_a = pairs.join(held.select(F.col("row").alias("a"), F.col("elements").alias("of_a")), "a")
    both = with_a.join(held.select(F.col("row").alias("b"), F.col("elements").alias("of_b")), "b")
    same = F.size(F.array_intersect("of_a", "of_b"))
    return written(
        both.select("a", "b", (same / (F.size("of_a") + F.size("of_b") - same)).alias("similarity")), "verified"
    )


def _with_heads(signs: DataFrame) -> DataFrame:
    """row, id and the first row with the same shingles. A text without words is alone."""
    alike = ["size", "print", "print2", "alone"]
    prints = signs.select("row", "id", *alike[:3], F.when(F.col("size") == 0, F.col("row")).otherwise(-1).alias("alone"))
    # As a table, so that the join can split the rows of a hot text.
    heads = written(prints.groupBy(*alike).agg(F.min("row").alias("head")), "prints")
    return prints.join(heads, alike).select("row", "id", "head")


def _pivoted(rows: DataFrame) -> DataFrame:
    """rows (key, a, ...) with ``pivot``: of each key the row with the most company."""
    pivots = rows.groupBy("key").agg(F.max(F.struct("company", (-F.col("a")).alias("a"))).alias("p"), F.count(F.lit(1)).alias("n"))
    pivots = written(pivots.filter("n > 1").select("key", (-F.col("p.a")).alias("pivot")), "pivots")
    return rows.join(pivots, "key")


def _pairs(rows: DataFrame) -> DataFrame:
    others = rows.filter("a <> pivot")
    return others.select(F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b")).distinct()


def _with_distance(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """rows with ``far``: 1 - similarity to the pivot."""
    ends = rows.withColumn("low", F.least("a", "pivot")).withColumn("high", F.greatest("a", "pivot"))
    known = checked.select(F.col("a").alias("low"), F.col("b").alias("high"), (1 - F.col("similarity")).alias("far"))
    return ends.join(known, ["low", "high"], "left").drop("low", "high").withColumn("far", F.coalesce("far", F.lit(0.0)))


def _alike(coordinates: int) -> Column:
    """Whether two packed sketches agree in enough coordinates."""
    ones = F.lit(0x1111111111111111)
    total = F.lit(0)
    for i in range(-(-coordinates // _PACKED)):
        equal = F.bitwise_not(F.col("l_sketch")[i].bitwiseXOR(F.col("sketch")[i]))
        equal = equal.bitwiseAND(F.shiftrightunsigned(equal, 1))
        equal = equal.bitwiseAND(F.shiftrightunsigned(equal, 2)).bitwiseAND(ones)
        total = total + F.bit_count(equal)
    return total >= int(ALIKE * coordinates)


def _common(held: DataFrame) -> DataFrame:
    """a and ``common``: how many of its elements another candidate has too. Others can share no more with it."""
    alone = held.select("row", F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("a"))
    alone = alone.filter("n = 1").groupBy("a").agg(F.count(F.lit(1)).alias("own"))
    sizes = held.select(F.col("row").alias("a"), F.size("elements").alias("n"))
    return sizes.join(alone, "a", "left").select("a", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))


def _unsettled(rows: DataFrame, classes: DataFrame, sketches: DataFrame, checked: DataFrame, similarity: float, coordinates: int) -> DataFrame:
    """Pairs of one bucket that may be links between classes and were not compared yet. ``rows``: key, a, size, pivot, far."""
    of = classes.select(F.col("node").alias("a"), "root")
    rows = written(rows.join(of, "a", "left").withColumn("root", F.coalesce("root", "a")), "rooted")
    open_keys = (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
             F.max(F.when(F.col("a") == F.col("pivot"), F.col("root"))).alias("home"))
        .filter("n > 2 AND low <> high")
        .select("key", "home")
    )
    rows = rows.filter("a <> pivot").join(written(open_keys, "open"), "key").withColumn("away", F.col("root") != F.col("home"))
    rows = rows.select("key", "a", "size", "root", "far", "away").join(sketches, "a")
    rows = written(rows.filter(F.col("common") >= similarity * F.col("size") - 1e-6), "unsettled")
    right = rows.select("key", "a", "size", "root", "far", "away", "sketch", "common", "bands")
    left = rows.filter("away").select(F.col("key").alias("l_key"), *[F.col(c).alias(f"l_{c}") for c in ("a", "size", "root", "far", "sketch", "common", "bands")])
    first_shared = F.array_min(F.array_intersect("l_bands", "bands")) == F.col("key")
    near = (
        (F.col("l_root") != F.col("root"))
        & (F.least("l_size", "size") >= similarity * F.greatest("l_size", "size"))
        & (F.abs(F.col("l_far") - F.col("far")) <= 1 - similarity + 1e-9)
        & (~F.col("away") | (F.col("l_a") < F.col("a")))
        & ((1 + similarity) * F.least("l_common", "common") >= similarity * (F.col("l_size") + F.col("size")) - 1e-6)
        & _alike(coordinates)
    )
    # A pair meets in each bucket it shares; the first of them is enough, as one of the two is away there or a pivot.
    pairs = left.join(right, (F.col("l_key") == F.col("key")) & near & first_shared)
    pairs = pairs.select(F.least("l_a", "a").alias("a"), F.greatest("l_a", "a").alias("b"))
    return pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    docs = fixed(docs)
    return of_rows(docs, near_groups(docs, id_column, text).filter("kept"), "left_semi")


def near_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
    width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS,
) -> DataFrame:
    """A row per row of ``docs``: row, id, class_id, class_size, kept (one of each class)."""
    body = numbered(fixed(docs, id_column, text), text, id_column)
    body = body.select("row", "body", F.col(f"own_{id_column}").alias("id"))
    signs = written(
        body.mapInArrow(
            _signatures(bands, rows, width),
            "row long, id long, size long, print long, print2 long, bands array<long>, sketch array<long>",
        ),
        "signatures",
    )
    known = written(_with_heads(signs), "heads")
    unique = signs.join(known.filter("row = head").select("row"), "row", "left_semi")
    buckets = written(unique.select(F.explode("bands").alias("key"), F.col("row").alias("a"), "size"), "buckets")
    shared = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    company = buckets.join(shared, "key")
    company = written(company.groupBy("a").agg(F.sum("n").alias("company")), "company")
    held = company.select(spread("a").alias("h"))
    picked = bloom_filter(held, "h", 24)
    texts = body.select("row", "body", spread("row").alias("h"))
    held = written(texts.mapInArrow(_elements(picked, width), "row long, elements array<long>"), "elements")

    first = written(_pivoted(buckets.join(shared.select("key"), "key", "left_semi").join(company, "a")), "pivoted")
    now, checked = first, None
    for step in range(rounds):
        fresh = _pairs(now)
        if checked is not None:
            fresh = fresh.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        fresh = _verified(fresh, held)
        checked = fresh if checked is None else checked.union(fresh)
        now = written(_with_distance(now, checked), "distances")
        if not step:
            first = now
        if step < rounds - 1:
            now = written(_pivoted(now.filter(F.col("far") > 1 - similarity).drop("pivot", "far")), "pivoted")
    links = checked.filter(F.col("similarity") >= similarity).select("a", "b")
    sketches = signs.select(F.col("row").alias("a"), "sketch", "bands").join(_common(held), "a")
    rest = _unsettled(first, components(links), sketches, checked, similarity, bands * rows)
    more = _verified(written(rest, "rest"), held)
    classes = components(links.union(more.filter(F.col("similarity") >= similarity).select("a", "b")))
    of = known.join(classes.select(F.col("node").alias("head"), "root"), "head", "left")
    of = written(of.select("row", "id", F.coalesce("root", "head").alias("root")), "classes")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = written(of.groupBy("root").agg(best.alias("best"), F.count(F.lit(1)).alias("class_size")), "groups")
    return of.join(groups, "root").select(
        "row", "id", F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept")
    )
