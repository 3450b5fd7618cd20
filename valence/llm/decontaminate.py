"""Benchmark decontamination with spaced seeds.

A seed is a window of words of which a fixed mask ignores some, so a replaced word spoils only
the windows in which the mask looks at it. The seeds of all benchmark items are kept twice: in a Bloom
filter of a fixed size, which the tasks that read the texts use to throw away almost all their windows, and as
a table, with which the windows that are left are joined. Neither depends on the size of the benchmark, so
there is one way for all sizes.

Each hit gives an item and a shift between item and text. All words of the item are then compared with
the text at that shift. The best stretch (+1 for an equal word, -2 for another) must score SCORE or more
to count, and the equal words of the counting stretches of a text and an item are added up over the shifts, as
an inserted or lost word moves the rest. An item is found if they are COVER of it, or ENOUGH words.

Items of fewer than BRIEF words have masks of their own, which miss nothing: the shortest stretch that scores SCORE has
x other words and SCORE + 3 x words in all, and begins and ends with three equal words, as a shorter one would score as
much otherwise. So the first and last three words of such stretches are the seeds, one mask for each x that fits.

Words are runs of letters and digits in lower case. Items of fewer than LEAST words are no evidence and are never found. Items
with equal words are looked up once and reported by the smallest id. Null texts count as empty and are clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import (
    Words, bloom_filter, fixed, may_hold, mixed, numbered, of_rows, pieces, row_of, signed, signed_back, words_of,
)
from valence.session import written

LEAST, BRIEF, SCORE, COVER, ENOUGH = 5, 20, 5, 0.7, 13
#: Fixed masks: a window's words at the ones make the seed. Those of longer items, then those of items below BRIEF words.
MASKS = ("110101101011", "101100110111", "111011010011", "11011111")
BRIEF_MASKS = ("11111", *("111" + "0" * (span - 6) + "111" for span in range(SCORE + 3, BRIEF, 3)))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _masks(brief: set[bool]) -> list[tuple[int, bool, np.ndarray]]:
    """Number, whether it is for items below BRIEF words, and places: of the masks that there are items for."""
    every = [(m, False) for m in MASKS] + [(m, True) for m in BRIEF_MASKS]
    return [
        (number, of, np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 0x31))
        for number, (m, of) in enumerate(every) if of in brief
    ]


def seeds(words: Words, masks: list[tuple[int, bool, np.ndarray]]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """For each mask: whether it is for brief items, hashes of all its windows, and the first word of each."""
    for number, brief, mask in masks:
        span = int(mask[-1]) + 1
        n = max(0, len(words.hash) - span + 1)
        h = np.full(n, np.uint64(1000 + number), np.uint64)
        with np.errstate(over="ignore"):
            for k in mask:
                h = h * _STEP + words.hash[k : k + n]
        at = np.flatnonzero(words.text[:n] == words.text[span - 1 : span - 1 + n])
        yield brief, mixed(h[at]), at


def _seeding(masks: list[tuple[int, bool, np.ndarray]], held=None):
    """Seeds of items; with the filter ``held`` those of texts that it may hold."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, "plain")
                sizes = np.diff(w.first)
                for brief, h, at in seeds(w, masks):
                    keep = (sizes[w.text[at]] < BRIEF) == brief if held is None else may_hold(held.value, h)
                    h, at = h[keep], at[keep]
                    text = w.text[at]
                    yield pa.record_batch(
                        [pa.array(row[i + text]), pa.array(at - w.first[text]), pa.array(signed(h))], ["row", "at", "seed"]
                    )

    return found


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """row, item_id, matched (words), item_words: a row for each text and each item found in it."""
    body = numbered(fixed(docs, id_column, text), text, id_column).select("row", "body")
    items = numbered(fixed(benchmark, item_id, item_text), item_text, item_id)
    # Every item passes the filter of its own numbers.
    words = words_of(items, items.select("row")).join(items.select("row", F.col(f"own_{item_id}").alias("item_id")), "row")
    known = (
        words.filter(F.size("words") >= LEAST)
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"), F.min("row").alias("item"))
    )
    known = written(known, "items")
    masks = _masks({r.brief for r in known.select((F.size("words") < BRIEF).alias("brief")).distinct().collect()})
    chosen = items.join(known.select(F.col("item").alias("row")), "row", "left_semi").select("row", "body")
    seeded = written(chosen.mapInArrow(_seeding(masks), "row long, at long, seed long"), "seeds")
    held = bloom_filter(seeded, "seed")
    windows = body.mapInArrow(_seeding(masks, held), "row long, at long, seed long")
    places = seeded.select("seed", F.col("row").alias("item"), F.col("at").alias("item_at"))
    hits = windows.join(places, "seed").select("row", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = written(hits.distinct(), "hits")

    texts = words_of(body, hits.select("row")).select("row", F.col("words").alias("of_text"))
    pairs = hits.join(texts, "row").join(known.select("item", "item_id", F.col("words").alias("of_item")), "item")
    # Of the text only the words beside the item are carried on.
    low = F.greatest(F.col("shift"), F.lit(0))
    beside = F.slice("of_text", (low + 1).cast("int"), F.greatest(F.col("shift") + F.size("of_item") - low, F.lit(0)).cast("int"))
    pairs = pairs.select("row", "item", "item_id", F.size("of_item").alias("item_words"), F.zip_with(
        beside, F.slice("of_item", (low - F.col("shift") + 1).cast("int"), F.size("of_item")),
        lambda a, b: F.coalesce(a == b, F.lit(False)),
    ).alias("same"))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("equal"), F.lit(0).alias("score"), F.lit(0).alias("matched"))

    def step(s, same):
        now = F.greatest(s["now"] + F.when(same, 1).otherwise(-2), F.lit(0))
        equal = F.when(now > 0, s["equal"] + same.cast("int")).otherwise(0)
        better = now > s["score"]
        return F.struct(
            now.alias("now"), equal.alias("equal"), F.when(better, now).otherwise(s["score"]).alias("score"),
            F.when(better, equal).otherwise(s["matched"]).alias("matched"),
        )

    scored = pairs.withColumn("best", F.aggregate("same", zero, step))
    return (
        scored.groupBy("row", "item_id", "item_words")
        .agg(F.sum(F.when(F.col("best.score") >= F.least(F.lit(SCORE), "item_words"), F.col("best.matched"))).alias("matched"))
        # No stretch that counts is no match: least() alone would pass over the null and give all words.
        .withColumn("matched", F.least(F.coalesce("matched", F.lit(0)), F.col("item_words").cast("long")))
        .filter((F.col("matched") >= F.ceil(COVER * F.col("item_words"))) | (F.col("matched") >= ENOUGH))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """A row per row of ``docs``: row, id, contaminated, n_items, first_item, most_matched."""
    docs = fixed(docs, id_column, text)
    hits = benchmark_hits(docs, benchmark, id_column, text, **names)
    found = hits.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.max("matched").alias("most_matched")
    )
    rows = docs.select(row_of(docs), F.col(id_column).alias("id"))
    return rows.join(found, "row", "left").select(
        "row", "id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", "most_matched",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    docs = fixed(docs)
    found = benchmark_hits(docs, benchmark, id_column, text).select("row").distinct()
    return of_rows(docs, found, "left_anti")
