"""License texts in documents: MinHash bands over overlapping windows, then exact containment.

Templates are cut into five-word shingles (words: runs of letters and digits in lower case). For each size class of
templates (n to about 1.4 n shingles) a text is cut into windows long enough for the largest of the class plus a cell of a quarter of the smallest,
one window starting at each cell, so an occurrence lies whole in a window. Window and template then have a Jaccard similarity of at
least 0.43 if the window holds 0.8 of the template's shingles. HASHES bands of one MinHash each find such a pair but for 0.57**24 = 1.4e-6.

Two Bloom filters of fixed size keep the work small: texts without a shingle of any template are left after the first look (their windows
can't share a MinHash with a template), and a window's values that are no template's never leave the task. What is left is
joined with the templates' bands, and verified by the share of the template's shingles that the window has.

Defined: null and empty texts have no license. A template of fewer than five words is one shingle and only found as a whole text. A row and a
template give one row, with the window that has most of it (the first among equals). Repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valence.llm.common import (
    Words, bloom_filter, characters, fixed, may_hold, mixed, numbered, pieces, row_of, shingles, signed,
)
from valence.session import written

WIDTH, CONTAINED, HASHES = 5, 0.8, 24
_SALTS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def size_class(n: int) -> int:
    """Number of the class: sizes 1, 2, 3, 4-5, 6-7, 8-11, ...: the square root of two apart."""
    return int(np.floor(2 * np.log2(n) + 1e-9))


def class_bounds(number: int) -> tuple[int, int, int]:
    """Largest number of shingles in a class, cell, and cells in a window."""
    low = int(np.ceil(2 ** (number / 2) - 1e-9))
    high = max(low, int(np.ceil(2 ** ((number + 1) / 2) - 1e-9)) - 1)
    cell = max(1, low // 4)
    return high, cell, -(-high // cell) + (cell > 1)


def min_hashes(keys: np.ndarray) -> np.ndarray:
    """The values of each shingle by hash function: HASHES by n."""
    with np.errstate(over="ignore"):
        return mixed(keys[None, :] ^ _SALTS[:, None])


def band_keys(least: np.ndarray, number: int) -> np.ndarray:
    """MinHash values (functions by windows) as keys that differ by function and class."""
    with np.errstate(over="ignore"):
        return mixed(least + _SALTS[:, None] * np.uint64(2 * number + 1))


def _template_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data, bounds in pieces(batch["body"]):
            w = Words(data, bounds, "plain")
            keys, text, _ = shingles(w, WIDTH)
            for t in range(w.texts):
                own = np.unique(keys[text == t])
                if len(own):
                    number = size_class(len(own))
                    bands = band_keys(min_hashes(own).min(1)[:, None], number)[:, 0]
                    yield pa.record_batch(
                        [batch["row"].slice(i + t, 1), pa.array([number]), pa.array([signed(own)]), pa.array([signed(bands)])],
                        ["template", "number", "shingles", "bands"],
                    )


def _windows(numbers: list[int], some, held):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, "plain")
                keys, text, at = shingles(w, WIDTH)
                hit = np.unique(text[may_hold(some.value, keys)])
                for t in hit:
                    a, b = np.searchsorted(text, [t, t + 1])
                    first = at[a:b]
                    last = np.minimum(first + WIDTH, w.first[t + 1]) - 1
                    here = np.full(b - a, t)
                    starts = characters(data, w.start[first], bounds, here)
                    ends = characters(data, w.start[last] + w.size[last], bounds, here)
                    out = list(_found(keys[a:b], starts, ends, numbers, held))
                    if out:
                        columns = [pa.array([int(row[i + t])] * len(out)), *[pa.array([x[k] for x in out], kind) for k, kind in enumerate(
                            (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4)
                        )]]
                        yield pa.record_batch(columns, ["row", "number", "at", "shingles", "starts", "ends", "bands"])

    return cut


def _found(keys, starts, ends, numbers, held):
    """The windows of a text that share a MinHash with a template of their class, perhaps."""
    values = min_hashes(keys)
    for number in numbers:
        _, cell, cells = class_bounds(number)
        least = np.minimum.reduceat(values, np.arange(0, len(keys), cell), axis=1)
        whole = least.copy()
        for k in range(1, min(cells, least.shape[1])):
            whole[:, :-k] = np.minimum(whole[:, :-k], least[:, k:])
        bands = band_keys(whole, number)
        live = may_hold(held.value, bands.ravel()).reshape(bands.shape)
        for c in np.flatnonzero(live.any(0)):
            a, b = c * cell, min(len(keys), (c + cells) * cell)
            yield number, int(a), signed(keys[a:b]), starts[a:b], ends[a:b], signed(np.ascontiguousarray(bands[live[:, c], c]))


def license_matches(docs: DataFrame, templates: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row, id, template_id, containment, start, end (code points). ``templates`` has template_id and text."""
    docs = fixed(docs, id_column, text)
    body = numbered(docs, text, id_column).select("row", F.col(f"own_{id_column}").alias("id"), "body")
    given = numbered(fixed(templates, "template_id", "text"), "text", "template_id")
    known = written(
        given.select("row", "body").mapInArrow(
            _template_bands, "template long, number long, shingles array<long>, bands array<long>"
        ),
        "templates",
    )
    numbers = sorted(r.number for r in known.select("number").distinct().collect())
    some = bloom_filter(known.select(F.explode("shingles").alias("h")), "h", 24)
    held = bloom_filter(known.select(F.explode("bands").alias("h")), "h", 24)
    cut = written(
        body.select("row", "body").mapInArrow(
            _windows(numbers, some, held),
            "row long, number long, at long, shingles array<long>, starts array<long>, ends array<long>, bands array<long>",
        ),
        "windows",
    )
    keyed = known.select("template", F.explode("bands").alias("band"))
    pairs = cut.select("row", "number", "at", F.explode("bands").alias("band")).join(keyed, "band").select("row", "number", "at", "template").distinct()
    full = pairs.join(cut.drop("bands"), ["row", "number", "at"]).join(known.select("template", F.col("shingles").alias("wanted")), "template")
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    hits = F.filter(F.arrays_zip("shingles", "starts", "ends"), lambda x: F.array_contains("wanted", x["shingles"]))
    good = full.withColumn("containment", share).filter(F.col("containment") >= CONTAINED).withColumn("hits", hits)
    good = good.select("row", "template", "containment", F.array_min(F.transform("hits", lambda x: x["starts"])).alias("start"), F.array_max(F.transform("hits", lambda x: x["ends"])).alias("end"))
    best = good.groupBy("row", "template").agg(F.min(F.struct((-F.col("containment")).alias("order"), (F.col("end") - F.col("start")).alias("size"), "start", "end")).alias("best"))
    names = given.select(F.col("row").alias("template"), F.col("own_template_id").alias("template_id"))
    ids = docs.select(row_of(docs), F.col(id_column).alias("id"))
    return best.join(names, "template").join(ids, "row").select(
        "row", "id", "template_id", (-F.col("best.order")).alias("containment"), F.col("best.start").alias("start"), F.col("best.end").alias("end")
    )
