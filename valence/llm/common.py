"""What several operators share: numbered rows, words as hashes, and Bloom filters of a fixed size.

Words are found and hashed a few megabytes of text at a time with numpy, inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from valence.session import written

PIECE = 4 << 20
#: What marks the column with the numbers that ``fixed`` gives (its name is one that is free), and the bits that count the rows of a file.
_MARK, _INDEX_BITS = "valence.row", 36
#: Bytes of file names up to which the table of their numbers is broadcast.
NAMES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numbered(docs: DataFrame, text: str, *also: str) -> DataFrame:
    """``row`` (a number of each row), ``body`` (the text, null as empty) and the columns named.

    Rows are told apart by this number, so ids may repeat or be null. It is the number of ``fixed`` if ``docs``
    has one; without it, it holds for a single scan only, as it depends on how Spark cuts the files.
    """
    return docs.select(
        row_of(docs),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
        *[F.col(c).alias(f"own_{c}") for c in also],
    )


def row_column(docs: DataFrame) -> str | None:
    """The name of the column that ``fixed`` added. It is known by a mark in the schema, so columns of users may have any name."""
    return next((f.name for f in docs.schema if f.metadata.get(_MARK)), None)


def row_of(docs: DataFrame) -> Column:
    """Its number, under no mark, so that tables made from it can have several rows of a number."""
    name = row_column(docs)
    return (docs[name] if name else F.monotonically_increasing_id()).alias("row", metadata={_MARK: False})


def of_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` (from ``fixed``) whose number is among those of ``rows`` (left_semi) or isn't (left_anti), without the number."""
    name = row_column(docs)
    found = rows.select(F.col("row").alias(name))
    return docs.join(found, name, how).select(*[f"`{c}`" for c in docs.columns if c != name])


def fixed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (or these columns of it) with a number of each row that is the same in every scan (``row_column``).

    Rows of a Parquet table are numbered by their file and their place in it, which don't depend on how the files
    are cut into tasks. Anything else is numbered and written to a table once.
    """
    if row_column(docs):
        return docs
    kept = docs.select(*dict.fromkeys(columns)) if columns else docs
    taken = {c.lower() for c in docs.columns}
    row, file, first = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("row", "file", "first"))

    def marked(number: Column) -> Column:
        return number.alias(row, metadata={_MARK: True})

    if not _one_table(docs):
        return written(kept.select("*", marked(F.monotonically_increasing_id())), "numbered")
    place = docs.metadataColumn("_metadata")
    paths = sorted(r[0] for r in docs.select(place["file_path"]).distinct().collect())
    if len(paths) < 2:
        return kept.select("*", marked(place["row_index"]))
    numbers = [(path, n << _INDEX_BITS) for n, path in enumerate(paths)]
    files = docs.sparkSession.createDataFrame(numbers, f"{file} string, {first} long")
    if sum(map(len, paths)) <= NAMES:
        files = F.broadcast(files)
    rows = kept.select("*", place["file_path"].alias(file), place["row_index"].alias(row))
    rows = rows.join(files, file)
    return rows.select(*[f"`{c}`" for c in kept.columns], marked(F.col(row) + F.col(first)))


def _one_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns and rows of one Parquet table, each row at most once and the same in every scan."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    table = plan.relation()
    return table.fileFormat().toString() == "Parquet" and table.location().rootPaths().size() == 1


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """What is run within sends Arrow batches of about ``size`` bytes, so that a task holds less of its texts at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def training_part(id_column: str, part: int) -> Column:
    """True where crc32 of the id as text leaves another remainder by 5 than ``part``, or there is no id."""
    left = F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(5))
    return F.coalesce(left != part, F.lit(True))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread evenly (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), _BASE)]), dtype=np.uint64)
    return _POWERS


def _letters(kind: str) -> np.ndarray:
    """For each byte the value it counts with, 0 outside words. A-Z count as a-z."""
    value = np.zeros(256, np.uint8)
    if kind == "visible":
        value[:] = np.arange(256)
        value[[0x20, *range(0x09, 0x0E)]] = 0
        value[0] = 0x20  # a zero byte is part of a word; a blank never is
    else:
        for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
            value[first : last + 1] = np.arange(first, last + 1)
    value[0x41:0x5B] = np.arange(0x61, 0x7B)
    return value


_VALUES = {kind: _letters(kind) for kind in ("visible", "plain")}


class Words:
    """The words of some texts: hashes, the text each is in, and where it starts and ends (bytes)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: str):
        value = _VALUES[kind][data]
        inside = value != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[firsts] = inside[firsts]
        at = np.flatnonzero(inside)
        lead = np.flatnonzero(begins[at])
        sizes = np.diff(lead, append=len(at))
        self.start = at[lead]
        self.size = sizes
        self.text = np.searchsorted(bounds, self.start, "right") - 1
        if len(at):
            place = np.arange(len(at)) - np.repeat(lead, sizes)
            with np.errstate(over="ignore"):
                terms = value[at].astype(np.uint64) * _powers(int(sizes.max()))[place]
                self.hash = mixed(np.add.reduceat(terms, lead) + sizes.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.texts = len(bounds) - 1
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.text, np.arange(self.texts + 1))


def pieces(bodies: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts, about ``size`` bytes at a time: number of the first, bytes, bounds of the texts."""
    bodies = pa.concat_arrays([bodies.cast(pa.large_binary()).fill_null(b"")])
    bounds = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    held = bodies.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    i = 0
    while i < len(bodies):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def characters(data: np.ndarray, places: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places in bytes as code points from the start of their text."""
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return count[places] - count[bounds[texts]]


def runs(keys: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values, by the place of the first."""
    n = max(0, len(keys) - width + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + keys[k : k + n]
    return mixed(out)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text: hash, text, number of the first word. A shorter text is one shingle."""
    hashes = runs(words.hash, width)
    at = np.flatnonzero(words.text[: len(hashes)] == words.text[width - 1 :])
    hashes, text = hashes[at], words.text[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        more = np.array([int(runs(words.hash[words.first[t] : words.first[t + 1]], int(count[t]))[0]) for t in short], np.uint64)
        order = np.argsort(np.concatenate([text, short]), kind="stable")
        hashes, text = np.concatenate([hashes, more])[order], np.concatenate([text, short])[order]
        at = np.concatenate([at, words.first[short]])[order]
    return hashes, text, at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bloom_filter(hashes: DataFrame, column: str, bits: int = 27) -> Broadcast:
    """A Bloom filter of 2**bits bits over 64-bit hashes, broadcast to the workers.

    Its size does not depend on the rows: with more rows it lets more others through, never
    fewer of its own. Words of 64 bits reach the driver, at most 2**(bits - 6).
    """
    words = 1 << (bits - 6)
    key = F.col(column)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")) for place in (
        F.shiftrightunsigned(key, 58), F.shiftrightunsigned(key, 52).bitwiseAND(F.lit(63))
    )]
    marked = hashes.filter(key.isNotNull()).select(
        key.bitwiseAND(F.lit(words - 1)).alias("word"), bit[0].bitwiseOR(bit[1]).alias("mask")
    )
    found = marked.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    held = np.zeros(words, np.uint64)
    held[found["word"].to_numpy()] = signed_back(found["mask"].to_numpy())
    return hashes.sparkSession.sparkContext.broadcast(held)


def signed_back(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def may_hold(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the filter may hold the hash: all that it holds, and a few others."""
    one = np.uint64(1)
    mask = (one << (hashes >> np.uint64(58))) | (one << ((hashes >> np.uint64(52)) & np.uint64(63)))
    return held[hashes & np.uint64(len(held) - 1)] & mask == mask


def spread(column: str) -> Column:
    """A row number as an even 64-bit hash."""
    return F.xxhash64(F.col(column))


def words_of(docs: DataFrame, rows: DataFrame, kind: str = "plain") -> DataFrame:
    """Row, hashes of all words, and their first and last code points, for the rows that ``rows`` names.

    A filter of fixed size picks the texts before their words are found, so texts aren't shuffled.
    """
    picked = bloom_filter(rows.select(spread("row").alias("h")), "h", 24)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(picked.value, signed_back(batch["h"].to_numpy()))))
            for i, data, bounds in pieces(batch["body"]):
                w = Words(data, bounds, kind)
                starts = characters(data, w.start, bounds, w.text)
                ends = characters(data, w.start + w.size, bounds, w.text)
                lists = [pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(x)) for x in (signed(w.hash), starts, ends)]
                yield pa.record_batch([batch["row"].slice(i, w.texts), *lists], ["row", "words", "starts", "ends"])

    return docs.select("row", "body", spread("row").alias("h")).mapInArrow(found, "row long, words array<long>, starts array<long>, ends array<long>")
