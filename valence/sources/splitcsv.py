"""Records of CSV files that may hold line breaks in quotes, read in splits.

Where a record begins depends on the quotes of everything before it, which is why such files are otherwise read by one task
each. But a line does to that state only one of four things: from outside or inside a quoted field it ends outside or
inside. Such functions can be put one after the other in any grouping, so

1. each split is cut into records as if it began outside quotes, and says what it does to both states;
2. a running composition over the splits of a file says which of them do begin inside (a row a split);
3. those, of which there are few, are cut again; all others were cut right;
4. records that reach over the end of a split are put together from their pieces (at most two pieces a split).

A quote opens a field only at its start, two quotes inside are one, and after a closing quote that is followed by something
else the field goes on to the next comma, so stray quotes do no harm to the lines after them. Lines end with a line feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from valence.session import written

#: Encodings in which a comma, a quote and a line feed are single bytes that are part of nothing else.
ENCODINGS = {"ISO-8859-1", "US-ASCII", "UTF-8"}

_PLAIN = rb'[^",][^,]*+'
_OPEN = rb'"[^"]*+(?:""[^"]*+)*+'
#: A line that begins outside quotes and ends inside: whole fields, and one that is not closed.
_ENDS_INSIDE = re.compile(rb"(?:(?:%b|%b\"(?:[^,\"][^,]*+)?)?+,)*+%b" % (_PLAIN, _OPEN, _OPEN), re.DOTALL)


def ends_inside(line: bytes, inside: bool) -> bool:
    if b'"' not in line:
        return inside
    return _ENDS_INSIDE.fullmatch(b'"' + line if inside else line) is not None


class Cutter:
    """Cuts the lines of a split into records, and follows what becomes of both states."""

    def __init__(self, inside: bool = False):
        self.now, self.other = inside, not inside
        self.held: list[bytes] = []

    def records(self, lines: list[bytes]) -> list[bytes]:
        """The records that end in these lines; what is left is held until the next."""
        now, other, held, done = self.now, self.other, self.held, []
        for line in lines:
            held.append(line)
            if b'"' in line:
                together = now == other
                now = ends_inside(line, now)
                other = now if together else ends_inside(line, other)
            if not now:
                done.append(line if len(held) == 1 else b"\n".join(held))
                held = []
        self.now, self.other, self.held = now, other, held
        return done

    def rest(self) -> bytes | None:
        return b"\n".join(self.held) if self.held else None


_PIECES = "file string, split long, n long, body binary, ends_inside boolean, other_ends_inside boolean"
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def _batch(place: tuple, n: int, bodies: list[bytes], ends: Cutter | None = None) -> pa.RecordBatch:
    """Pieces of a split from number n on; if it is over, the last row has its rest, if any, and its ends."""
    bodies = bodies + ([ends.rest()] if ends else [])
    states = [[None] * (len(bodies) - 1) + [x] for x in (ends.now, ends.other)] if ends else [[None] * len(bodies)] * 2
    places = [pa.repeat(pa.scalar(x, t), len(bodies)) for x, t in zip(place, (pa.string(), pa.int64()))]
    columns = [*places, pa.array(range(n, n + len(bodies)), pa.int64()), pa.array(bodies, pa.binary())]
    return pa.record_batch([*columns, *(pa.array(x, pa.bool_()) for x in states)], _NAMES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each split, as if it began outside; its last row says what the split does to both states."""
    place, cutter, n = None, Cutter(), 0
    for batch in batches:
        files, splits = batch["file"].dictionary_encode(), batch["split"].to_numpy()
        moved = (np.diff(files.indices.to_numpy()) != 0) | (np.diff(splits) != 0)
        edges = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
        lines = batch["line"].to_pylist()
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            here = (files[start].as_py(), int(splits[start]))
            if here != place:
                if place:
                    yield _batch(place, n, [], cutter)
                place, cutter, n = here, Cutter(), 0
            done = cutter.records(lines[start:end])
            yield _batch(place, n, done)
            n += len(done)
    if place:
        yield _batch(place, n, [], cutter)


def _cut_inside(table: pa.Table) -> pa.Table:
    """The pieces of a split that does begin inside. Put together again, they are its lines."""
    table = table.sort_by("n")
    place = (table["file"][0].as_py(), table["split"][0].as_py())
    text = b"\n".join(x for x in table["body"].to_pylist() if x is not None)
    cutter = Cutter(True)
    return pa.Table.from_batches([_batch(place, 0, cutter.records(text.split(b"\n")), cutter)])


def split_states(ends: DataFrame) -> DataFrame:
    """file, split and whether it begins inside quotes, from what each split makes of both states (one row each).

    A split that ends alike from both sets the state; one that swaps them turns it round. The state is the last
    that was set (outside, at the start of a file), turned round once for each swap since then.
    """
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("ends_inside") == F.col("other_ends_inside")
    swaps = (~sets & F.col("ends_inside")).cast("long")
    known = ends.withColumn("swaps", F.sum(swaps).over(up_to))
    # From outside a split that sets the state ends as it sets it.
    last = F.last(F.when(sets, F.struct(F.col("ends_inside").cast("long").alias("state"), "swaps")), ignorenulls=True).over(before)
    known = known.withColumn("last", last).withColumn("so_far", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    turned = F.col("so_far") - F.coalesce("last.swaps", F.lit(0)) + F.coalesce("last.state", F.lit(0))
    return known.select("file", "split", (turned % 2 == 1).alias("inside"))


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record`` (binary): the records of the files, without the line feed that ends them. Empty lines are none.

    The files are read once, in as many splits as Spark makes, and the pieces written to a table.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("line"),
    )
    pieces = written(lines.mapInArrow(_cut, _PIECES), "pieces")
    ends = pieces.filter(F.col("ends_inside").isNotNull()).select("file", "split", "ends_inside", "other_ends_inside")
    inside = written(split_states(ends).filter("inside").select("file", "split"), "splits")
    wrong = pieces.join(inside, ["file", "split"], "left_semi")
    cut_again = written(wrong.groupBy("file", "split").applyInArrow(_cut_inside, _PIECES), "pieces")
    right = pieces.join(inside, ["file", "split"], "left_anti")
    right, cut_again = (x.filter(F.col("body").isNotNull()) for x in (right, cut_again))
    # A piece is whole unless its record goes on in the next split or came from the one before.
    goes_on, begun = F.coalesce("ends_inside", F.lit(False)), F.col("n") == 0
    whole = right.filter(~goes_on).unionByName(cut_again.filter(~goes_on & ~begun)).select("body")
    parts = right.filter(goes_on).withColumn("begun", F.lit(False)).unionByName(
        cut_again.filter(goes_on | begun).withColumn("begun", begun)
    )
    so_far = Window.partitionBy("file").orderBy("split", "n")
    parts = parts.withColumn("record", F.sum((~F.col("begun")).cast("long")).over(so_far))
    joined = parts.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "n", F.col("body").cast("string").alias("text")))).alias("p"))
    joined = joined.select(F.array_join("p.text", "\n").cast("binary").alias("body"))
    return whole.unionByName(joined).filter(F.length("body") > 0).select(F.col("body").alias("record"))


def decoded(record: Column, encoding: str) -> Column:
    """A record as text. UTF-8 that is none is left to the parser."""
    return record.cast("string") if encoding == "UTF-8" else F.decode(record, encoding)
