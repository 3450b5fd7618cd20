"""Exact duplicates by naming blocks: sort fixed-size blocks into integers, then pairs of integers.

A text is cut into blocks of a fixed number of bytes. All blocks of the table are sorted, and
equal ones get the same integer. Adjacent integers of a text are put together and sorted the same
way, until each text has a single one. Texts are compared by content in every step, so
two texts share their last name if and only if they are equal; no hash decides.

The sort is by a hash of the block and then by place, so copies of one block spread over as many
partitions as they need. A partition names its own runs; the runs at its ends, of which there
are two, are matched with those of the others by a table of that size.

Rows with an equal text form a group, also rows that repeat with the same id. The row with the
smallest id stays (a null id counts as the largest; among equal ids the first row).
Null texts count as empty, and all empty texts are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from valence.llm.common import fixed, numbered, of_rows
from valence.session import written

BLOCK = 4096
_NAMES = "row long, pos int, id long, sha string, count int, name long, edge binary"


def normalised(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal blocks in a sorted partition; list those that may go on elsewhere."""
    first = TaskContext.get().partitionId() << 33
    runs = 0  # begun so far
    last: bytes | None = None
    first_h = last_h = None
    ends: dict[int, list[tuple[bytes, int]]] = {}  # by hash: of the first and the latest one only
    for batch in batches:
        if not batch.num_rows:
            continue
        block, h = batch["block"], batch["h"].to_numpy()
        new = np.ones(len(h), bool)
        if len(h) > 1:
            new[1:] = ~pc.equal(block.slice(1), block.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or block[0].as_py() != last
        number = runs + np.cumsum(new) - 1
        if first_h is None:
            first_h = int(h[0])
        final = int(h[-1])
        for i in np.flatnonzero(new & ((h == first_h) | (h == final))):
            ends.setdefault(int(h[i]), []).append((block[int(i)].as_py(), first + int(number[i])))
        last_h, last, runs = final, block[len(h) - 1].as_py(), int(number[-1]) + 1
        ends = {k: v for k, v in ends.items() if k in (first_h, last_h)}
        columns = [batch[c] for c in ("row", "pos", "id", "sha", "count")]
        yield pa.record_batch(
            [*columns, pa.array(first + number), pa.nulls(len(h), pa.binary())],
            ["row", "pos", "id", "sha", "count", "name", "edge"],
        )
    edges = [x for v in ends.values() for x in v]
    if edges:
        n = len(edges)
        nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())]
        yield pa.record_batch(
            [*nulls, pa.array([x[1] for x in edges], pa.int64()), pa.array([x[0] for x in edges], pa.binary())],
            ["row", "pos", "id", "sha", "count", "name", "edge"],
        )


def named(blocks: DataFrame) -> DataFrame:
    """``block`` (binary) as ``name`` (long): equal if and only if the blocks are. One sort of the blocks."""
    ordered = (
        blocks.withColumn("h", F.xxhash64("block"))
        .repartitionByRange("h", "row", "pos")
        .sortWithinPartitions("h", "block", "row", "pos")
    )
    columns = ordered.select("row", "pos", "id", "sha", "count", "block", "h")
    found = written(columns.mapInArrow(_name_runs, _NAMES), "names")
    edges = found.filter("edge IS NOT NULL").select("edge", "name")
    known = edges.groupBy("edge").agg(F.min("name").alias("same"))
    moved = edges.join(known, "edge").filter("same <> name").select("name", "same")
    return (
        found.filter("edge IS NULL")
        .drop("edge")
        .join(moved, "name", "left")
        .select("row", "pos", "id", "sha", "count", F.coalesce("same", "name").alias("name"))
    )


def _bytes(name: str) -> Column:
    return F.unhex(F.lpad(F.hex(name), 16, "0"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per row of ``docs``: row, id, keep_id, group_size, kept, text_sha256."""
    rows = numbered(docs, text, id_column).select(
        "row", F.col(f"own_{id_column}").alias("id"), normalised(F.col("body")).cast("binary").alias("body")
    )
    count = F.greatest(F.lit(1), F.ceil(F.length("body") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("body", i * block + 1, F.lit(block)))
    blocks = rows.select("row", "id", F.sha2("body", 256).alias("sha"), count.alias("count"), F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    now = named(blocks.select("row", "pos", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha"), "count", "block"))

    level, done = 0, []
    while True:
        whole = now.filter(F.col("count") == 1)
        done.append(whole.select("row", "id", "sha", F.lit(level).alias("level"), "name"))
        rest = now.filter(F.col("count") > 1)
        if rest.isEmpty():
            break
        half = F.shiftright("pos", 1)
        side = [F.max(F.when(F.col("pos").bitwiseAND(F.lit(1)) == k, F.col("name"))) for k in (0, 1)]
        pairs = rest.groupBy("row", half.alias("pos")).agg(
            F.max("id").alias("id"), F.max("sha").alias("sha"),
            F.shiftright(F.max("count") + 1, 1).alias("count"), side[0].alias("a"), side[1].alias("b"),
        )
        both = F.when(F.col("b").isNull(), _bytes("a")).otherwise(F.concat(_bytes("a"), _bytes("b")))
        now = named(pairs.select("row", "pos", "id", "sha", "count", both.alias("block")))
        level += 1

    identity = done[0]
    for more in done[1:]:
        identity = identity.union(more)
    identity = written(identity, "identities")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    # As a table, so that the join below can split a hot group.
    groups = written(identity.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return identity.join(groups, ["level", "name"]).select(
        "row", "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = fixed(docs)
    return of_rows(docs, exact_groups(docs, id_column, text).filter("kept"), "left_semi")
