"""Accuracy over time: running from the start, and rolling over the last rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from valence.functions.labels import is_correct, real_value
from valence.session import written

ROLLING_ROWS = 50  # fixed length of the rolling frame
CURVES = ["running_accuracy", "running_error", "rolling_accuracy", "rolling_error"]


def with_correctness(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Add ``real_val`` and ``is_correct``."""
    return scored.withColumn("real_val", real_value(label)).withColumn(
        "is_correct", is_correct("real_val", prediction)
    )


def accuracy_curves(latest: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Number the rows of a bounded table in ``order`` and add the four curves.

    For the result of ``latest_n``, or one group column of it (``by``): without ``by`` the
    window runs in one task. ``history_curves`` does the same for a table of any size.
    Without a column ``label`` there is nothing to compare, and the curves are zero.
    """
    ordered = Window.partitionBy(*by).orderBy(*order)
    numbered = latest.withColumn("step", F.row_number().over(ordered))
    if "label" not in latest.columns:
        return numbered.withColumns({name: F.lit(0.0) for name in CURVES})
    running = F.avg("is_correct").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rolling = F.avg("is_correct").over(ordered.rowsBetween(1 - ROLLING_ROWS, 0))
    return _with_curves(with_correctness(numbered), running, rolling)


def history_curves(
    scored: DataFrame, *order: str, by: tuple[str, ...] = (), tasks: int | None = None
) -> DataFrame:
    """The curves over a whole store, for any number of rows and any size of its groups.

    ``order`` must be a unique key within ``by``. The rows are sorted once across the cluster
    (into ``tasks`` ranges), which is their only shuffle. Each task numbers and sums up its own
    rows, the rolling sum being the difference of two running ones, and writes them. A scan over the
    totals of the tasks says what the group that a task begins with brings from earlier ones: its rows, its hits, and the
    hits of its last rows, which complete the frames that reach back over the border.
    """
    spark = scored.sparkSession
    keys = [*by, *order]
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.md5(F.to_json(F.struct(*by), {"ignoreNullFields": "false"})) if by else F.lit("")
    ordered = (
        with_correctness(scored)
        .select(*keys, F.struct("real_val", "is_correct").alias("_judged"), group.alias("_group"))
        .repartitionByRange(tasks, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
    )
    sums = "_n long, _hits long, _rolling long, _tail array<long>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    rows = written(ordered.mapInArrow(_summed, f"{fields}, {sums}"), "curves")

    # A row per task, of a fixed size. It is what the driver scans and what is broadcast.
    ends = rows.filter(F.col("_tail").isNotNull()).select("_task", "_group", "_n", "_hits", "_tail")
    carried = spark.createDataFrame(
        _carried(sorted(ends.collect())),
        "_task int, _group string, _n0 long, _hits0 long, _tail0 array<long>",
    )
    joined = rows.join(F.broadcast(carried), ["_task", "_group"], "left")
    step = F.col("_n") + F.coalesce("_n0", F.lit(0))
    missing = F.least(ROLLING_ROWS - F.col("_n"), F.size("_tail0"))
    halo = F.when(missing > 0, F.get("_tail0", (missing - 1).cast("int")))
    rolling = (F.col("_rolling") + F.coalesce(halo, F.lit(0))) / F.least(step, F.lit(ROLLING_ROWS))
    running = (F.col("_hits") + F.coalesce("_hits0", F.lit(0))) / step
    shares = running.alias("_running"), rolling.alias("_rolling")
    judged = joined.select(*keys, step.alias("step"), "_judged.*", *shares)
    return _with_curves(judged, F.col("_running"), F.col("_rolling")).drop("_running", "_rolling")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, hits so far and hits of the frame for each row of a task, within its group.

    The last row of the task also has, for k from 1, the hits of the last k rows of its group, as many as a frame reaches back.
    """
    name, n, kept = None, 0, np.zeros(0, np.int64)  # the group so far: rows, and running hits of its last ROLLING_ROWS
    held = None  # the last batch and its sums
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield _with_sums(*held, None)
        groups = batch["_group"].to_numpy(zero_copy_only=False)
        hits = batch["_judged"].field("is_correct").to_numpy().astype(np.int64)
        out = np.zeros((3, len(hits)), np.int64)
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        for start, end in zip(first.tolist(), [*first[1:].tolist(), len(hits)]):
            if groups[start] != name:
                name, n, kept = groups[start], 0, np.zeros(1, np.int64)
            sums = np.cumsum(hits[start:end]) + kept[-1]
            every = np.concatenate([kept, sums])
            ends = np.arange(len(kept), len(every))
            out[0, start:end] = n + np.arange(1, end - start + 1)
            out[1, start:end] = sums
            out[2, start:end] = sums - every[np.maximum(ends - ROLLING_ROWS, 0)]
            n, kept = n + end - start, every[-ROLLING_ROWS:]
        held = batch, out
    if held is not None:
        tail = (kept[-1] - kept[-2::-1]).tolist()
        yield _with_sums(*held, tail)


def _with_sums(batch: pa.RecordBatch, out: np.ndarray, tail: list[int] | None) -> pa.RecordBatch:
    tails = pa.array([None] * (batch.num_rows - 1) + [tail], pa.list_(pa.int64()))
    names = [*batch.schema.names, "_n", "_hits", "_rolling", "_tail"]
    return pa.record_batch([*batch.columns, *map(pa.array, out), tails], names)


def _carried(ends: list) -> list[tuple]:
    """For each task the group that the tasks before it end with: its rows, its hits, and those of its last k rows."""
    out, name, n, hits, tail = [], None, 0, 0, []
    for task, group, own_n, own_hits, own_tail in ends:
        if out or name is not None:
            out.append((task, name, n, hits, tail))
        if group == name:  # groups are in order, so the task has no other
            own_tail = own_tail + [own_hits + x for x in tail[: ROLLING_ROWS - 1 - len(own_tail)]]
            own_n, own_hits = n + own_n, hits + own_hits
        name, n, hits, tail = group, own_n, own_hits, own_tail
    return out


def curve_bounds(curves: DataFrame) -> DataFrame:
    """Axis ranges: five percent points around the accuracies, and 0.1 over the errors."""
    lowest = F.least(F.min("running_accuracy"), F.min("rolling_accuracy"))
    highest = F.greatest(F.max("running_accuracy"), F.max("rolling_accuracy"))
    error = F.greatest(F.max("running_error"), F.max("rolling_error"))
    return curves.agg(
        F.greatest(F.lit(0.0), lowest - 5).alias("accuracy_low"),
        F.least(F.lit(100.0), highest + 5).alias("accuracy_high"),
        (error + 0.1).alias("error_high"),
    )


def _with_curves(df: DataFrame, running, rolling) -> DataFrame:
    return df.withColumns(
        {
            "running_accuracy": running * 100,
            "running_error": 1 - running,
            "rolling_accuracy": rolling * 100,
            "rolling_error": 1 - rolling,
        }
    )
