"""Figures that are kept up to date while scored records arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import nlargest
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from valence.operators.curves import ROLLING_ROWS, with_correctness
from valence.operators.metrics import overview
from valence.sources.store import read_latest, write_delta

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_metrics(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    by: tuple[str, ...] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep ``overview`` of all records seen so far: one row of state per group.

    Each batch writes the groups that it changed and no others; ``read_latest`` puts them together.
    """
    writer = (
        overview(scored, by)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_delta(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


class _Newest(StatefulProcessor):
    """The last rows of a group in Spark's keyed state, and their accuracy after each batch that has rows of it."""

    def __init__(self, order: T.StructField, names: list[str]):
        self._names = names
        self._schema = T.StructType([T.StructField("place", order.dataType), T.StructField("is_correct", T.IntegerType())])

    def init(self, handle) -> None:
        self._rows = handle.getListState("newest", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = list(self._rows.get()) if self._rows.exists() else []
        every = chain(((r[0], r[1]) for r in before), ((r["_place"], r["is_correct"]) for r in rows))
        newest = nlargest(ROLLING_ROWS, every, key=lambda r: r[0])
        self._rows.put(newest)
        share = sum(r[1] for r in newest) / len(newest)
        values = (*key, newest[0][0], len(newest), share * 100, 1 - share)
        yield Row(**dict(zip(self._names, values, strict=True)))

    def close(self) -> None:
        pass


def start_rolling(
    scored: DataFrame,
    order: str,
    path: str,
    checkpoint: str,
    by: tuple[str, ...] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the accuracy of the last rows of each group, by ``order``, late ones in their place.

    ``order`` must be unique within a group and never null. Per batch, every task first cuts its rows down
    to the last of each group, so a group sends no more than that many per task. The state is that many
    rows per group, in Spark's state store; a batch touches and writes only the groups that it has rows of.
    """
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = with_correctness(scored).select(*by, F.col(order).alias("_place"), "is_correct", name.alias("_group"))
    rows = rows.mapInArrow(_newest_of_task, rows.schema)
    place = rows.schema["_place"]
    found = _rolling_schema(rows.schema, place, by)
    newest = rows.groupBy(*(by or ("_group",))).transformWithState(_Newest(place, found.names), found, "Update", "None")
    writer = (
        newest.select(*by, F.col("_last").alias("last"), "rows", "rolling_accuracy", "rolling_error")
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_delta(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )
    with _state_store(scored.sparkSession):
        return (writer.trigger(**trigger) if trigger else writer).start()


def _rolling_schema(schema: T.StructType, place: T.StructField, by: tuple[str, ...], last: str = "_last") -> T.StructType:
    keys = [schema[c] for c in by or (("_group",) if last == "_last" else ())]
    figures = [T.StructField("rows", T.LongType()), *(T.StructField(f"rolling_{c}", T.DoubleType()) for c in ("accuracy", "error"))]
    return T.StructType([*keys, T.StructField(last, place.dataType), *figures])


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state needs the state store in RocksDB; a query keeps the one that it is started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _newest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of each group among those of a task."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_group", "ascending"), ("_place", "descending")]))
        groups = rows["_group"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
        rank = np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))
        kept = rows.filter(pa.array(rank < ROLLING_ROWS))
    if kept is not None:
        yield from kept.combine_chunks().to_batches()


def last_rows(rows: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The last rows of each group of a table, as many as the rolling frame holds."""
    newest = F.col(order).desc()
    if not by:
        return rows.orderBy(newest).limit(ROLLING_ROWS)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(newest))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= ROLLING_ROWS).drop("_rank")


def rolling_accuracy(
    spark: SparkSession, path: str, schema: T.StructType, order: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """The current rolling accuracy of each group. ``schema`` is that of the scored records."""
    return read_latest(spark, path, _rolling_schema(schema, schema[order], by, "last"), by)
