"""Micro-batches into a sink that can only append, each record once.

A sink does not know whether it has seen a batch. So a batch is first staged, as a table with a number for each row, and after
it was appended its number is entered in a ledger. A batch that is in the ledger is not written again. One that is
staged but not in the ledger was interrupted somewhere: what the sink already has of it is looked up there, by the numbers
of batch and row, and only the rest is appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH, ROW = "batch_id", "batch_row"
_FILES = ("parquet", "orc", "json", "csv", "text", "avro")


class Ledger:
    """Below ``path``: ``staged-N``, the rows of batch N, and ``done-N``, the mark that batches up to N are in the sink."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self._path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, pattern: str, of: Callable[[str], str]) -> list[int]:
        found = self._files.globStatus(self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{pattern}")) or []
        return [int(of(f.getPath().toString()).rpartition("-")[2]) for f in found]

    def done(self, batch_id: int) -> bool:
        return batch_id <= max(self._numbers("done-*", str), default=-1)

    def is_staged(self, batch_id: int) -> bool:
        return batch_id in self._numbers("staged-*/_SUCCESS", lambda p: p.rpartition("/")[0])

    def stage(self, rows: DataFrame, batch_id: int) -> None:
        numbered = rows.withColumns({BATCH: F.lit(batch_id).cast("long"), ROW: F.monotonically_increasing_id()})
        numbered.write.mode("overwrite").parquet(f"{self._path}/staged-{batch_id}")

    def staged(self, batch_id: int) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/staged-{batch_id}")

    def enter(self, batch_id: int) -> None:
        """Batches are written one after the other, so the newest mark stands for all before it."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path
        self._files.create(path(f"{self._path}/done-{batch_id}"), True).close()
        for old in self._numbers("done-*", str):
            if old < batch_id:
                self._files.delete(path(f"{self._path}/done-{old}"), False)
        for old in self._numbers("staged-*", str):
            if old <= batch_id:
                self._files.delete(path(f"{self._path}/staged-{old}"), True)


def append_once(
    rows: DataFrame, batch_id: int, ledger: str, fmt: str, options: dict[str, str],
    seen: Callable[[SparkSession], DataFrame] | None = None,
) -> None:
    """Append the rows of a micro-batch with a batch format, however often and wherever it was interrupted before.

    The sink gets the columns ``batch_id`` and ``batch_row``. ``seen`` reads it back; by default with the same format and options.
    """
    spark = rows.sparkSession
    book = Ledger(spark, ledger)
    if book.done(batch_id):
        return
    again = book.is_staged(batch_id)
    if not again:
        book.stage(rows, batch_id)
    staged = book.staged(batch_id)
    if again:
        there = seen(spark) if seen else _read_back(spark, fmt, options, staged)
        if there is not None:
            there = there.filter(F.col(BATCH) == batch_id).select(F.col(ROW).cast("long").alias(ROW))
            staged = staged.join(there, ROW, "left_anti").select(*staged.columns)
    staged.write.format(fmt).options(**options).mode("append").save()
    book.enter(batch_id)


def _read_back(spark: SparkSession, fmt: str, options: dict[str, str], like: DataFrame) -> DataFrame | None:
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(like.schema) if fmt in _FILES else reader).load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
