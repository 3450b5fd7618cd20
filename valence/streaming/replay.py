"""Play a table as a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valence.operators.split import shuffle_positions
from valence.sources.messages import publish, to_messages

POSITION = "position"


def write_replay(
    posts: DataFrame,
    path: str,
    key: str = "id",
    seed: int = 42,
    files: int | None = None,
    label: str = "target",
    keep: tuple[str, ...] = (),
) -> None:
    """Write posts as messages into files, in a reproducible random order.

    Each message carries its ``position`` in that order, from 0: sort by it, whatever batch a message came in.
    A file source takes files by their time, so the times follow the order too, where the file system lets
    them be set (object stores do not). The reader sets the pace: ``maxFilesPerTrigger`` files per ``processingTime``.
    """
    spark = posts.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = shuffle_positions(posts, key, seed, POSITION)
    ordered = placed.repartitionByRange(files, POSITION).sortWithinPartitions(POSITION)
    before = {name for name, _ in _files(spark, path)}
    publish(to_messages(ordered, label, (*keep, POSITION)), "text", path=path)
    _date_in_order(spark, path, before)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and time of the files of messages; there are as many as partitions were written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [(f.getPath().getName(), f.getModificationTime()) for f in system.listStatus(folder)]
    return sorted(f for f in found if f[0].startswith("part-"))


def _date_in_order(spark: SparkSession, path: str, before: set[str]) -> None:
    new = [f for f in _files(spark, path) if f[0] not in before]
    latest = max((time for _, time in new), default=0)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, (name, _) in enumerate(new):
        system.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), latest + i, -1)
