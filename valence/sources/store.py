"""Tables that a stream writes: an append-only store of batches, and the groups that each batch changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

SCORED, REJECTED = "scored", "rejected"

STORE_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("prediction", T.DoubleType()),
    ]
)


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch to its own folder; writing it again replaces it.

    The column ``outcome`` becomes a subfolder, so that readers of one outcome skip the rest.
    """
    # Static: nothing of an earlier attempt may remain, whatever the session says.
    writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("outcome").parquet(f"{path}/batch_id={batch_id}")


def read_store(
    spark: SparkSession,
    path: str,
    schema: T.StructType = STORE_SCHEMA,
    outcome: str = SCORED,
) -> DataFrame:
    """The records of one outcome with their ``batch_id``; no rows while nothing is stored."""
    folders = [T.StructField("batch_id", T.LongType()), T.StructField("outcome", T.StringType())]
    store = _read(spark, path, T.StructType([*schema.fields, *folders]))
    return store.filter(F.col("outcome") == outcome).drop("outcome")


def write_delta(changed: DataFrame, batch_id: int, path: str) -> None:
    """Write the groups that a micro-batch changed, as they are after it; writing a batch again replaces it."""
    changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_latest(spark: SparkSession, path: str, schema: T.StructType, by: tuple[str, ...] = ()) -> DataFrame:
    """Each group as the last micro-batch that changed it left it; no rows while there is none."""
    deltas = _read(spark, path, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    newest = F.max_by(F.struct(*schema.names), "batch_id").alias("_newest")
    return deltas.groupBy(*by).agg(newest).filter(F.col("_newest").isNotNull()).select("_newest.*")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
