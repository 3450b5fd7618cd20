"""The inputs of the registered queries, derived from the given tables, and the same in SQL.

The tables hold no CSV posts and no model output. Texts and labels come from ``documents`` and
``labels``; scored records are ``events``, with a label and a prediction computed from their
columns (errors have no label, the largest values no prediction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from valence.operators.split import hash_share
from valence.operators.classify import training_view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, read as they lie at every size."""
    return table(spark, sf, "documents")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as posts; those without a label have no target."""
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        (F.col("quality") * 4).cast("int").alias("target"),
        F.col("doc_id").alias("id"),
        F.col("n_chars").cast("string").alias("date"),
        F.col("lang").alias("flag"),
        F.col("source").alias("user"),
        "text",
    )


POSTS_SQL = """posts AS (
  SELECT CAST(quality * 4 AS INTEGER) AS target, doc_id AS id,
         CAST(n_chars AS VARCHAR) AS date, lang AS flag, source AS "user", text
  FROM documents LEFT JOIN labels USING (doc_id))"""


def train_and_live(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows to train on, and all other posts."""
    every = posts(spark, sf)
    to_train_on = F.col("target").isNotNull() & (hash_share("id") < 0.8)
    return training_view(every.filter(to_train_on)), every.filter(~to_train_on)


LIVE_SQL = (
    POSTS_SQL
    + """,
live AS (
  SELECT * FROM posts
  WHERE target IS NULL OR CAST('0x' || substr(md5('42:' || id), 25, 8) AS BIGINT) >= round(0.8 * 4294967296))"""
)


def as_scored(events: DataFrame) -> DataFrame:
    """Events as scored records. Batch or stream."""
    k = F.from_json("props", "k INT")["k"]
    return events.select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") != "error", F.when(k >= 50, 4).otherwise(0)).alias("label"),
        F.when(
            F.col("value") <= 300, F.when(F.col("value") >= 30, 1.0).otherwise(0.0)
        ).alias("prediction"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return as_scored(table(spark, sf, "events"))


SCORED_SQL = """scored AS (
  SELECT event_id, event_type,
         CASE WHEN event_type <> 'error' THEN
           CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 4 ELSE 0 END
         END AS label,
         CAST(CASE WHEN value <= 300 THEN
           CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END END AS DOUBLE) AS prediction
  FROM events)"""

JUDGED_SQL = (
    SCORED_SQL
    + """,
judged AS (
  SELECT *, CAST(coalesce(real_val = prediction, false) AS INTEGER) AS is_correct
  FROM (SELECT *, CAST(CASE WHEN label = 4 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS real_val
        FROM scored))"""
)

LATEST_SQL = (
    JUDGED_SQL
    + """,
latest AS (SELECT * FROM judged ORDER BY event_id DESC LIMIT 2000)"""
)


def curves_sql(rows: str, by: str = "") -> str:
    """The CTE ``curves`` over ``rows``, per ``by``."""
    part = f"PARTITION BY {by}" if by else ""
    running = f"{part} ORDER BY event_id ROWS UNBOUNDED PRECEDING"
    rolling = f"{part} ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"
    # Sums and counts are whole numbers, so both engines divide the same two.
    return f"""curves AS (
  SELECT *, running * 100 AS running_accuracy, 1 - running AS running_error,
         rolling * 100 AS rolling_accuracy, 1 - rolling AS rolling_error
  FROM (
    SELECT *, CAST(row_number() OVER ({part} ORDER BY event_id) AS BIGINT) AS step,
           sum(is_correct) OVER ({running})::DOUBLE / count(*) OVER ({running}) AS running,
           sum(is_correct) OVER ({rolling})::DOUBLE / count(*) OVER ({rolling}) AS rolling
    FROM {rows}))"""
