"""Messages in, scored records out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from valence.operators.classify import current_version, load_version, score
from valence.sources.messages import MESSAGE_SCHEMA, checked_messages
from valence.sources.store import SCORED, write_batch
from valence.streaming.ledger import append_once

UNTIL_EMPTY = {"availableNow": True}


def scored_stream(
    raw: DataFrame,
    model: PipelineModel,
    schema: T.StructType = MESSAGE_SCHEMA,
    keep: tuple[str, ...] = (),
    names: tuple[str, str] = ("NEGATIVE", "POSITIVE"),
) -> DataFrame:
    """Parse and score a stream of messages.

    A message without a text, or with a field that is there but cannot be read (such as a label that is no
    whole number), is not scored: it comes out as rejected, with its original content in ``raw`` and
    the ``reasons`` by field.
    """
    parsed = checked_messages(raw, schema, keep=("value", *keep))
    well = F.col("reasons").isNull()
    parsed = parsed.withColumn("raw", F.when(~well, F.col("value").cast("string")))
    return score(model, parsed.withColumn("text", F.when(well, F.col("text"))).drop("value"), names)


def start_store(
    scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, echo: bool = False
) -> StreamingQuery:
    """Append each micro-batch to the store, once, however often it is run.

    ``trigger`` is passed on, e.g. ``{"processingTime": "1 second"}``; without one a batch
    follows the other until the query is stopped. ``echo`` prints the start of each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, path)
        if echo:
            stored = batch.sparkSession.read.schema(batch.schema)
            stored.parquet(f"{path}/batch_id={batch_id}").show(truncate=False)

    return _start(scored, write, checkpoint, trigger)


def start_versioned_store(
    raw: DataFrame,
    models: str,
    path: str,
    checkpoint: str,
    schema: T.StructType = MESSAGE_SCHEMA,
    keep: tuple[str, ...] = (),
    names: tuple[str, str] = ("NEGATIVE", "POSITIVE"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score messages into a store with the model that is current below ``models`` (see ``save_version``).

    Which one that is, is looked up when a micro-batch begins and holds for all of it; the column ``model_version`` says so.
    So a model can be replaced while the stream runs.
    """
    loaded: dict[int, PipelineModel] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        version = current_version(batch.sparkSession, models)
        if version not in loaded:
            loaded.clear()
            loaded[version] = load_version(models, version)
        scored = scored_stream(batch, loaded[version], schema, keep, names)
        write_batch(scored.withColumn("model_version", F.lit(version)), batch_id, path)

    return _start(raw, write, checkpoint, trigger)


def start_sink(
    scored: DataFrame,
    fmt: str,
    options: dict[str, str],
    checkpoint: str,
    rejects: str,
    trigger: dict | None = None,
    ledger: str | None = None,
    seen: Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the scored records of each micro-batch with any batch format, e.g. ``mongodb``, each once.

    The other records go to a store at ``rejects``, once each, so that none is lost. Below ``ledger`` (by
    default in the folder of the rejects) it is kept which batches the sink has; see ``append_once``.
    """

    if not rejects:
        raise ValueError("name a place for the records that are not scored")
    book = ledger or f"{rejects.rstrip('/')}/_ledger"

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.filter(~F.col("outcome").eqNullSafe(SCORED)), batch_id, rejects)
        rows = batch.filter(F.col("outcome") == SCORED).drop("outcome", "raw", "reasons")
        append_once(rows, batch_id, book, fmt, options, seen)

    return _start(scored, write, checkpoint, trigger)


def _start(df: DataFrame, write, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
