"""Queries over files, messages, trained models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from valence.operators import classify
from valence.functions.text import percent
from valence.operators.latest import MONITORED_ROWS, latest_n
from valence.operators.metrics import accuracy, kpi_snapshot, overview
from valence.plans.inputs import (
    JUDGED_SQL,
    LIVE_SQL,
    POSTS_SQL,
    as_scored,
    posts,
    scored,
    table,
    train_and_live,
)
from valence.session import shared_dir
from valence.sources.csvfiles import read_posts, read_posts_and_rejects, write_posts
from valence.sources.messages import (
    MESSAGE_SCHEMA,
    checked_messages,
    message_stream,
    parse_messages,
    publish,
    to_messages,
)
from valence.sources.store import (
    REJECTED,
    SCORED,
    STORE_SCHEMA,
    read_latest,
    read_store,
)
from valence.streaming.monitoring import rolling_accuracy, start_metrics, start_rolling
from valence.streaming.replay import POSITION, write_replay
from valence.streaming.scoring import UNTIL_EMPTY, scored_stream, start_store

_K = T.StructType([T.StructField("k", T.IntegerType())])
_EVENT_ID = T.StructField("event_id", T.LongType())
_PLACE = [T.StructField("id", T.LongType()), T.StructField(POSITION, T.LongType())]
_WITH_ID = T.StructType([*MESSAGE_SCHEMA.fields, _PLACE[0]])
_REPLAYED = T.StructType([*MESSAGE_SCHEMA.fields, *_PLACE])
_STORED = T.StructType([*STORE_SCHEMA.fields, *_PLACE])


def csv_roundtrip(spark, sf):
    path = shared_dir(spark, "csv")
    write_posts(posts(spark, sf), path)
    return read_posts(spark, path)


def csv_rejects(spark, sf):
    """Some lines have a word for a number, some a field too many; both must come out as rejected."""
    path = shared_dir(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    first = F.when(F.col("n_chars") % 3 == 0, "four").otherwise("4")
    last = F.when(F.col("n_chars") % 3 == 1, "text,more").otherwise("text")
    line = F.concat_ws(",", first, "doc_id", F.lit("date,flag,user"), last)
    docs.select(line.alias("value")).write.text(path)
    posts_, rejects = read_posts_and_rejects(spark, path)
    whole = F.concat_ws(",", "target", "id", "date", "flag", "user", "text")
    return posts_.select(whole.alias("line"), F.lit("post").alias("outcome")).unionByName(
        rejects.withColumn("outcome", F.lit("rejected"))
    )


def publish_json(spark, sf):
    path = shared_dir(spark, "messages")
    publish(to_messages(posts(spark, sf), keep=("id",)), path=path)
    return parse_messages(spark.read.text(path), _WITH_ID)


def json_parse(spark, sf):
    raw = table(spark, sf, "events").withColumn("value", F.col("props").cast("binary"))
    return parse_messages(raw, _K, keep=("event_id",))


#: Messages by the remainder of their number: what is in them, and what must come out.
_BROKEN = (
    ('{"text": "fine", "label": 4}', "fine", 4, None, None),
    ('{"text": "as text", "label": "4"}', "as text", None, None, "not a number"),
    ('{"text": "a half", "label": 4.5}', "a half", None, None, "not a whole number"),
    ('{"text": "large", "label": 3000000000}', "large", None, None, "out of range"),
    ('{"label": 0}', None, 0, "absent", None),
    ('{"text": null, "label": null}', None, None, "absent", None),
    ('{"text": "cut', None, None, "not JSON", None),
    ('[{"text": "a list"}]', None, None, "not an object", None),
    ('{"text": ["a"], "label": true}', None, None, "not a string", "not a number"),
    ('{"label": -4, "text": 17, "more": {}}', "17", -4, None, None),
)


def json_reasons(spark, sf):
    """Events as messages of which most are broken: each field is read, or has its own reason."""
    which = F.element_at(F.array(*[F.lit(b[0]) for b in _BROKEN]), (F.col("event_id") % len(_BROKEN) + 1).cast("int"))
    raw = table(spark, sf, "events").withColumn("value", which.cast("binary"))
    found = checked_messages(raw, keep=("event_id",))
    why = [F.col("reasons")[name].alias(f"{name}_reason") for name in ("text", "label")]
    return found.select("event_id", "text", "label", *why)


def _twice(first, second, rows):
    """Rows with the predictions of two models, ``one`` and ``prediction``."""
    return classify.predict(
        second, classify.predict(first, rows).withColumnRenamed("prediction", "one")
    )


def train_and_score(spark, sf):
    """Held-back posts: is a class predicted where there is a text, and the one that fitting all stages in a row gives?"""
    train, live = train_and_live(spark, sf)
    model = classify.fit(classify.classifier(), train)
    both = _twice(model, classify.classifier().fit(train), live)
    known = F.coalesce(F.col("one").isin(0.0, 1.0), F.lit(False)) == F.col("text").isNotNull()
    same = F.col("one").eqNullSafe(F.col("prediction"))
    return both.select("id", "target", known.alias("known"), same.alias("same"))


def holdout_accuracy(spark, sf):
    """Labelled posts held back, the share of the commoner class, and whether accuracy and error make 100."""
    train, live = train_and_live(spark, sf)
    model = classify.fit(classify.classifier(), train)
    found = classify.evaluate(model, classify.training_view(live))
    adds_up = F.abs(F.col("accuracy") + F.col("error") - 100) < 1e-9
    return found.select("n", "majority", (adds_up & F.col("accuracy").between(0, 100)).alias("adds_up"))


def accuracy_text(spark, sf):
    """Accuracy and error as text with two decimals."""
    shown = [percent(c, 2).alias(f"{c}_text") for c in ("accuracy", "error")]
    return accuracy(scored(spark, sf), ("event_type",)).select("event_type", *shown)


def model_reload_score(spark, sf):
    """Held-back posts, and whether the model predicts the same after saving and loading."""
    train, live = train_and_live(spark, sf)
    path = shared_dir(spark, "model")
    model = classify.fit(classify.classifier(), train)
    classify.save_model(model, path)
    same = F.col("one").eqNullSafe(F.col("prediction"))
    return _twice(model, classify.load_model(path), live).select("id", "target", same.alias("same"))


def _table_stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _files(spark):
    """How many files to replay, and how many of them per micro-batch, so that it takes three."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files, -(-files // 3)


def _in_batches(spark, df):
    """The rows of a table as a stream of several micro-batches."""
    path = shared_dir(spark, "replay")
    files, per_batch = _files(spark)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _replayed(spark, rows):
    """Posts as a stream of messages."""
    path = shared_dir(spark, "messages")
    files, per_batch = _files(spark)
    write_replay(rows, path, files=files, keep=("id",))
    return message_stream(spark, path=path, maxFilesPerTrigger=str(per_batch))


def _store(spark, stream):
    path = shared_dir(spark, "store")
    start_store(stream, path, shared_dir(spark, "progress"), UNTIL_EMPTY).awaitTermination()
    return path


def stream_parse(spark, sf):
    events = _table_stream(spark, sf, "events").withColumn("value", F.col("props").cast("binary"))
    parsed = parse_messages(events, _K, keep=("event_id",))
    path = _store(spark, parsed.withColumn("outcome", F.lit(SCORED)))
    return read_store(spark, path, T.StructType([_EVENT_ID, *_K.fields])).select("event_id", "k")


def stream_replay(spark, sf):
    raw = _replayed(spark, posts(spark, sf))
    parsed = parse_messages(raw, _REPLAYED).withColumn("outcome", F.lit(SCORED))
    stored = read_store(spark, _store(spark, parsed), _REPLAYED)
    return stored.select("id", "text", "label", POSITION)


def _stream_scored(spark, sf):
    """The stored records, the model, and the posts that were replayed."""
    train, live = train_and_live(spark, sf)
    model = classify.fit(classify.classifier(), train)
    raw = _replayed(spark, live)
    path = _store(spark, scored_stream(raw, model, _REPLAYED))
    return read_store(spark, path, _STORED), model, live


def stream_score(spark, sf):
    """Stored records: is the name that of the prediction, and the prediction that of the batch?"""
    stored, model, live = _stream_scored(spark, sf)
    batch = classify.predict(model, live).select("id", F.col("prediction").alias("batch"))
    name = F.when(F.col("prediction") == 1, "POSITIVE").when(F.col("prediction") == 0, "NEGATIVE")
    return stored.join(batch, "id").select(
        "id",
        "text",
        "label",
        (F.col("sentiment") == name).alias("agrees"),
        (F.col("prediction") == F.col("batch")).alias("same"),
    )


def stream_unlabeled(spark, sf):
    """Messages without a label: all are scored, and the label stays missing."""
    train, live = train_and_live(spark, sf)
    model = classify.fit(classify.classifier(), train)
    texts = T.StructType([MESSAGE_SCHEMA["text"], *_PLACE])
    stored = read_store(spark, _store(spark, scored_stream(_replayed(spark, live), model, texts)), _STORED)
    named = F.col("sentiment").isin("NEGATIVE", "POSITIVE").alias("named")
    return stored.select("id", "label", named)


def live_figures(spark, sf):
    """The whole flow: train, replay, score as a stream, store, report on the stored records.

    Every held-back post is replayed and stored. The figures are those of the labelled ones; ``stored_rows`` counts all.
    """
    stored, _, _ = _stream_scored(spark, sf)
    labelled = stored.filter("label IS NOT NULL")
    every = stored.agg(F.count(F.lit(1)).alias("stored_rows"))
    # One row each.
    figures = kpi_snapshot(labelled, latest_n(labelled, POSITION), POSITION).withColumn("one", F.lit(1))
    return figures.join(every.withColumn("one", F.lit(1)), "one").drop("one")


def live_report(spark, sf):
    """Numbers of the whole flow, and whether its figures fit them."""
    newest = F.least(F.col("total_rows"), F.lit(MONITORED_ROWS))
    adds_up = (F.col("positive") + F.col("negative") == newest) & F.col("accuracy").between(0, 100)
    return live_figures(spark, sf).select(
        "stored_rows", F.col("total_rows").alias("labelled_rows"), adds_up.alias("adds_up")
    )


def stream_rejects(spark, sf):
    """Errors are cut off in the middle of the message; all of them must come out as rejected."""
    events = _table_stream(spark, sf, "events")
    broken = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(
        F.concat(F.lit('{"text": "'), "event_type", F.lit('", "label": 4}'))
    )
    parsed = parse_messages(events.withColumn("value", broken), keep=("event_id", "value"))
    outcome = F.when(F.col("text").isNull(), REJECTED).otherwise(SCORED)
    path = _store(spark, parsed.withColumn("outcome", outcome))
    schema = T.StructType([_EVENT_ID, T.StructField("value", T.StringType())])
    return read_store(spark, path, schema, REJECTED).select("event_id", "value")


def metrics_over_store(spark, sf):
    rows = scored(spark, sf)
    path = _store(spark, _in_batches(spark, rows).withColumn("outcome", F.lit(SCORED)))
    return overview(read_store(spark, path, rows.schema))


def stream_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    stream = _in_batches(spark, scored(spark, sf))
    start_metrics(
        stream, path, shared_dir(spark, "progress"), ("event_type",), UNTIL_EMPTY
    ).awaitTermination()
    schema = overview(scored(spark, sf), ("event_type",)).schema
    return read_latest(spark, path, schema, ("event_type",))


def stream_rolling(spark, sf):
    path, by = shared_dir(spark, "rolling"), ("event_type",)
    stream = _in_batches(spark, scored(spark, sf))
    start_rolling(
        stream, "event_id", path, shared_dir(spark, "progress"), by, UNTIL_EMPTY
    ).awaitTermination()
    return rolling_accuracy(spark, path, stream.schema, "event_id", by)


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "csv_rejects": csv_rejects,
    "publish_json": publish_json,
    "json_parse": json_parse,
    "json_reasons": json_reasons,
    "train_and_score": train_and_score,
    "holdout_accuracy": holdout_accuracy,
    "accuracy_text": accuracy_text,
    "model_reload_score": model_reload_score,
    "stream_parse": stream_parse,
    "stream_replay": stream_replay,
    "stream_score": stream_score,
    "stream_unlabeled": stream_unlabeled,
    "live_report": live_report,
    "stream_rejects": stream_rejects,
    "metrics_over_store": metrics_over_store,
    "stream_metrics": stream_metrics,
    "stream_rolling": stream_rolling,
}

_MESSAGES = f"WITH {POSTS_SQL} SELECT id, text, target AS label FROM posts"
_PARSED = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"
_OVERVIEW = """count(*) AS total_rows,
  count(*) FILTER (prediction = 1) AS positive, count(*) FILTER (prediction = 0) AS negative,
  count(*) FILTER (prediction = 0 AND real_val = 0) AS tn,
  count(*) FILTER (prediction = 1 AND real_val = 0) AS fp,
  count(*) FILTER (prediction = 0 AND real_val = 1) AS fn,
  count(*) FILTER (prediction = 1 AND real_val = 1) AS tp,
  sum(is_correct)::DOUBLE / count(*) * 100 AS accuracy"""

def _sql(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_BROKEN_SQL = ", ".join(f"({k}, {', '.join(map(_sql, b[1:]))})" for k, b in enumerate(_BROKEN))

ORACLES = {
    "csv_roundtrip": f'WITH {POSTS_SQL} SELECT target, id, date, flag, "user", text FROM posts',
    "publish_json": _MESSAGES,
    "json_parse": _PARSED,
    "json_reasons": f"""WITH kinds(k, text, label, text_reason, label_reason) AS (VALUES {_BROKEN_SQL})
SELECT event_id, kinds.text, CAST(kinds.label AS INTEGER) AS label, text_reason, label_reason
FROM events JOIN kinds ON event_id % {len(_BROKEN)} = k""",
    "stream_parse": _PARSED,
    "stream_replay": f"""WITH {POSTS_SQL}
SELECT id, text, target AS label,
       CAST(row_number() OVER (ORDER BY md5('42:' || id)) - 1 AS BIGINT) AS position FROM posts""",
    "csv_rejects": """
SELECT CASE n_chars % 3 WHEN 0 THEN 'four,' ELSE '4,' END || doc_id || ',date,flag,user,' ||
       CASE n_chars % 3 WHEN 1 THEN 'text,more' ELSE 'text' END AS line,
       CASE n_chars % 3 WHEN 2 THEN 'post' ELSE 'rejected' END AS outcome
FROM documents""",
    "train_and_score": f"WITH {LIVE_SQL} SELECT id, target, true AS known, true AS same FROM live",
    "holdout_accuracy": f"""WITH {LIVE_SQL},
n AS (SELECT count(*) AS c FROM live WHERE target IS NOT NULL AND text IS NOT NULL GROUP BY target)
SELECT CAST(sum(c) AS BIGINT) AS n, max(c)::DOUBLE / sum(c)::DOUBLE * 100 AS majority, true AS adds_up FROM n""",
    "accuracy_text": f"""WITH {JUDGED_SQL},
a AS (SELECT event_type, sum(is_correct)::DOUBLE / count(*) AS share FROM judged GROUP BY event_type)
SELECT event_type, '%' || printf('%.2f', share * 100) AS accuracy_text,
       '%' || printf('%.2f', (1 - share) * 100) AS error_text FROM a""",
    "model_reload_score": f"WITH {LIVE_SQL} SELECT id, target, true AS same FROM live",
    "stream_score": f"""WITH {LIVE_SQL}
SELECT id, text, target AS label, true AS agrees, true AS same FROM live WHERE text IS NOT NULL""",
    "stream_unlabeled": f"""WITH {LIVE_SQL}
SELECT id, CAST(NULL AS INTEGER) AS label, true AS named FROM live WHERE text IS NOT NULL""",
    "live_report": f"""WITH {LIVE_SQL}
SELECT count(*) AS stored_rows, count(target) AS labelled_rows, true AS adds_up
FROM live WHERE text IS NOT NULL""",
    "stream_rejects": """
SELECT event_id, substr(props, 1, 4) AS value FROM events WHERE event_type = 'error'""",
    "metrics_over_store": f"WITH {JUDGED_SQL} SELECT {_OVERVIEW} FROM judged",
    "stream_metrics": f"""WITH {JUDGED_SQL}
SELECT event_type, {_OVERVIEW} FROM judged GROUP BY event_type""",
    "stream_rolling": f"""WITH {JUDGED_SQL},
newest AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM judged)
SELECT event_type, max(event_id) AS last, count(*) AS rows,
       sum(is_correct)::DOUBLE / count(*) * 100 AS rolling_accuracy,
       1 - sum(is_correct)::DOUBLE / count(*) AS rolling_error
FROM newest WHERE r <= 50 GROUP BY event_type""",
}
