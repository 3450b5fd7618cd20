from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valence.operators import classify, metrics
from valence.operators.split import seeded_shuffle
from valence.sources.messages import MESSAGE_SCHEMA, message_stream, parse_messages
from valence.sources.store import REJECTED, STORE_SCHEMA, read_latest, read_store
from valence.streaming.monitoring import last_rows, rolling_accuracy, start_metrics, start_rolling
from valence.streaming.replay import write_replay
from valence.streaming.scoring import UNTIL_EMPTY, scored_stream, start_sink, start_store

WITH_ID = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField("id", T.LongType())])
STORED = T.StructType([*STORE_SCHEMA.fields, T.StructField("id", T.LongType())])


@pytest.fixture(scope="module")
def model(spark):
    rows = [(0, "bad awful"), (4, "good great"), (0, "awful sad"), (4, "love great"), (4, "love it")]
    return classify.fit(
        classify.classifier(), spark.createDataFrame(rows, "raw_label int, text string")
    )


def _posts(spark, n):
    words = F.array(*map(F.lit, ["awful", "love it", "bad", "great"]))
    return spark.range(n).select(
        "id",
        ((F.col("id") % 2) * 4).cast("int").alias("target"),
        F.element_at(words, (F.col("id") % 4 + 1).cast("int")).alias("text"),
    )


def test_replay_scores_every_message_once(spark, tmp_path, model):
    posts, path = _posts(spark, 200), str(tmp_path / "in")
    write_replay(posts, path, keep=("id",), files=5)
    raw = message_stream(spark, path=path, maxFilesPerTrigger="2")
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    start_store(scored_stream(raw, model, WITH_ID), store, progress, UNTIL_EMPTY).awaitTermination()

    stored = read_store(spark, store, STORED)
    assert stored.select("batch_id").distinct().count() == 3
    batch = classify.score(model, posts.withColumnRenamed("target", "label"))
    columns = ["id", "text", "label", "sentiment", "prediction"]
    assert sorted(stored.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert read_store(spark, store, STORED, REJECTED).count() == 0

    # A restart goes on after the last batch; new messages make a new one.
    write_replay(posts.filter("id < 10"), path, keep=("id",), files=1)
    start_store(scored_stream(raw, model, WITH_ID), store, progress, UNTIL_EMPTY).awaitTermination()
    assert read_store(spark, store, STORED).count() == 210
    assert read_store(spark, store, STORED).filter("batch_id = 3").count() == 10


def test_replay_order_is_the_shuffled_one(spark, tmp_path):
    import glob
    import json

    path = str(tmp_path / "in")
    write_replay(_posts(spark, 100).repartition(3), path, keep=("id",), files=4)
    files = sorted(glob.glob(path + "/part-*"))
    got = [json.loads(line)["id"] for f in files for line in open(f)]
    assert len(files) == 4
    assert got == [r.id for r in seeded_shuffle(_posts(spark, 100), "id").collect()]


def test_the_stream_comes_in_the_order_of_the_replay(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "s")
    write_replay(_posts(spark, 200).repartition(5), path, keep=("id",), files=8)
    schema = T.StructType([*WITH_ID.fields, T.StructField("position", T.LongType())])
    raw = message_stream(spark, path=path, maxFilesPerTrigger="1")
    rows = parse_messages(raw, schema).withColumn("outcome", F.lit("scored"))
    start_store(rows, store, str(tmp_path / "p"), UNTIL_EMPTY).awaitTermination()
    stored = read_store(spark, store, schema)
    assert stored.select("batch_id").distinct().count() == 8
    places = [r.position for r in stored.orderBy("batch_id", "position").collect()]
    assert places == list(range(200))
    ids = [r.id for r in stored.orderBy("position").collect()]
    assert ids == [r.id for r in seeded_shuffle(_posts(spark, 200), "id").collect()]


def test_unreadable_messages_are_rejected_not_lost(spark, tmp_path, model):
    lines = ['{"text": "love it", "label": 4}', "garbage", '{"label": 0}', '{"text": "b', "[]"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.txt").write_text("\n".join(lines) + "\n")
    raw = message_stream(spark, path=str(folder))
    store = str(tmp_path / "store")
    query = start_store(scored_stream(raw, model), store, str(tmp_path / "p"), UNTIL_EMPTY, echo=True)
    query.awaitTermination()
    assert [r.text for r in read_store(spark, store).collect()] == ["love it"]
    kept = T.StructType([*STORE_SCHEMA.fields, T.StructField("raw", T.StringType())])
    rejected = read_store(spark, store, kept, REJECTED).collect()
    assert sorted(r.raw for r in rejected) == sorted(lines[1:])


def test_other_sinks(spark, tmp_path, model, stream):
    lines = [('{"text": "love it", "label": 4}',)] * 4 + [("broken",)]
    raw = stream(spark.createDataFrame(lines, "value string"), 2)
    out = str(tmp_path / "out")
    query = start_sink(
        scored_stream(raw, model), "json", {"path": out}, str(tmp_path / "p"), str(tmp_path / "r"), UNTIL_EMPTY
    )
    query.awaitTermination()
    rows = spark.read.json(out)
    schema = T.StructType([*STORE_SCHEMA.fields, T.StructField("raw", T.StringType())])
    assert [r.raw for r in read_store(spark, str(tmp_path / "r"), schema, REJECTED).collect()] == ["broken"]
    assert rows.count() == 4
    assert sorted(rows.columns) == ["batch_id", "batch_row", "label", "prediction", "sentiment", "text"]


def _scored(spark, n):
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 3 == 0, 4).alias("label"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("prediction"),
    )


def test_metrics_of_a_stream_are_those_of_the_table(spark, tmp_path, stream):
    scored = _scored(spark, 500)
    for by in ((), ("g",)):
        path, progress = str(tmp_path / f"m{len(by)}"), str(tmp_path / f"p{len(by)}")
        start_metrics(stream(scored, 4), path, progress, by, UNTIL_EMPTY).awaitTermination()
        expected = metrics.overview(scored, by)
        got = read_latest(spark, path, expected.schema, by)
        assert sorted(got.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("by", [(), ("g",)])
def test_rolling_accuracy_of_a_stream(spark, tmp_path, stream, by):
    # The batches come in no particular order, so rows of each group arrive late.
    scored = _scored(spark, 900)
    path, progress = str(tmp_path / "r"), str(tmp_path / "p")
    start_rolling(stream(scored, 6), "id", path, progress, by, UNTIL_EMPTY).awaitTermination()
    got = {r[by[0]] if by else None: r for r in rolling_accuracy(spark, path, scored.schema, "id", by).collect()}

    rows = sorted(scored.collect(), key=lambda r: r.id)
    groups = {r.g if by else None for r in rows}
    assert set(got) == groups
    for g in groups:
        last = [r for r in rows if not by or r.g == g][-50:]
        hits = [(4 if r.label == 4 else 0) / 4 == r.prediction for r in last]
        assert got[g].rows == len(last) and got[g]["last"] == last[-1].id
        assert round(got[g].rolling_accuracy, 9) == round(100 * sum(hits) / len(hits), 9)


def test_tasks_cut_hot_groups_down_before_the_shuffle(spark, plan, tmp_path):
    path = str(tmp_path / "t")
    _scored(spark, 100).write.parquet(path)
    text = plan(last_rows(spark.read.parquet(path), "id", ("g",)))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.fixture
def fail_once(monkeypatch):
    """Let a module's writer fail after it has written the second batch, the first time."""

    def install(module, name):
        write, failed = getattr(module, name), []

        def failing(df, batch_id, path):
            write(df, batch_id, path)
            if batch_id == 1 and not failed:
                failed.append(batch_id)
                raise RuntimeError("lost after writing")

        monkeypatch.setattr(module, name, failing)

    return install


def test_store_after_a_failure(spark, tmp_path, stream, fail_once):
    from valence.streaming import scoring

    fail_once(scoring, "write_batch")
    rows = spark.range(30).withColumn("outcome", F.lit("scored"))
    moving, store, progress = stream(rows), str(tmp_path / "s"), str(tmp_path / "p")
    with pytest.raises(Exception, match="lost after writing"):
        start_store(moving, store, progress, UNTIL_EMPTY).awaitTermination()
    start_store(moving, store, progress, UNTIL_EMPTY).awaitTermination()
    stored = read_store(spark, store, T.StructType([T.StructField("id", T.LongType())]))
    assert sorted(r.id for r in stored.collect()) == list(range(30))
    assert stored.select("batch_id").distinct().count() == 3


def test_rolling_after_a_failure(spark, tmp_path, stream, fail_once):
    from valence.streaming import monitoring

    fail_once(monitoring, "write_delta")
    scored = _scored(spark, 120)
    moving, path, progress = stream(scored), str(tmp_path / "r"), str(tmp_path / "p")
    with pytest.raises(Exception, match="lost after writing"):
        start_rolling(moving, "id", path, progress, trigger=UNTIL_EMPTY).awaitTermination()
    start_rolling(moving, "id", path, progress, trigger=UNTIL_EMPTY).awaitTermination()
    got = rolling_accuracy(spark, path, scored.schema, "id").first()
    last = last_rows(metrics.with_correctness(scored), "id").agg(F.avg("is_correct") * 100).first()
    assert (got["last"], got.rows, got.rolling_accuracy) == (119, 50, last[0])


def test_a_batch_writes_only_the_groups_it_has(spark, tmp_path):
    from valence.streaming.monitoring import ROLLING_ROWS

    rows = _scored(spark, 400).filter("g <> 'hot'").orderBy("id").collect()
    source = str(tmp_path / "in")
    for k, part in enumerate(([r for r in rows if r.g != "g3"], [r for r in rows if r.g == "g3"][:5])):
        spark.createDataFrame(part, _scored(spark, 1).schema).coalesce(1).write.parquet(f"{source}/{k}")
        moving = spark.readStream.schema(_scored(spark, 1).schema).option("recursiveFileLookup", "true").parquet(source)
        for name, start in (("m", lambda p, c: start_metrics(moving, p, c, ("g",), UNTIL_EMPTY)), ("r", lambda p, c: start_rolling(moving, "id", p, c, ("g",), UNTIL_EMPTY))):
            start(str(tmp_path / name), str(tmp_path / f"c{name}")).awaitTermination()
    for name in ("m", "r"):
        assert [r.g for r in spark.read.parquet(str(tmp_path / name / "batch_id=1")).collect()] == ["g3"]
    got = {r.g: r.rows for r in rolling_accuracy(spark, str(tmp_path / "r"), _scored(spark, 1).schema, "id", ("g",)).collect()}
    many = Counter(r.g for r in rows if r.g != "g3")
    assert got == {g: min(n, ROLLING_ROWS) for g, n in many.items()} | {"g3": 5}


def test_tasks_cut_groups_down_before_they_are_sent():
    import pyarrow as pa

    from valence.streaming.monitoring import _newest_of_task

    rows = [(f"g{k % 3}", k, k % 2) for k in range(1000)]
    parts = [pa.RecordBatch.from_pylist([{"_group": g, "_place": k, "is_correct": c} for g, k, c in rows[i : i + 90]]) for i in range(0, 1000, 90)]
    out = [r for b in _newest_of_task(iter(parts)) for r in b.to_pylist()]
    assert len(out) == 150
    for g in range(3):
        assert sorted(r["_place"] for r in out if r["_group"] == f"g{g}") == [k for k in range(1000) if k % 3 == g][-50:]


@pytest.mark.parametrize("where", ["before", "within", "after", "never"])
def test_a_foreign_sink_has_each_record_once(spark, tmp_path, stream, monkeypatch, where):
    """The second batch is interrupted before it is appended, when half of it is, or when all is; then it is run again."""
    from pyspark.sql.readwriter import DataFrameWriter

    from valence.streaming import ledger

    out, rejects, progress = (str(tmp_path / n) for n in ("out", "rejects", "p"))
    rows = spark.range(40).select("id", F.when(F.col("id") % 8 == 0, "rejected").otherwise("scored").alias("outcome"))
    moving, save, failed = stream(rows), DataFrameWriter.save, []

    def failing(self, *a, **b):
        staged = self._df
        if "batch_row" in staged.columns and staged.filter("batch_id = 1").count() and not failed and where != "never":
            failed.append(1)
            if where == "within":
                staged.orderBy("id").limit(4).write.format("json").mode("append").options(path=out).save()
            if where == "after":
                save(self, *a, **b)
            raise RuntimeError("lost")
        return save(self, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "save", failing)
    start = lambda: start_sink(moving, "json", {"path": out}, progress, rejects, UNTIL_EMPTY).awaitTermination()
    if where != "never":
        with pytest.raises(Exception, match="lost"):
            start()
    start()
    got = spark.read.json(out)
    assert sorted(r.id for r in got.collect()) == [k for k in range(40) if k % 8]
    assert got.select("batch_id", "batch_row").distinct().count() == 35
    book = ledger.Ledger(spark, f"{rejects}/_ledger")
    assert book.done(2) and not book.done(3) and not book.is_staged(1)
    # A batch that is in the ledger is not written again, whatever it holds.
    ledger.append_once(rows.drop("outcome"), 2, f"{rejects}/_ledger", "json", {"path": out})
    assert spark.read.json(out).count() == 35
    assert sorted(r.id for r in read_store(spark, rejects, rows.schema, REJECTED).select("id").collect()) == list(range(0, 40, 8))


def test_a_model_is_replaced_while_a_stream_runs(spark, tmp_path, model):
    from valence.streaming.scoring import start_versioned_store

    models, source, store, progress = (str(tmp_path / n) for n in ("models", "in", "s", "p"))
    rows = [(4, "bad awful"), (0, "good great"), (4, "awful sad"), (0, "love great"), (0, "love it")]
    turned = classify.fit(classify.classifier(), spark.createDataFrame(rows, "raw_label int, text string"))
    with pytest.raises(ValueError, match="no complete version"):
        classify.current_version(spark, models)
    seen = []
    for k, fitted in enumerate((model, None, turned)):
        if fitted:
            seen.append((classify.save_version(fitted, models), classify.load_version(models, 1)))
        (tmp_path / "models" / f"version-{9 - k}").mkdir()  # one that was cut off: no mark
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text('{"text": "love great", "label": 4}\n{"label": 4}\n')
        raw = message_stream(spark, path=source)
        start_versioned_store(raw, models, store, progress, trigger=UNTIL_EMPTY).awaitTermination()
    first, second = seen[0][0], seen[1][0]
    assert first < second == classify.current_version(spark, models)
    schema = T.StructType([*STORE_SCHEMA.fields, T.StructField("model_version", T.IntegerType())])
    got = [(r.batch_id, r.model_version, r.sentiment) for r in read_store(spark, store, schema).orderBy("batch_id").collect()]
    assert got == [(0, first, "POSITIVE"), (1, first, "POSITIVE"), (2, second, "NEGATIVE")]
    assert [r.model_version for r in read_store(spark, store, schema, REJECTED).orderBy("batch_id").collect()] == [first, first, second]
    # Who read the first version before it was replaced still can.
    assert classify.score(seen[0][1], spark.createDataFrame([("love great",)], "text string")).first().sentiment == "POSITIVE"


def test_batch_without_rows(spark, tmp_path, model):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "m.txt").write_text("")
    raw = message_stream(spark, path=str(folder))
    store = str(tmp_path / "s")
    scored = scored_stream(raw, model)
    start_store(scored, store, str(tmp_path / "p"), UNTIL_EMPTY, echo=True).awaitTermination()
    assert read_store(spark, store).count() == 0
