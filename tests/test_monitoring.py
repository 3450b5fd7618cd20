import math
import random

import pandas as pd
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from valence.operators import metrics
from valence.operators.curves import (
    CURVES,
    accuracy_curves,
    curve_bounds,
    history_curves,
    with_correctness,
)
from valence.operators.latest import latest_n

SCHEMA = "id long, g string, label int, prediction double"


def _rows(n, seed=1, groups=("a", "b", None)):
    r = random.Random(seed)
    return [
        (i, r.choice(groups), r.choice([0, 4, None]), r.choice([0.0, 1.0, 1.0, None]))
        for i in range(n)
    ]


def _scored(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _expected_curves(rows):
    """The curves of rows in order, by pandas."""
    ok = pd.Series([int((4 if label == 4 else 0) / 4 == p) for _, _, label, p in rows], dtype=float)
    running, rolling = ok.expanding().mean(), ok.rolling(window=50, min_periods=1).mean()
    return list(zip(running * 100, 1 - running, rolling * 100, 1 - rolling))


def _assert_curves(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip([g[c] for c in CURVES], e))


@pytest.mark.parametrize("n", [1, 49, 50, 51, 300])
def test_curves(spark, n):
    rows = _rows(n)
    got = accuracy_curves(_scored(spark, rows), "id").orderBy("id").collect()
    assert [r.step for r in got] == list(range(1, n + 1))
    _assert_curves(got, _expected_curves(rows))


def test_curves_per_group(spark):
    rows = _rows(300)
    got = accuracy_curves(_scored(spark, rows), "id", by=("g",)).orderBy("id").collect()
    for g in ("a", "b", None):
        _assert_curves([r for r in got if r.g == g], _expected_curves([r for r in rows if r[1] == g]))


def test_curves_without_label(spark):
    got = accuracy_curves(_scored(spark, _rows(5)).drop("label"), "id").collect()
    assert all(r[c] == 0 for r in got for c in CURVES) and len(got) == 5


@pytest.mark.parametrize("n, tasks", [(0, 3), (1, 3), (49, 9), (49, 49), (120, 60), (1000, 1), (1000, 13), (1000, 40)])
def test_history_in_tasks_is_the_plain_window(spark, n, tasks):
    rows = _rows(n)
    got = history_curves(_scored(spark, rows).repartition(5), "id", tasks=tasks)
    got = got.orderBy("id").collect()
    assert [r.step for r in got] == list(range(1, n + 1))
    _assert_curves(got, _expected_curves(rows))


def test_history_with_a_hot_group(spark):
    # Group a holds most rows and spans many tasks; the small groups share tasks.
    rows = _rows(900, groups=["a"] * 8 + ["b", "c", "d", None])
    for tasks in (2, 18, 150):
        got = history_curves(_scored(spark, rows), "id", by=("g",), tasks=tasks).orderBy("id").collect()
        assert len(got) == 900
        for g in ("a", "b", "c", "d", None):
            mine = [r for r in got if r.g == g]
            assert [r.step for r in mine] == list(range(1, len(mine) + 1))
            _assert_curves(mine, _expected_curves([r for r in rows if r[1] == g]))


def test_history_sums_go_on_from_batch_to_batch(spark):
    # Batches of 7 rows in tasks of hundreds: frames reach back over many of them.
    rows = _rows(1000, groups=("a", "b"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = history_curves(_scored(spark, rows), "id", by=("g",), tasks=3).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for g in ("a", "b"):
        _assert_curves([r for r in got if r.g == g], _expected_curves([r for r in rows if r[1] == g]))


def test_history_moves_rows_once(spark, plan):
    shown = plan(history_curves(_scored(spark, _rows(10)), "id"))
    # The one shuffle of rows is behind the table that this starts from; what is left is a small broadcast.
    assert "Window" not in shown and "hashpartitioning" not in shown and "rangepartitioning" not in shown
    assert "BroadcastExchange" in shown


@pytest.mark.parametrize("direct", [2000, 10])
@pytest.mark.parametrize("n", [1, 10, 50, 5000])
def test_latest(spark, n, direct):
    ids = random.Random(3).sample(range(-(10**12), 10**12), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(6)
    got = [r.id for r in latest_n(df, "id", n=n, direct_rows=direct).collect()]
    assert got == sorted(ids, reverse=True)[:n]


@pytest.mark.parametrize("direct", [5000, 20])
def test_latest_with_a_hot_batch(spark, direct):
    # One batch holds a third of the rows: the second key has to cut it down.
    keys = [(b, i) for b in range(5) for i in range(100)] + [(3, 1000 + i) for i in range(400)]
    df = spark.createDataFrame(keys, "batch_id long, id long").repartition(4)
    got = [tuple(r) for r in latest_n(df, "batch_id", "id", n=120, direct_rows=direct).collect()]
    assert got == sorted(keys, reverse=True)[:120]


def test_latest_with_one_value_and_edges(spark):
    df = spark.createDataFrame([(7, i) for i in range(40)], "a int, b long")
    assert [r.b for r in latest_n(df, "a", "b", n=3, direct_rows=3).collect()] == [39, 38, 37]
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,), (5,)], "id long")
    got = [r.id for r in latest_n(wide, "id", n=2, direct_rows=2).collect()]
    assert got == [2**63 - 1, 5]
    names = spark.createDataFrame([("b",), ("c",), ("a",)], "id string")
    assert [r.id for r in latest_n(names, "id", n=2, direct_rows=1).collect()] == ["c", "b"]
    assert latest_n(df.limit(0), "a", n=2, direct_rows=0).count() == 0


def test_the_floor_reaches_the_scan(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.range(100_000).write.parquet(path)
    newest = latest_n(spark.read.parquet(path), "id", n=100, direct_rows=1000)
    assert "GreaterThanOrEqual(id," in plan(newest) and newest.count() == 100


def test_metrics_of_the_given_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = labels.select(
        (F.col("quality") * 4).alias("label"),
        F.when(F.col("toxic") == 0, 1.0).otherwise(0.0).alias("prediction"),
    )
    assert tuple(metrics.confusion_matrix(scored).first()) == (9, 49, 42, 299)
    figures = metrics.accuracy(scored).first()
    assert figures.n == 399 and round(figures.accuracy, 6) == 77.192982
    assert math.isclose(figures.error, 100 - figures.accuracy)
    evaluator = MulticlassClassificationEvaluator(
        labelCol="real_val", predictionCol="prediction", metricName="accuracy"
    )
    assert math.isclose(evaluator.evaluate(with_correctness(scored)) * 100, figures.accuracy)


def test_metrics_by_hand(spark):
    rows = [
        (1, "a", 4, 1.0),
        (2, "a", 4, 0.0),
        (3, "a", 0, 0.0),
        (4, "b", None, 0.0),
        (5, "b", None, 1.0),
        (6, "b", 4, None),
    ]
    df = _scored(spark, rows)
    assert tuple(metrics.class_counts(df).first()) == (2, 3)
    assert tuple(metrics.confusion_matrix(df).first()) == (2, 1, 1, 1)
    assert round(metrics.accuracy(df).first().accuracy, 6) == 50.0
    assert metrics.accuracy(df, labeled_only=True).first().n == 4
    cells = {(r.real_val, r.prediction): r.n for r in metrics.confusion_cells(df).collect()}
    assert cells == {(1.0, 1.0): 1, (1.0, 0.0): 1, (0.0, 0.0): 2, (0.0, 1.0): 1, (1.0, None): 1}
    groups = {r.g: (r.n, round(r.accuracy, 3)) for r in metrics.accuracy(df, ("g",)).collect()}
    assert groups == {"a": (3, 66.667), "b": (3, 33.333)}
    shares = {r.sentiment: (r.n, r.share) for r in metrics.prediction_share(df).collect()}
    assert shares == {"POSITIVE": (2, 0.4), "NEGATIVE": (3, 0.6)}
    overview = metrics.overview(df).first().asDict()
    assert overview.pop("accuracy") == 50.0
    assert list(overview.values()) == [6, 2, 3, 2, 1, 1, 1]
    unlabeled = metrics.overview(df.drop("label"))
    assert tuple(unlabeled.first()) == (6, 2, 3, 0, 0, 0, 0, 0.0)
    assert unlabeled.dtypes == metrics.overview(df).dtypes


def test_headline(spark):
    store = _scored(spark, _rows(80))
    latest = latest_n(store, "id", n=60)
    got = metrics.kpi_snapshot(store, latest, "id").first()
    expected = _expected_curves(_rows(80)[20:])
    assert got.total_rows == 80 and math.isclose(got.accuracy, expected[-1][0])
    assert got.accuracy_text == f"%{got.accuracy:.1f}"
    predictions = [r[3] for r in _rows(80)[20:]]
    assert (got.positive, got.negative) == (predictions.count(1.0), predictions.count(0.0))
    unlabeled = metrics.kpi_snapshot(store, latest.drop("label"), "id").first()
    assert unlabeled.accuracy == 0


def test_empty_store(spark):
    empty = _scored(spark, [])
    assert tuple(metrics.confusion_matrix(empty).first()) == (0, 0, 0, 0)
    assert tuple(metrics.class_counts(empty).first()) == (0, 0)
    assert tuple(metrics.accuracy(empty).first()) == (0, None, None)
    got = metrics.kpi_snapshot(empty, latest_n(empty, "id"), "id").first()
    assert (got.total_rows, got.accuracy, got.positive, got.negative) == (0, None, 0, 0)
    assert [r.share for r in metrics.prediction_share(empty).collect()] == [None, None]


def test_axis_ranges(spark):
    rows = [(i, "a", 4, 1.0 if i % 10 else 0.0) for i in range(200)]
    curves = accuracy_curves(_scored(spark, rows), "id")
    p = curves.toPandas()
    both = [*p.running_accuracy, *p.rolling_accuracy]
    errors = [*p.running_error, *p.rolling_error]
    got = curve_bounds(curves).first()
    assert got.accuracy_low == max(0, min(both) - 5)
    assert got.accuracy_high == min(100, max(both) + 5)
    assert got.error_high == max(errors) + 0.1


def test_groups_are_summed_up_before_the_shuffle(spark, plan):
    text = plan(metrics.confusion_matrix(_scored(spark, _rows(5)), by=("g",)))
    assert text.index("Exchange") < text.index("partial_count")
