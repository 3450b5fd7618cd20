"""Queries over scored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from valence.functions.labels import sentiment
from valence.operators import curves, metrics
from valence.operators.curves import CURVES
from valence.operators.latest import latest_n
from valence.plans.inputs import (
    JUDGED_SQL,
    LATEST_SQL,
    SCORED_SQL,
    as_scored,
    curves_sql,
    scored,
    table,
)

_CURVES = ", ".join(CURVES)
_CELLS = """
  count(*) FILTER (prediction = 0 AND real_val = 0) AS tn,
  count(*) FILTER (prediction = 1 AND real_val = 0) AS fp,
  count(*) FILTER (prediction = 0 AND real_val = 1) AS fn,
  count(*) FILTER (prediction = 1 AND real_val = 1) AS tp"""
_ACCURACY = """count(*) AS n, sum(is_correct)::DOUBLE / count(*) * 100 AS accuracy,
  (1 - sum(is_correct)::DOUBLE / count(*)) * 100 AS error"""




def _latest(spark, sf):
    return as_scored(latest_n(table(spark, sf, "events"), "event_id"))


def label_normalize(spark, sf):
    rows = curves.with_correctness(scored(spark, sf))
    return rows.select("event_id", "label", "prediction", "real_val", "is_correct")


def sentiment_name(spark, sf):
    return scored(spark, sf).select("event_id", sentiment("prediction").alias("sentiment"))


def class_counts(spark, sf):
    return metrics.class_counts(scored(spark, sf))


def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf))


def confusion_cells(spark, sf):
    return metrics.confusion_cells(scored(spark, sf))


def confusion_by_group(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf), by=("event_type",))


def accuracy(spark, sf):
    return metrics.accuracy(scored(spark, sf))


def accuracy_labeled_only(spark, sf):
    return metrics.accuracy(scored(spark, sf), labeled_only=True)


def accuracy_by_group(spark, sf):
    return metrics.accuracy(scored(spark, sf), ("event_type",))


def prediction_share(spark, sf):
    return metrics.prediction_share(scored(spark, sf))


def latest(spark, sf):
    return _latest(spark, sf).select("event_id", "event_type", "label", "prediction")


def latest_confusion(spark, sf):
    return metrics.overview(_latest(spark, sf)).select(
        "positive", "negative", "tn", "fp", "fn", "tp"
    )


def accuracy_curves(spark, sf):
    rows = curves.accuracy_curves(_latest(spark, sf), "event_id")
    return rows.select("event_id", F.col("step").cast("long"), "real_val", "is_correct", *CURVES)


def curves_by_group(spark, sf):
    rows = curves.accuracy_curves(_latest(spark, sf), "event_id", by=("event_type",))
    return rows.select("event_type", "event_id", F.col("step").cast("long"), *CURVES)


def curves_unlabeled(spark, sf):
    rows = curves.accuracy_curves(_latest(spark, sf).drop("label"), "event_id")
    return rows.select("event_id", F.col("step").cast("long"), "prediction", *CURVES)


def history_curves(spark, sf):
    return curves.history_curves(scored(spark, sf), "event_id")


def history_curves_by_group(spark, sf):
    return curves.history_curves(scored(spark, sf), "event_id", by=("event_type",))


def curve_bounds(spark, sf):
    return curves.curve_bounds(curves.accuracy_curves(_latest(spark, sf), "event_id"))


def kpi_snapshot(spark, sf):
    store = table(spark, sf, "events")
    return metrics.kpi_snapshot(store, _latest(spark, sf), "event_id")


QUERIES = {
    "label_normalize": label_normalize,
    "sentiment_name": sentiment_name,
    "class_counts": class_counts,
    "confusion_matrix": confusion_matrix,
    "confusion_cells": confusion_cells,
    "confusion_by_group": confusion_by_group,
    "accuracy": accuracy,
    "accuracy_labeled_only": accuracy_labeled_only,
    "accuracy_by_group": accuracy_by_group,
    "prediction_share": prediction_share,
    "latest_n": latest,
    "latest_confusion": latest_confusion,
    "accuracy_curves": accuracy_curves,
    "curves_by_group": curves_by_group,
    "curves_unlabeled": curves_unlabeled,
    "history_curves": history_curves,
    "history_curves_by_group": history_curves_by_group,
    "curve_bounds": curve_bounds,
    "kpi_snapshot": kpi_snapshot,
}

ORACLES = {
    "label_normalize": f"""WITH {JUDGED_SQL}
SELECT event_id, label, prediction, real_val, is_correct FROM judged""",
    "sentiment_name": f"""WITH {SCORED_SQL}
SELECT event_id, CASE WHEN prediction = 0 THEN 'NEGATIVE'
                      WHEN prediction IS NOT NULL THEN 'POSITIVE' END AS sentiment
FROM scored""",
    "class_counts": f"""WITH {SCORED_SQL}
SELECT count(*) FILTER (prediction = 1) AS positive,
       count(*) FILTER (prediction = 0) AS negative FROM scored""",
    "confusion_matrix": f"WITH {JUDGED_SQL} SELECT {_CELLS} FROM judged",
    "confusion_cells": f"""WITH {JUDGED_SQL}
SELECT real_val, prediction, count(*) AS n FROM judged GROUP BY real_val, prediction""",
    "confusion_by_group": f"""WITH {JUDGED_SQL}
SELECT event_type, {_CELLS} FROM judged GROUP BY event_type""",
    "accuracy": f"WITH {JUDGED_SQL} SELECT {_ACCURACY} FROM judged",
    "accuracy_labeled_only": f"""WITH {JUDGED_SQL}
SELECT {_ACCURACY} FROM judged WHERE label IS NOT NULL""",
    "accuracy_by_group": f"""WITH {JUDGED_SQL}
SELECT event_type, {_ACCURACY} FROM judged GROUP BY event_type""",
    "prediction_share": f"""WITH {SCORED_SQL}
SELECT CASE WHEN prediction = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
       count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM scored WHERE prediction IN (0, 1) GROUP BY prediction""",
    "latest_n": f"WITH {LATEST_SQL} SELECT event_id, event_type, label, prediction FROM latest",
    "latest_confusion": f"""WITH {LATEST_SQL}
SELECT count(*) FILTER (prediction = 1) AS positive,
       count(*) FILTER (prediction = 0) AS negative, {_CELLS} FROM latest""",
    "accuracy_curves": f"""WITH {LATEST_SQL}, {curves_sql("latest")}
SELECT event_id, step, real_val, is_correct, {_CURVES} FROM curves""",
    "curves_by_group": f"""WITH {LATEST_SQL}, {curves_sql("latest", "event_type")}
SELECT event_type, event_id, step, {_CURVES} FROM curves""",
    "curves_unlabeled": f"""WITH {LATEST_SQL}, {curves_sql("latest")}
SELECT event_id, step, prediction, {", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in CURVES)}
FROM curves""",
    "history_curves": f"""WITH {JUDGED_SQL}, {curves_sql("judged")}
SELECT event_id, step, real_val, is_correct, {_CURVES} FROM curves""",
    "history_curves_by_group": f"""WITH {JUDGED_SQL}, {curves_sql("judged", "event_type")}
SELECT event_type, event_id, step, real_val, is_correct, {_CURVES} FROM curves""",
    "curve_bounds": f"""WITH {LATEST_SQL}, {curves_sql("latest")}
SELECT greatest(0.0::DOUBLE, least(min(running_accuracy), min(rolling_accuracy)) - 5)
         AS accuracy_low,
       least(100.0::DOUBLE, greatest(max(running_accuracy), max(rolling_accuracy)) + 5)
         AS accuracy_high,
       greatest(max(running_error), max(rolling_error)) + 0.1::DOUBLE AS error_high
FROM curves""",
    "kpi_snapshot": f"""WITH {LATEST_SQL}
SELECT (SELECT count(*) FROM events) AS total_rows,
       sum(is_correct)::DOUBLE / count(*) * 100 AS accuracy,
       '%' || format('{{:.1f}}', sum(is_correct)::DOUBLE / count(*) * 100) AS accuracy_text,
       count(*) FILTER (prediction = 1) AS positive,
       count(*) FILTER (prediction = 0) AS negative
FROM latest""",
}
