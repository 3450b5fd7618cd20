"""How well the classifier does: counts, confusion matrix, accuracy, headline figures.

Each function is one aggregation pass. Rows are summed up before they are shuffled, so a
group that holds a large part of the table costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from valence.functions.labels import NEGATIVE, POSITIVE
from valence.functions.text import percent
from valence.operators.curves import accuracy_curves, with_correctness

def _predicted(value: float) -> Column:
    return F.col("prediction") == value


def _counts() -> list[Column]:
    return [
        F.count_if(_predicted(POSITIVE)).alias("positive"),
        F.count_if(_predicted(NEGATIVE)).alias("negative"),
    ]


def _cells() -> list[Column]:
    really_positive = F.col("real_val") == POSITIVE
    return [
        F.count_if(_predicted(NEGATIVE) & ~really_positive).alias("tn"),
        F.count_if(_predicted(POSITIVE) & ~really_positive).alias("fp"),
        F.count_if(_predicted(NEGATIVE) & really_positive).alias("fn"),
        F.count_if(_predicted(POSITIVE) & really_positive).alias("tp"),
    ]


def class_counts(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positive and negative predictions; a missing prediction is neither."""
    return scored.groupBy(*by).agg(*_counts())


def confusion_matrix(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The four cells of real against predicted class."""
    return with_correctness(scored).groupBy(*by).agg(*_cells())


def overview(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, class counts, confusion matrix and accuracy together. Batch or stream.

    Without a column ``label`` the matrix and the accuracy are zero.
    """
    rows = F.count("*").alias("total_rows")
    if "label" not in scored.columns:
        nothing = [F.lit(0).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")]
        every = [rows, *_counts(), *nothing, F.lit(0.0).alias("accuracy")]
        return scored.groupBy(*by).agg(*every)
    share = (F.avg("is_correct") * 100).alias("accuracy")
    return with_correctness(scored).groupBy(*by).agg(rows, *_counts(), *_cells(), share)


def confusion_cells(scored: DataFrame) -> DataFrame:
    """The same as rows: real value, prediction, number."""
    return (
        with_correctness(scored).groupBy("real_val", "prediction").agg(F.count("*").alias("n"))
    )


def accuracy(
    scored: DataFrame, by: tuple[str, ...] = (), labeled_only: bool = False
) -> DataFrame:
    """Rows, accuracy and error in percent; no rows give a missing accuracy.

    A missing label counts as negative, unless ``labeled_only`` leaves such rows out.
    """
    if labeled_only:
        scored = scored.filter(F.col("label").isNotNull())
    share = F.avg("is_correct")
    return (
        with_correctness(scored)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            (share * 100).alias("accuracy"),
            ((1 - share) * 100).alias("error"),
        )
    )


def prediction_share(scored: DataFrame) -> DataFrame:
    """Each class with its number of predictions and its share of both."""
    both = F.col("positive") + F.col("negative")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("sentiment"),
                F.col(count).alias("n"),
                F.try_divide(count, both).alias("share"),
            )
            for name, count in (("POSITIVE", "positive"), ("NEGATIVE", "negative"))
        ]
    )
    return class_counts(scored).select(F.inline(rows))


def kpi_snapshot(store: DataFrame, latest: DataFrame, *order: str) -> DataFrame:
    """Headline figures: all rows of the store, and the state of the latest ones.

    One row, also while the store is empty. Without labels the accuracy is zero.
    """
    total = store.agg(F.count("*")).scalar().alias("total_rows")
    last = F.max_by("running_accuracy", "step").alias("accuracy")
    state = accuracy_curves(latest, *order).agg(last, *_counts())
    shown = percent("accuracy").alias("accuracy_text")
    return state.select(total, "accuracy", shown, "positive", "negative")
