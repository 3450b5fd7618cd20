"""Column expressions about labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the data format: the raw label that means "positive", and the two predictions.
POSITIVE_LABEL = 4
POSITIVE, NEGATIVE = 1.0, 0.0


def real_value(label: Column | str) -> Column:
    """1.0 for the positive raw label, 0.0 for every other one, a missing one included."""
    return F.when(_col(label).eqNullSafe(F.lit(POSITIVE_LABEL)), POSITIVE).otherwise(NEGATIVE)


def is_correct(real: Column | str, prediction: Column | str) -> Column:
    """1 where the prediction equals the real value, else 0; a missing prediction is wrong."""
    return F.coalesce(_col(real) == _col(prediction), F.lit(False)).cast("int")


def sentiment(
    prediction: Column | str, negative: str = "NEGATIVE", positive: str = "POSITIVE"
) -> Column:
    """Name of a prediction; a missing prediction has no name."""
    prediction = _col(prediction)
    return F.when(prediction == NEGATIVE, negative).when(prediction.isNotNull(), positive)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
