"""The newest rows of a large table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

MONITORED_ROWS = 2000  # fixed size of the monitoring window
_BITS = 12  # of the key's range looked at per pass: at most 8,192 counts


def latest_n(
    df: DataFrame, *order: str, n: int = MONITORED_ROWS, direct_rows: int = 0
) -> DataFrame:
    """The ``n`` rows with the highest ``order`` (later columns break ties), newest first.

    Spark's top-n sends up to ``n`` rows of every input task to one last task, which a
    table of many thousand files would swamp. So a floor under the newest rows is looked
    up first: integer keys are counted per range (the key column alone is read, and only
    counts are shuffled) until few enough rows remain above the floor. The filter on the
    floor reaches the scan, which skips the row groups and batch folders below it. It is
    looked up at every size of the table; a caller may stop the search as soon as no more
    than ``direct_rows`` remain. Keys from the first one on that is not an integer have no
    floor: order by an integer key first, or every task sends its ``n`` rows.
    """
    floor = _floor(df, order, n, max(direct_rows, n))
    newest = df if floor is None else df.filter(floor)
    return newest.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def _floor(df: DataFrame, order: tuple[str, ...], n: int, enough: int) -> Column | None:
    """A condition that holds for the newest ``n`` rows and, if possible, for few others."""
    scope, above, floor = df, 0, []
    for key in order:
        if not isinstance(df.schema[key].dataType, T.IntegralType):
            break
        k = F.col(key)
        low, high, rows = scope.agg(F.min(k), F.max(k), F.count(k)).first()
        if above + rows <= enough:
            break
        # `above` rows are newer than anything between `low` and `high`, where `rows` lie.
        while above + rows > enough and low < high:
            shift = max(0, (high - low).bit_length() - _BITS)
            bins = F.shiftright(k, shift).alias("bin")
            counts = scope.filter(k.between(low, high)).groupBy(bins).count()
            for row in counts.orderBy(F.desc("bin")).collect():  # at most 2 ** (_BITS + 1)
                rows = row["count"]
                if above + rows >= n:
                    break
                above += rows
            low = max(low, row["bin"] << shift)
            high = min(high, ((row["bin"] + 1) << shift) - 1)
        floor.append((key, low))
        if above + rows <= enough:
            break
        scope = scope.filter(k == low)  # too many rows share this value: look at the next key
    return _at_or_above(floor) if floor else None


def _at_or_above(floor: list[tuple[str, int]]) -> Column:
    (key, low), rest = floor[0], floor[1:]
    k = F.col(key)
    # The plain comparison comes first and alone: it is the part a scan can use to skip data.
    return (k >= low) & ((k > low) | _at_or_above(rest)) if rest else k >= low
