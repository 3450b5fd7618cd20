"""Reproducible shuffles and splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from valence.session import written

_HEX = 4  # digits looked at per pass: at most 65,536 counts
_SMALL = 10_000  # rows of a group whose hashes are counted one by one
_DEEP = 12  # digits after which hardly two different keys share a group, however many rows it has


def hash_order(key: str | list[str], seed: int = 42) -> Column:
    """A pseudo-random sort key, 32 hex digits, fixed by the seed and the row's key."""
    keys = [key] if isinstance(key, str) else key
    parts = [F.lit(f"{seed}")] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def shuffle_keys(df: DataFrame, key: str | list[str], seed: int = 42) -> list[Column]:
    """What to sort by for a reproducible random order.

    Rows with equal keys are told apart by their content, and copies of one row by chance,
    so that a range-partitioned sort can spread them over several tasks.
    """
    return [hash_order(key, seed), F.xxhash64(*df.columns), F.rand(seed)]


def seeded_shuffle(df: DataFrame, key: str | list[str], seed: int = 42) -> DataFrame:
    """All rows in a reproducible random order."""
    return df.orderBy(*shuffle_keys(df, key, seed))


def shuffle_positions(
    df: DataFrame, key: str | list[str], seed: int = 42, name: str = "position"
) -> DataFrame:
    """All rows with their place, from 0, in the reproducible random order.

    The sorted rows are written once; a task's rows are counted on from those of the tasks
    before it, so no task sees all rows. Pass a table, or narrow steps on one.
    """
    place = F.monotonically_increasing_id()  # task and place in the task
    ordered = written(seeded_shuffle(df, key, seed).withColumn("_place", place), "shuffled")
    marked = ordered.withColumn("_task", F.shiftright("_place", 33))
    sizes = marked.groupBy("_task").agg(F.count("*").alias("_n"))  # a row per task
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(starts), "_task").select(
        *df.columns, (F.col("_start") + within).alias(name)
    )


def hash_share(key: str | list[str], seed: int = 42) -> Column:
    """A number from 0 up to 1, fixed by the seed and the row's key.

    Made from the last digits of the hash, so that it is independent of the hash order: the
    first part of an exact split can be split again with the same seed.
    """
    return F.conv(F.substring(hash_order(key, seed), 25, 8), 16, 10).cast("long") / 2**32


def hash_split(
    df: DataFrame, key: str | list[str], weights: list[float], seed: int = 42
) -> list[DataFrame]:
    """Random split by weights. Each part is a filter on the hash of the key: no shuffle.

    Rows with equal keys go to the same part.
    """
    share, edges = hash_share(key, seed), _edges(weights)
    return [df.filter((share >= lo) & (share < hi)) for lo, hi in zip(edges, edges[1:])]


def hash_split_names(
    df: DataFrame, key: str | list[str], weights: dict[str, float], seed: int = 42
) -> DataFrame:
    """The same split as a column ``split`` with the name of the part, in one pass over the rows."""
    share, named = hash_share(key, seed), F
    for name, edge in zip(weights, _edges(list(weights.values()))[1:]):
        named = named.when(share < edge, name)
    return df.withColumn("split", named)


def _edges(weights: list[float]) -> list[float]:
    return [sum(weights[:i]) / sum(weights) for i in range(len(weights) + 1)]


def exact_split(
    df: DataFrame, key: str | list[str], fraction: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Split off exactly ``int(rows * fraction)`` rows, the first ones in hash order.

    The border is searched first: each pass counts the rows per next four digits of the
    hash and follows the group that holds the border, so a pass reads the key alone and
    shuffles at most 65,536 counts per task. Both parts are then plain filters of the
    input. Rows with the border's key are ordered by a hash of the whole row; if even
    those are equal they are copies of one row, and the copies are dealt out by number.
    """
    border, want, ties = _search(df, key, fraction, seed)
    if want in (0, ties):
        first = _first(border, whole=want == ties)
        return df.filter(first), df.filter(~first)
    below, up_to = _first(border, whole=False), _first(border, whole=True)
    copy = df.filter(up_to & ~below).limit(1)
    return (
        df.filter(below).unionByName(_repeat(copy, want)),
        df.filter(~up_to).unionByName(_repeat(copy, ties - want)),
    )


def exact_split_names(
    df: DataFrame, key: str | list[str], fraction: float = 0.8, seed: int = 42
) -> DataFrame:
    """The same split as a column ``split``, ``train`` or ``live``, in one pass over the rows."""
    border, want, ties = _search(df, key, fraction, seed)
    if want in (0, ties):
        first = _first(border, whole=want == ties)
        return df.withColumn("split", F.when(first, "train").otherwise("live"))
    train, live = exact_split(df, key, fraction, seed)
    named = [part.withColumn("split", F.lit(n)) for part, n in ((train, "train"), (live, "live"))]
    return named[0].unionByName(named[1])


def split_counts(named: DataFrame) -> DataFrame:
    """Rows per part."""
    return named.groupBy("split").agg(F.count("*").alias("n"))


def _search(
    df: DataFrame, key: str | list[str], fraction: float, seed: int
) -> tuple[list[tuple[Column, str]], int, int]:
    """The border as hashes and their values, and how many of the rows on it go before it."""
    whole_row = F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    scope, border, want = df, [], None
    for level in (hash_order(key, seed), whole_row):
        want, value, ties = _border(scope, level, want, fraction)
        border.append((level, value))
        if want in (0, ties):
            break
        scope = scope.filter(level == value)
    return border, want, ties


def _first(border: list[tuple[Column, str]], whole: bool) -> Column:
    """Rows before the border, by one hash after the other, or up to it as a whole."""
    (level, value), rest = border[0], border[1:]
    if rest:
        return (level < value) | ((level == value) & _first(rest, whole))
    return level <= value if whole else level < value


def _border(
    scope: DataFrame, level: Column, want: int | None, fraction: float
) -> tuple[int, str, int]:
    """The hash at the border, how many of its rows are still wanted, and how many it has."""
    hashes = scope.select(level.alias("h"))
    prefix = ""
    while True:
        group = F.substring("h", 1, len(prefix) + _HEX)
        counts = (
            hashes.filter(F.col("h").startswith(prefix)).groupBy(group.alias("g")).count()
        ).collect()  # at most 16 ** _HEX rows
        counts = sorted((row["g"], row["count"]) for row in counts)
        if want is None:
            want = int(sum(n for _, n in counts) * fraction)
        if not counts:
            return 0, "", 0
        for prefix, rows in counts:
            if want <= rows:
                break
            want -= rows
        if rows <= _SMALL or len(prefix) >= _DEEP:
            single = hashes.filter(F.col("h").startswith(prefix)).groupBy("h").count()
            for row in single.orderBy("h").collect():  # at most _SMALL rows
                if want <= row["count"]:
                    return want, row["h"], row["count"]
                want -= row["count"]


def _repeat(row: DataFrame, times: int, chunk: int = 1_000_000) -> DataFrame:
    """One row, repeated; the copies are made by many tasks."""
    if times <= 0:
        return row.limit(0)
    chunks = -(-times // chunk)
    left = F.lit(times).cast("long") - F.col("_chunk") * chunk
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk).cast("long"), left))
    return (
        row.withColumn("_chunk", F.explode(numbers))
        .repartition(min(chunks, 1000))
        .withColumn("_copy", F.explode(copies))
        .drop("_chunk", "_copy")
    )
