import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from valence.operators import split


def _hash(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def _ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


@pytest.mark.parametrize("n, fraction", [(0, 0.8), (1, 0.8), (7, 0.8), (1000, 0.8), (1000, 0.0), (10, 1.0), (999, 0.333)])
def test_exact_split_is_the_first_rows_in_hash_order(spark, n, fraction):
    df = spark.range(n)
    train, live = split.exact_split(df, "id", fraction)
    ranked = sorted(range(n), key=_hash)
    k = int(n * fraction)
    assert _ids(train) == sorted(ranked[:k]) and _ids(live) == sorted(ranked[k:])


def test_exact_split_needs_no_shuffle(spark, plan):
    for part in split.exact_split(spark.range(1000), "id"):
        assert "Exchange" not in plan(part)


def test_exact_split_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(split, "_HEX", 1)
    monkeypatch.setattr(split, "_SMALL", 2)
    train, live = split.exact_split(spark.range(5000), "id", 0.8)
    ranked = sorted(range(5000), key=_hash)
    assert _ids(train) == sorted(ranked[:4000]) and _ids(live) == sorted(ranked[4000:])


@pytest.mark.parametrize("small", [1, 10_000])
@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.8, 0.95])
def test_exact_split_with_one_hot_key(spark, monkeypatch, small, fraction):
    monkeypatch.setattr(split, "_SMALL", small)
    # Two thirds of the rows share a key; half of those are copies of one row.
    hot = spark.range(600).select(
        F.lit(7).alias("id"), F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("x")
    )
    df = spark.range(100, 400).select(F.col("id").cast("int"), F.col("id").alias("x")).union(hot)
    train, live = split.exact_split(df, "id", fraction)
    assert train.count() == int(900 * fraction) and live.count() == 900 - int(900 * fraction)
    both = Counter(map(tuple, train.collect())) + Counter(map(tuple, live.collect()))
    assert both == Counter(map(tuple, df.collect()))
    key = _hash(7)
    assert all(_hash(r.id) <= key for r in train.collect()) or all(
        _hash(r.id) >= key for r in live.collect()
    )


def test_exact_split_of_equal_rows(spark):
    train, live = split.exact_split(spark.range(10).select(F.lit(1).alias("id")), "id", 0.8)
    assert (train.count(), live.count()) == (8, 2)


def test_many_copies_are_made_in_chunks(spark):
    assert split._repeat(spark.range(5, 6), 1234, chunk=100).agg(F.sum("id")).first()[0] == 5 * 1234
    assert split._repeat(spark.range(1), 0).count() == 0


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    for parts in (1, 4, 7):
        moved = df.repartition(parts)
        assert _ids(split.exact_split(moved, "id")[0]) == _ids(split.exact_split(df, "id")[0])
        assert _ids(split.hash_split(moved, "id", [0.8, 0.2])[0]) == _ids(
            split.hash_split(df, "id", [0.8, 0.2])[0]
        )
        assert [r.id for r in split.seeded_shuffle(moved, "id").collect()] == sorted(
            range(1000), key=_hash
        )


def test_hash_split_covers_everything_once(spark, plan):
    parts = split.hash_split(spark.range(3000), "id", [3, 1, 1], seed=5)
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 3000
    assert _ids(parts[0].union(parts[1]).union(parts[2])) == list(range(3000))
    assert all(abs(s / 3000 - w) < 0.04 for s, w in zip(sizes, (0.6, 0.2, 0.2)))
    assert all("Exchange" not in plan(p) for p in parts)


def test_seed_changes_the_order(spark):
    orders = [[r.id for r in split.seeded_shuffle(spark.range(50), "id", s).collect()] for s in (1, 2)]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_shuffle_spreads_copies(spark):
    df = spark.range(4000).select(F.lit(1).alias("id"), F.lit("x").alias("text"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        shuffled = split.seeded_shuffle(df, "id").select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in shuffled.groupBy("p").count().collect()]
    finally:
        spark.conf.unset(coalesce)
    assert len(sizes) == 4 and max(sizes) < 2000


def test_split_counts(spark):
    rows = split.split_counts(split.exact_split_names(spark.range(11), "id")).collect()
    assert {r.split: r.n for r in rows} == {"train": 8, "live": 3}


def test_names_are_those_of_the_parts(spark, plan):
    unique = spark.range(50)
    copies = spark.range(50).select(F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("id"))
    for df in (unique, copies):
        named = split.exact_split_names(df, "id")
        parts = split.exact_split(df, "id")
        for name, part in zip(("train", "live"), parts):
            assert _ids(named.filter(F.col("split") == name)) == _ids(part)
    assert "Union" not in plan(split.exact_split_names(unique, "id"))


def test_a_part_can_be_split_again(spark):
    train, _ = split.exact_split(spark.range(2000), "id")
    held_out = split.hash_split(train, "id", [0.8, 0.2])[1]
    assert 260 < held_out.count() < 380
    again, _ = split.exact_split(held_out, "id", 0.5)
    assert again.count() == held_out.count() // 2


def test_positions_are_those_of_the_shuffle(spark):
    df = spark.range(300).select((F.col("id") % 100).alias("id"), F.lit("x").alias("t")).repartition(7)
    rows = split.shuffle_positions(df, "id").collect()
    assert sorted(r.position for r in rows) == list(range(300))
    order = [r.id for r in split.seeded_shuffle(df, "id").collect()]
    assert [r.id for r in sorted(rows, key=lambda r: r.position)] == order
    assert split.shuffle_positions(df.limit(0), "id").count() == 0


def test_hash_split_names_are_the_parts(spark):
    parts = split.hash_split(spark.range(500), "id", [1, 2, 1])
    named = split.hash_split_names(spark.range(500), "id", {"a": 1, "b": 2, "c": 1})
    for part, name in zip(parts, "abc"):
        assert sorted(part.collect()) == sorted(named.filter(F.col("split") == name).drop("split").collect())
