import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from valence.sources.csvfiles import POST_SCHEMA, read_posts, read_posts_and_rejects, write_posts
from valence.sources.messages import parse_messages, publish, to_messages
from valence.sources.store import (
    REJECTED,
    STORE_SCHEMA,
    read_latest,
    read_store,
    write_batch,
    write_delta,
)

TEXTS = [
    'café said "hi", ok',
    "two\nlines",
    "carriage\r\nreturn\rhere",
    "back\\slash \\\" and \\n",
    "  padded  ",
    "\ttab",
    "",
    None,
    "null",
    "NA",
    '"',
    '""',
    ",",
    "#comment",
    "ÿ\u00a0",
]


def _posts(spark, texts):
    rows = [(4 * (i % 2), i, "d", None, "u, v", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, POST_SCHEMA)


def _empty_as_null(posts):
    return posts.withColumn("text", F.nullif("text", F.lit(""))).collect()


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "UTF-8"])
def test_csv_keeps_every_value(spark, tmp_path, encoding):
    posts = _posts(spark, TEXTS)
    path = str(tmp_path / "csv")
    write_posts(posts, path, encoding)
    back = read_posts(spark, path, encoding)
    assert back.schema == POST_SCHEMA
    assert sorted(back.collect(), key=lambda r: r.id) == _empty_as_null(posts)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='"\\,\n\r \tabé', max_size=12), min_size=20, max_size=40))
def test_csv_property(spark, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("csv") / "x")
    posts = _posts(spark, texts)
    write_posts(posts, path)
    assert sorted(read_posts(spark, path).collect(), key=lambda r: r.id) == _empty_as_null(posts)


def test_csv_written_elsewhere(spark, tmp_path):
    # As other CSV writers put it: quotes only where needed, empty fields for missing values.
    path = tmp_path / "posts.csv"
    path.write_bytes(
        '0,1,Mon,NO_QUERY,ann,plain\n4,2,Tue,NO_QUERY,bob,"caf\xe9 ""hi"",\nok"\n0,,Wed,,,\n'.encode(
            "latin-1"
        )
    )
    got = [tuple(r) for r in read_posts(spark, str(path)).collect()]
    assert got == [
        (0, 1, "Mon", "NO_QUERY", "ann", "plain"),
        (4, 2, "Tue", "NO_QUERY", "bob", 'café "hi",\nok'),
        (0, None, "Wed", None, None, None),
    ]


def test_csv_with_other_line_ends(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_bytes(b'"0","1","Mon","NO_QUERY","ann","plain"\r\n4,2,Tue,NO_QUERY,bob,"a, b"\r\n')
    for multi_line in (True, False):
        posts = read_posts(spark, str(path), multi_line=multi_line, line_sep=None)
        assert [(r.target, r.text) for r in posts.collect()] == [(0, "plain"), (4, "a, b")]


def test_csv_lines_can_be_split_over_tasks(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_posts(_posts(spark, ["x y z"] * 20_000).coalesce(1), path)
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "100k")
    try:
        for multi_line in (True, False):
            lines = read_posts(spark, path, multi_line=multi_line)
            assert lines.rdd.getNumPartitions() > 1 and lines.count() == 20_000
        # With line ends that Spark has to find out, a file is still one task.
        assert read_posts(spark, path, line_sep=None).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(size)


def test_csv_files_are_bounded(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_posts(_posts(spark, ["x"] * 100).coalesce(1), path, rows_per_file=10)
    files = read_posts(spark, path, multi_line=False).inputFiles()
    assert len(files) == 10 and read_posts(spark, path).count() == 100


def test_csv_does_not_replace_characters(spark, tmp_path):
    with pytest.raises(PySparkException, match="does not fit"):
        write_posts(_posts(spark, ["fine", "smile \U0001f600"]), str(tmp_path / "csv"))


def test_messages(spark, tmp_path):
    posts = _posts(spark, TEXTS)
    path = str(tmp_path / "messages")
    publish(to_messages(posts), path=path)
    back = parse_messages(spark.read.text(path))
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    expected = [(r.text, r.target) for r in posts.collect()]
    assert sorted([tuple(r) for r in back.collect()], key=key) == sorted(expected, key=key)


@pytest.mark.parametrize(
    "value, text, label",
    [
        ('{"text": "a", "label": 4}', "a", 4),
        ('{"text": "a", "label": 4, "more": [1]}', "a", 4),
        ('{"text": "a"}', "a", None),
        ('{"label": 4}', None, 4),
        ('{"text": 5, "label": "4"}', "5", None),
        ('{"text": "a", "label": 3000000000}', "a", None),
        ('{"text": "a", "label": 4.5}', "a", None),
        ("bad", None, None),
        ('{"text": "a", "lab', None, None),
        ("[]", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parsing(spark, value, text, label):
    raw = spark.createDataFrame([(value,)], "value string")
    for df in (raw, raw.withColumn("value", F.col("value").cast("binary"))):
        assert tuple(parse_messages(df).first()) == (text, label)


def test_store_replaces_a_batch(spark, tmp_path):
    path = str(tmp_path / "store")
    assert read_store(spark, path).count() == 0
    rows = [("a", 4, "POSITIVE", 1.0, "scored"), (None, 0, None, None, "rejected")]
    batch = spark.createDataFrame(rows, "text string, label int, sentiment string, "
                                        "prediction double, outcome string")
    for batch_id in (0, 1, 1):
        write_batch(batch, batch_id, path)
    assert sorted(r.batch_id for r in read_store(spark, path).collect()) == [0, 1]
    assert read_store(spark, path, outcome=REJECTED).count() == 2
    assert read_store(spark, path).columns == [*STORE_SCHEMA.names, "batch_id"]


def test_store_reads_the_wanted_folders_only(spark, tmp_path, plan):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([("a", "scored")], "text string, outcome string")
    for batch_id in range(3):
        write_batch(batch, batch_id, path)
    newest = read_store(spark, path).filter("batch_id >= 2")
    partition_filters = plan(newest).split("PartitionFilters: [")[1].split("]")[0]
    assert "batch_id" in partition_filters and "outcome" in partition_filters


def test_each_group_as_the_last_batch_left_it(spark, tmp_path):
    path, schema = str(tmp_path / "deltas"), "g string, x int"
    read = lambda: sorted((r.g or "", r.x) for r in read_latest(spark, path, spark.createDataFrame([], schema).schema, ("g",)).collect())
    assert read() == []
    write_delta(spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], schema), 0, path)
    write_delta(spark.createDataFrame([("a", 2), ("c", 2)], schema), 1, path)
    write_delta(spark.createDataFrame([(None, None)], schema), 2, path)
    write_delta(spark.createDataFrame([], schema), 3, path)
    assert read() == [("", None), ("a", 2), ("b", 1), ("c", 2)]
    write_delta(spark.createDataFrame([("a", 20)], schema), 1, path)  # the batch is run again
    assert read() == [("", None), ("a", 20), ("b", 1)]
    # Without groups there is one row, or none.
    one = str(tmp_path / "one")
    assert read_latest(spark, one, spark.createDataFrame([], "x int").schema).collect() == []
    for batch_id in (0, 1):
        write_delta(spark.createDataFrame([(batch_id,)], "x int"), batch_id, one)
    assert [r.x for r in read_latest(spark, one, spark.createDataFrame([], "x int").schema).collect()] == [1]


def test_records_that_do_not_fit_are_kept_apart(spark, tmp_path):
    lines = ["4,1,d,f,u,good", "four,2,d,f,u,bad type", "0,3,d,f,u,too,many", "0,4,d", '0,5,d,f,u,"two', 'lines"', ",,,,,"]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    posts, rejects = read_posts_and_rejects(spark, str(tmp_path))
    assert sorted((r.id, r.text) for r in posts.collect() if r.id) == [(1, "good"), (5, "two\nlines")]
    assert posts.count() == 3 and rejects.count() == 3
    assert sorted(r.line for r in rejects.collect()) == sorted(lines[1:4])
    # By lines, the first half of the split text has six fields and the second half has one.
    rejects = read_posts_and_rejects(spark, str(tmp_path), multi_line=False)[1]
    assert sorted(r.line for r in rejects.collect()) == sorted([*lines[1:4], lines[5]])
