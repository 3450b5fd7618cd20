"""Files with line breaks in quotes, read in splits, against the reader that gives each file to one task."""

import random
from collections import Counter

import pytest

from valence.sources import csvfiles, splitcsv
from valence.sources.csvfiles import POST_SCHEMA, read_posts, read_posts_and_rejects


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        for name, value in zip(names, (size, 1), strict=True):
            spark.conf.set(name, str(value))

    yield use
    for name, value in zip(names, old, strict=True):
        spark.conf.set(name, value)


def _records(seed, n):
    rng = random.Random(seed)

    def quoted(size):
        text = "".join(rng.choices('ab é,"\n\r\\', weights=[5, 5, 3, 2, 2, 2, 4, 1, 1], k=rng.randint(0, size)))
        return '"' + text.replace('"', '""') + '"'

    def plain():
        return rng.choice(["", "x", " y ", "z\\"])

    out = []
    for k in range(n):
        fields = [rng.choice(["0", "4", "x", ""]), str(k), quoted(9), plain(), quoted(20), quoted(90)]
        kind = rng.random()
        if kind < 0.05:
            fields = fields[:4]  # too few
        elif kind < 0.1:
            fields.append("more")
        elif kind < 0.2:
            fields[3] = rng.choice(['a"b', 'x"', '"q"z', '"a" ', 'a"b"c'])  # quotes that open nothing
        out.append(",".join(fields) if kind < 0.95 else "")
    return out


def _whole(spark, path, schema=POST_SCHEMA, **more):
    return csvfiles._read(spark, path, csvfiles.LATIN_1, schema, True, "\n", **more)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_same_rows_and_rejects_as_by_whole_files(spark, splits, tmp_path, size):
    for k in range(2):
        text = "\n".join(_records(k, 40)) + ("\n" if k else "")
        (tmp_path / f"{k}.csv").write_bytes(text.encode("latin-1"))
    path = str(tmp_path)
    splits(size)
    assert Counter(read_posts(spark, path).collect()) == Counter(_whole(spark, path).collect())
    marked = csvfiles.T.StructType([*POST_SCHEMA.fields, csvfiles.T.StructField("_line", csvfiles.T.StringType())])
    rows = _whole(spark, path, marked, columnNameOfCorruptRecord="_line").collect()
    good, bad = read_posts_and_rejects(spark, path)
    assert Counter(good.collect()) == Counter(r[:-1] for r in rows if r[-1] is None)
    assert Counter(r.line for r in bad.collect()) == Counter(r[-1] for r in rows if r[-1] is not None) and bad.count()


def test_one_file_in_many_tasks_with_a_text_over_many_splits(spark, splits, tmp_path):
    long = '"' + "line, \n" * 400 + '""\n"'
    rows = [f'4,{k},d,f,u,"a\nb"' for k in range(200)]
    rows.insert(50, f"0,-1,d,f,u,{long}")
    (tmp_path / "one.csv").write_text("\n".join(rows) + "\n")
    splits(300)
    got = read_posts(spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == [-1, *range(200)]
    assert {r.text for r in got if r.id >= 0} == {"a\nb"}
    assert next(r.text for r in got if r.id == -1) == "line, \n" * 400 + '"\n'
    pieces = spark.read.text(str(tmp_path), lineSep="\n")
    assert pieces.rdd.getNumPartitions() > 15


def test_open_quotes_and_empty_files(spark, splits, tmp_path):
    (tmp_path / "a.csv").write_text('4,1,d,f,u,"never closed\n4,2,d,f,u,x\n')
    (tmp_path / "b.csv").write_text("4,3,d,f,u,x")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("\n\n")
    for size in (16, 1 << 20):
        splits(size)
        assert sorted(r.id for r in read_posts(spark, str(tmp_path)).collect()) == [1, 3]


def test_a_line_does_one_of_four_things():
    for line, from_outside, from_inside in (
        (b"a,b", False, True), (b'a,"b', True, False), (b'a","b', True, True), (b'x"y', False, False), (b'"a""', True, False),
        (b'"",""', False, True), (b'"a"b,"', True, True), (b'a""b', False, True), (b'"', True, False), (b',"",",', True, False),
    ):
        assert splitcsv.ends_inside(line, False) == from_outside, line
        assert splitcsv.ends_inside(line, True) == from_inside, line


def test_states_by_running_composition(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for file in "ab":
        state = False
        for split in range(200):
            ends = rng.choice([(False, True), (True, False), (False, False), (True, True)])
            rows.append((file, split * 10, *ends))
            want[file, split * 10] = state
            state = ends[state]
    ends = spark.createDataFrame(rows, "file string, split long, ends_inside boolean, other_ends_inside boolean")
    assert {(r.file, r.split): r.inside for r in splitcsv.split_states(ends).collect()} == want
