from types import SimpleNamespace

import pytest

from valence.session import shared_dir, written


def _session(master, setting=None, checkpoints=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints)
    given = {"spark.checkpoint.dir": setting, "spark.sql.warehouse.dir": "file:/w/"}
    conf = SimpleNamespace(get=lambda name, default=None: given[name] or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_folders_lie_below_the_setting():
    session = _session("spark://m:7077", "hdfs://shared/checkpoints/")
    first, second = shared_dir(session, "x"), shared_dir(session, "x")
    assert first.startswith("hdfs://shared/checkpoints/x-") and first != second
    assert shared_dir(_session("yarn", None, "s3a://b/c"), "x").startswith("s3a://b/c/x-")


def test_a_cluster_gets_no_local_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("yarn"), "x")


def test_a_local_session_uses_its_warehouse():
    assert shared_dir(_session("local[2]"), "x").startswith("file:/w/checkpoints/x-")


def test_written_rows_are_the_same(spark):
    df = spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS s")
    again = written(df, "t")
    assert again.dtypes == df.dtypes and sorted(again.collect()) == df.collect()
    assert all("/t-" in f for f in again.inputFiles())
