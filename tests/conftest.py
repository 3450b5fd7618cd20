import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from valence.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plan():
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


@pytest.fixture(scope="session")
def stream(spark, tmp_path_factory):
    """Rows as a stream of one micro-batch per file."""

    def make(df, files=3):
        path = str(tmp_path_factory.mktemp("stream") / "rows")
        df.repartition(files).write.parquet(path)
        reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(path)

    return make
