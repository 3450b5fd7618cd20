from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.ml.feature import Tokenizer
from pyspark.sql import functions as F

from valence.functions.labels import is_correct, real_value, sentiment
from valence.functions.text import percent, preview, tokens


def _both(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ours = Tokenizer(inputCol="text", outputCol="theirs").transform(df)
    return [(r.theirs, r.ours) for r in ours.withColumn("ours", tokens("text")).collect()]


def test_tokens_are_those_of_the_tokenizer(spark):
    texts = [" a  b ", "a\tb\n", "", "  ", "\n", "One TWO  three", "x", " x", "é À\u00a0b ", "a\x0bb"]
    for theirs, ours in _both(spark, texts):
        assert ours == theirs
    edges = [ours for _, ours in _both(spark, [" a  b ", "", "  "])]
    assert edges == [["", "a", "", "b"], [""], []]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x0c aBcÉß.ñ", max_size=30), min_size=20, max_size=60))
def test_tokens_property(spark, texts):
    for theirs, ours in _both(spark, texts):
        assert ours == theirs


def test_tokens_of_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(tokens("text").alias("w")).first().w is None


def test_labels(spark):
    rows = [(4, 1.0), (4, 0.0), (0, 0.0), (0, 1.0), (None, 0.0), (2, 0.0), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "label int, prediction double")
    got = df.select(
        real_value("label").alias("real"),
        is_correct(real_value("label"), "prediction").alias("ok"),
        sentiment("prediction").alias("name"),
        sentiment("prediction", "NEG", "POS").alias("own"),
    ).collect()
    assert [r.real for r in got] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    assert [r.ok for r in got] == [1, 0, 1, 0, 1, 1, 0, 0]
    positive, negative = "POSITIVE", "NEGATIVE"
    expected = [positive, negative, negative, positive, negative, negative, None, None]
    assert [r.name for r in got] == expected
    assert [r.own for r in got] == [e and e[:3] for e in expected]


def test_preview_and_percent(spark):
    df = spark.createDataFrame([("x" * 60, 12.345), ("ab", 100.0)], "text string, p double")
    got = df.select(
        preview("text").alias("s"), percent("p").alias("p1"), percent(F.col("p"), 2).alias("p2")
    ).collect()
    assert [tuple(r) for r in got] == [
        ("x" * 50 + "...", "%12.3", "%12.35"),
        ("ab...", "%100.0", "%100.00"),
    ]


def test_percent_rounds_like_python(spark):
    values = [i / 2000 * 100 for i in range(2001)] + [k / 37 * 100 for k in range(38)] + [1234.56]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = df.select("p", percent("p").alias("p1"), percent("p", 2).alias("p2")).collect()
    assert all((r.p1, r.p2) == (f"%{r.p:.1f}", f"%{r.p:.2f}") for r in got)
