import collections
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from valence.functions.text import tokens
from valence.operators import classify, terms

POSTS = [
    (0, "bad awful day"),
    (4, "good  great day"),
    (0, " awful sad "),
    (4, "love great"),
    (4, "love it"),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "target int, text string")


@pytest.fixture(scope="module")
def model(posts):
    return classify.fit(classify.classifier(), classify.training_view(posts))


def test_training_view(spark):
    rows = [(4, "a"), (None, "b"), (0, None), (0, "c")]
    df = spark.createDataFrame(rows, "target int, text string")
    view = classify.training_view(df)
    assert view.columns == ["raw_label", "text"]
    assert sorted(map(tuple, view.collect())) == [(0, "c"), (4, "a")]


def test_parameters():
    indexer, tokenizer, hashing, idf, regression = classify.classifier().getStages()
    assert (indexer.getInputCol(), indexer.getOutputCol()) == ("raw_label", "label")
    assert (tokenizer.getInputCol(), tokenizer.getOutputCol()) == ("text", "words")
    assert hashing.getNumFeatures() == 20000 and hashing.getOutputCol() == "rawFeatures"
    assert hashing.getBinary() is False and idf.getMinDocFreq() == 0
    assert idf.getOutputCol() == "features" and regression.getMaxIter() == 20
    fresh = LogisticRegression()
    for name in ("regParam", "elasticNetParam", "tol", "fitIntercept", "standardization", "threshold", "family"):
        assert regression.getOrDefault(name) == fresh.getOrDefault(name)


def test_negative_is_class_zero_even_if_rarer(spark, posts, model):
    assert list(model.stages[0].labels) == ["0", "4"]
    scored = classify.score(model, posts.withColumnRenamed("target", "label")).collect()
    for row in scored:
        assert row.prediction == (1.0 if row.label == 4 else 0.0)
        assert row.sentiment == ("POSITIVE" if row.label == 4 else "NEGATIVE")


def test_index_by_frequency(posts):
    indexer = classify.label_indexer("frequencyDesc")
    assert list(indexer.fit(classify.training_view(posts)).labels) == ["4", "0"]


@pytest.fixture(scope="module")
def labelled(spark):
    path = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select(
        (F.col("quality") * 4).alias("raw_label"), "doc_id", "text"
    )


def test_fit_is_the_fit_of_all_stages_in_a_row(labelled):
    ours = classify.fit(classify.classifier(), labelled)
    plain = classify.classifier().fit(labelled)
    assert ours.stages[0].labels == plain.stages[0].labels
    assert ours.stages[3].idf == plain.stages[3].idf
    assert [type(s) for s in ours.stages] == [type(s) for s in plain.stages]
    a, b = ours.stages[4].coefficients.toArray(), plain.stages[4].coefficients.toArray()
    assert abs(a - b).max() < 1e-6
    ours_p, plain_p = (m.transform(labelled).select("doc_id", "prediction") for m in (ours, plain))
    assert ours_p.exceptAll(plain_p).count() == 0


def test_prediction_is_that_of_the_whole_model(labelled):
    model = classify.fit(classify.classifier(), labelled.filter("doc_id % 3 > 0"))
    short = classify.predict(model, labelled.select("doc_id", "text"))
    whole = model.transform(labelled).select("doc_id", "text", "prediction")
    assert short.columns == ["doc_id", "text", "prediction"]
    assert short.exceptAll(whole).count() == 0 and short.count() == whole.count()


def test_reloaded_model_predicts_the_same(tmp_path, model, posts):
    path = str(tmp_path / "model")
    for _ in range(2):  # the second time overwrites
        classify.save_model(model, path)
    again = classify.load_model(path)
    assert len(again.stages) == 5
    rows = posts.select("text")
    assert classify.predict(again, rows).collect() == classify.predict(model, rows).collect()


def test_missing_text_is_rejected(spark, model):
    rows = spark.createDataFrame([("love it", 4), (None, 4), ("", None)], "text string, label int")
    got = classify.score(model, rows).collect()
    assert [r.outcome for r in got] == ["scored", "rejected", "scored"]
    assert got[1].prediction is None and got[1].sentiment is None and got[1].text is None


def test_names_and_further_columns(spark, model):
    rows = spark.createDataFrame([(7, "love it", 4)], "id long, text string, label int")
    got = classify.score(model, rows, names=("NEGATİF", "POZİTİF"))
    assert got.columns == ["text", "label", "sentiment", "prediction", "id", "outcome"]
    assert got.first().sentiment == "POZİTİF"


def test_evaluation(spark, model):
    rows = [(0, "bad awful day"), (4, "love great"), (4, "awful sad"), (4, "love it")]
    view = spark.createDataFrame(rows, "raw_label int, text string")
    got = classify.evaluate(model, view).first()
    assert (got.n, got.accuracy, got.error, got.majority) == (4, 75.0, 25.0, 75.0)
    nothing = classify.evaluate(model, view.limit(0)).first()
    assert (nothing.n, nothing.accuracy) == (0, None)


def test_hashed_counts_add_up(spark, labelled):
    tokenizer, hashing, _ = classify.features()
    hashed = hashing.transform(tokenizer.transform(labelled))
    entries = terms.vector_entries(hashed, "doc_id", "rawFeatures", "tf")
    sums = {r.doc_id: r.n for r in entries.groupBy("doc_id").agg(F.sum("tf").alias("n")).collect()}
    row = hashed.select("doc_id", "words", "rawFeatures").first()
    assert sums[row.doc_id] == len(row.words)
    mine = entries.filter(F.col("doc_id") == row.doc_id).collect()
    assert SparseVector(20000, {r.bucket: r.tf for r in mine}) == row.rawFeatures


def test_entries_need_no_shuffle(labelled, plan):
    tokenizer, hashing, _ = classify.features()
    docs = labelled.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hashed = hashing.transform(tokenizer.transform(docs))
    assert "Exchange" not in plan(terms.vector_entries(hashed, "doc_id", "rawFeatures", "tf"))


def test_term_weights_with_hot_and_long_terms(spark, monkeypatch):
    import math

    monkeypatch.setattr(terms, "HOT_TERMS", 3)
    long_word = "x" * 500
    texts = [f"the {long_word} a{i} the" for i in range(20)] + ["the a1 a1", long_word + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.term): r for r in terms.tfidf_terms(docs, "doc_id").collect()}
    bags = [t.split(" ") for t in texts]
    assert len(got) == sum(len(set(b)) for b in bags)
    for (doc, term), row in got.items():
        df = sum(term in b for b in bags)
        assert (row.tf, row.df) == (bags[doc].count(term), df)
        assert math.isclose(row.tfidf, row.tf * math.log((len(texts) + 1) / (df + 1)), abs_tol=1e-12)


def test_terms_of_repeated_ids_are_those_of_one_document(spark):
    rows = [(1, "a a b"), (1, "A c"), (2, "a  "), (None, "b"), (None, "b"), (3, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = sorted(((r.doc_id or 0, r.term, r.tf) for r in terms.term_counts(docs, "doc_id").collect()))
    assert counts == [(0, "b", 2), (1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "a", 1)]
    weights = {(r.doc_id, r.term): (r.tf, r.df) for r in terms.tfidf_terms(docs, "doc_id").collect()}
    assert weights == {(None, "b"): (2, 2), (1, "a"): (3, 2), (1, "b"): (1, 2), (1, "c"): (1, 1), (2, "a"): (1, 2)}


def _shuffled_rows(node):
    """Rows that the shuffles of a plan wrote, once it has run."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _shuffled_rows(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return _shuffled_rows(node.plan())
    own = node.metrics().get("shuffleRecordsWritten").get().value() if node.nodeName() == "Exchange" else 0
    return own + sum(_shuffled_rows(node.children().apply(k)) for k in range(node.children().size()))


def test_terms_of_a_single_row_are_not_shuffled(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(50)]
    counts = terms.term_counts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert len(counts.collect()) == 50 * 40
    assert _shuffled_rows(counts._jdf.queryExecution().executedPlan()) <= 2 * 50  # hashes of keys only


def test_terms_of_odd_texts_are_counted_alike_in_a_row_and_over_rows(spark, monkeypatch):
    texts = [
        None, "", " ", "\n", "a", " a", "a ", "a  a", "\n\na\r\n\x0b\f\tb", "a\nab\naba a ab", "w " * 5000 + "w", "É é e\u0301 İ ß ẞ",
        "\U0001f600 \U0001f600\U0001f600 \U0001f600", "\u0085 \u2028 \u00a0 a\u2028", "\\1 \\1 $1 ([^\\n]*\\n) .* .*", "\0 \0\0 \0", "x" * 5000 + " " + "x" * 5001,
        *(" ".join(random.Random(k).choices(["", "a", "aa", "A", "ab", "b"], k=99)) for k in range(20)),
    ]
    docs = spark.createDataFrame([*enumerate(texts), (None, "b b")], "doc_id long, text string")
    held = terms.term_counts(docs, "doc_id")
    alike = sorted((-1 if r.doc_id is None else r.doc_id, r.term, r.tf) for r in held.collect())
    monkeypatch.setattr(terms, "KEY_BUCKETS", 1)
    again = docs.unionByName(spark.createDataFrame([(99, None), (99, None)], docs.schema))  # a repeated key: all rows are in its bucket
    over = terms.term_counts(again, "doc_id")
    assert over.schema.simpleString() == held.schema.simpleString()
    assert alike == sorted((-1 if r.doc_id is None else r.doc_id, r.term, r.tf) for r in over.collect())
    words = [(i, w) for i, w in docs.select("doc_id", F.explode(tokens("text"))).collect()]
    assert alike == sorted((-1 if i is None else i, w, n) for (i, w), n in collections.Counter(words).items())


def test_columns_may_have_any_names(spark):
    rows = [(0, "bad awful"), (4, "good great"), (0, "awful sad"), (4, "love great")]
    posts = spark.createDataFrame(rows, "target int, text string")
    model = classify.fit(classify.classifier(), classify.training_view(posts))
    plain = classify.predict(model, posts)
    clash = posts.select("*", *[F.lit("x").alias(c) for c in ("words", "rawFeatures", "features", "prediction", "a.b")])
    got = classify.predict(model, clash)
    assert got.columns == ["target", "text", "words", "rawFeatures", "features", "a.b", "prediction"]
    assert got.select("target", "text", "prediction").collect() == plain.collect()
    unlabelled = classify.score(model, posts.select("text")).collect()
    assert [(r.label, r.prediction) for r in unlabelled] == [(None, r.prediction) for r in plain.collect()]


def test_label_index_reads_no_text(spark, plan, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(0, "a"), (4, "b")], "target int, text string").write.parquet(path)
    view = classify.training_view(spark.read.parquet(path))
    text = plan(view)
    assert "IsNotNull(target)" in text and "IsNotNull(text)" in text and "atleastnnonnulls" not in text.lower()
