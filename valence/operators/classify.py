"""Text classification with MLlib: words, hashed TF-IDF, logistic regression."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, StringIndexerModel, Tokenizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from valence.functions.labels import sentiment
from valence.sources.store import REJECTED, SCORED

# Fixed parameters of the model.
NUM_FEATURES = 20_000
MAX_ITER = 20


def training_view(posts: DataFrame, target: str = "target") -> DataFrame:
    """Label and text, without rows that lack one of them."""
    view = posts.select(F.col(target).alias("raw_label"), "text")
    # A test per column, so that each reaches the table that its column comes from.
    return view.filter(F.col("raw_label").isNotNull()).filter(F.col("text").isNotNull())


def label_indexer(order: str = "alphabetAsc") -> StringIndexer:
    """Label to class number.

    Classes are numbered in the order of their labels (0 before 4), so that class 0 is the
    negative one whatever the training rows. ``frequencyDesc`` gives 0 to the most common.
    """
    return StringIndexer(inputCol="raw_label", outputCol="label", stringOrderType=order)


def features(num_features: int = NUM_FEATURES) -> list:
    return [
        Tokenizer(inputCol="text", outputCol="words"),
        HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features),
        IDF(inputCol="rawFeatures", outputCol="features"),
    ]


def classifier(
    num_features: int = NUM_FEATURES,
    max_iter: int = MAX_ITER,
    label_order: str = "alphabetAsc",
) -> Pipeline:
    """The five stages, unfitted."""
    regression = LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=max_iter, aggregationDepth=3
    )
    return Pipeline(stages=[label_indexer(label_order), *features(num_features), regression])


def fit(classifier: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit the five stages, as ``classifier.fit(train)`` does, but read the texts only once.

    The hashed words are kept, on disk where memory is short, for the two stages that need
    them; otherwise each of those would go back to the texts and cut them up again.
    """
    indexer, tokenizer, hashing, idf, regression = classifier.getStages()
    labels = indexer.fit(train)
    words = tokenizer.transform(labels.transform(train))
    hashed = hashing.transform(words).select(
        regression.getLabelCol(), hashing.getOutputCol()
    )
    hashed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = idf.fit(hashed)
        fitted = regression.fit(weights.transform(hashed))
    finally:
        hashed.unpersist()
    return PipelineModel([labels, tokenizer, hashing, weights, fitted])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_version(model: PipelineModel, path: str) -> int:
    """Save a model as the next version below ``path``, and make it the current one. Returns its number.

    A version has a folder that is never written again, so whoever reads an older one goes on undisturbed. It
    becomes current by a mark that is set once the folder is complete; what was cut off is passed over.
    """
    spark = SparkSession.active()
    number = max([*_numbers(spark, path, "version-*"), *_numbers(spark, path, "current-*")], default=0) + 1
    model.save(f"{path}/version-{number}")
    mark, files = _files(spark, f"{path}/current-{number}")
    files.create(mark, False).close()
    return number


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version that is complete."""
    found = _numbers(spark, path, "current-*")
    if not found:
        raise ValueError(f"{path} has no complete version of a model")
    return max(found)


def load_version(path: str, number: int) -> PipelineModel:
    return load_model(f"{path}/version-{number}")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, pattern: str) -> list[int]:
    place, files = _files(spark, f"{path}/{pattern}")
    return [int(f.getPath().getName().rpartition("-")[2]) for f in files.globStatus(place) or []]


def scorer(model: PipelineModel) -> PipelineModel:
    """The part of a fitted model that scoring needs.

    Leaves out the label index, and asks the regression for the prediction alone rather
    than for raw scores and probabilities first.
    """
    stages = []
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            continue
        if isinstance(stage, LogisticRegressionModel):
            stage = stage.copy().setRawPredictionCol("").setProbabilityCol("")
        stages.append(stage)
    return PipelineModel(stages)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` to rows with a ``text``. Batch or stream.

    The model cannot take a missing text; such a row gets a missing prediction. Columns may have
    any names; an earlier ``prediction`` is replaced.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    scored = scorer(model).transform(rows.select(F.struct("*").alias("_row"), text))
    row = F.col("_row")
    known = F.when(row.getField("text").isNotNull(), F.col("prediction"))
    kept = [row.getField(c).alias(c) for c in rows.columns if c != "prediction"]
    return scored.select(*kept, known.alias("prediction"))


def score(
    model: PipelineModel, rows: DataFrame, names: tuple[str, str] = ("NEGATIVE", "POSITIVE")
) -> DataFrame:
    """Scored records: text, label, sentiment, prediction and all other columns of ``rows``.

    ``outcome`` tells scored records from rejected ones, which had no text to score. Rows
    without a column ``label`` get a missing one.
    """
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(None).cast("int"))
    outcome = F.when(F.col("text").isNull(), REJECTED).otherwise(SCORED)
    others = [c for c in rows.columns if c not in ("text", "label", "prediction")]
    return predict(model, rows).select(
        "text",
        "label",
        sentiment("prediction", *names).alias("sentiment"),
        "prediction",
        *others,
        outcome.alias("outcome"),
    )


def evaluate(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Accuracy and error, in percent, on rows of the training view.

    ``majority`` is what always answering the most common class would reach.
    """
    labelled = predict(model, model.stages[0].transform(rows))
    per_class = labelled.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("hits")
    )
    share = F.try_divide(F.sum("hits"), F.sum("n"))
    return per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        (share * 100).alias("accuracy"),
        ((1 - share) * 100).alias("error"),
        (F.try_divide(F.max("n"), F.sum("n")) * 100).alias("majority"),
    )
