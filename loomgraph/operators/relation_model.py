"""The relation classifier: a linear model over hashed words of the sentence and its two ends."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def marked_words(text: Column, head: Column, tail: Column) -> Column:
    """The words of a sentence, and its ends once more with their role, which stand in for markers in an encoder."""
    own = F.transform(T.words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.concat(F.lit("w:"), w))
    ends = F.array(F.concat(F.lit("h:"), F.coalesce(head, F.lit(""))), F.concat(F.lit("t:"), F.coalesce(tail, F.lit(""))))
    return F.concat(own, ends)


def fit(samples: DataFrame, *, label: str = "label", features: int = 1 << 12, rounds: int = 30, penalty: float = 1e-3, start: PipelineModel | None = None) -> PipelineModel:
    """Of samples (words, label). ``start`` gives the weighting of words of a model fitted elsewhere, as in a transfer to
    another domain; the classes' weights are always learned anew."""
    known = list(start.stages[:2]) if start else [HashingTF(inputCol="words", outputCol="counts", numFeatures=features), IDF(inputCol="counts", outputCol="features")]
    model = LogisticRegression(family="multinomial", labelCol=label, featuresCol="features", maxIter=rounds, regParam=penalty)
    return Pipeline(stages=[*known, model]).fit(samples.withColumn(label, F.col(label).cast("double")))


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """``samples`` with the predicted class ``y_pred``."""
    drop = ["counts", "features", "rawPrediction", "probability", "prediction"]
    return model.transform(samples).withColumn("y_pred", F.col("prediction").cast("int")).drop(*drop)


def scored_triples(predicted: DataFrame, codebook: DataFrame) -> DataFrame:
    """e1, r, e2, tag1, tag2, n of the predictions that are a relation (class 0 is none); codebook: y_pred, r."""
    found = predicted.where("y_pred <> 0").join(codebook, "y_pred")
    return found.groupBy("e1", "r", "e2", "tag1", "tag2").agg(F.count(F.lit(1)).alias("n"))


def without_persons(triples: DataFrame) -> DataFrame:
    """Those neither of whose ends is only a person's name by its part of speech."""
    return triples.where(~F.startswith("tag1", F.lit("nr")) & ~F.startswith("tag2", F.lit("nr")))
