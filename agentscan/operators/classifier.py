"""A text classifier trained on the labels, judged on the documents that it didn't see."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentscan.sources.derived import read

FEATURES = 1 << 18


def model(train: DataFrame):
    """Hashed words, present or not, weighted by IDF, into a logistic regression that keeps few of them; fitted on (text, label)."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}\\p{N}]+"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES, binary=True),
            IDF(inputCol="tf", outputCol="features", minDocFreq=3),
            LogisticRegression(maxIter=25, regParam=0.01, elasticNetParam=1.0),
        ]
    ).fit(train)


def q_classifier(spark, sf_dir):
    """Every document's probability of being toxic, from labelled documents of four folds in five."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    fitted = model(labelled.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    out = fitted.transform(d)
    return out.select("doc_id", F.round(vector_to_array("probability")[1], 4).alias("toxic_probability"), F.col("prediction").cast("int").alias("prediction"))


QUERIES = {"classifier_scores": (q_classifier, None)}
