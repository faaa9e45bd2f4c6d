"""Clusters of short texts over hashed TF-IDF vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf_clusters(rows: DataFrame, tokens, k: int, features: int = 4096, seed: int = 7) -> DataFrame:
    """``rows`` with ``cluster``: k-means by cosine distance."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF

    stages = [HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_v", minDocFreq=2), KMeans(k=k, featuresCol="_v", predictionCol="cluster", distanceMeasure="cosine", seed=seed, maxIter=10)]
    with_tokens = rows.withColumn("_tokens", tokens).where(F.size("_tokens") > 0)
    return Pipeline(stages=stages).fit(with_tokens).transform(with_tokens).drop("_tokens", "_tf", "_v")
