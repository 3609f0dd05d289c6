"""Clusters of cells inside their types."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import cut


def niches(cells: DataFrame, most: int = 4, least_score: float = 0.5, seed: int = 0) -> DataFrame:
    """(cell_id, cell_type, niche): each type's cells (cell_id, cell_type, features array) in the 2 to ``most`` k-means clusters of best
    silhouette, or in one cluster where none scores above ``least_score``."""
    rows = cut(cells.select("cell_id", "cell_type", array_to_vector("features").alias("features")))
    out = None
    for name, n in sorted((r["cell_type"], r["count"]) for r in rows.where("cell_type is not null").groupBy("cell_type").count().collect()):
        mine = rows.where(F.col("cell_type") == name)
        best, score = mine.withColumn("niche", F.lit(0)), least_score
        for k in range(2, min(most, n - 1) + 1):
            made = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="niche").fit(mine).transform(mine)
            if made.select("niche").distinct().count() < 2:
                continue
            s = ClusteringEvaluator(featuresCol="features", predictionCol="niche").evaluate(made)
            if s > score:
                best, score = made, s
        one = best.select("cell_id", "cell_type", F.col("niche").cast("int").alias("niche"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else cells.select("cell_id", "cell_type", F.lit(0).alias("niche")).limit(0)
