"""Made-up cells on a ring with coefficients that follow their angle, for tests of what a fit recovers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulate(spark: SparkSession, n: int, clusters: int = 3, regulators: int = 4, seed: int = 0, noise: float = 0.0) -> dict[str, DataFrame]:
    """cells (cell_id, cell_type, x, y), expr (cell_id, gene, value), betas (cell_id, modulator, beta) of ``n`` cells, made in parallel.

    Cells stand on a ring of thickness; regulator k's coefficient in cluster c is a sine of the angle with a phase of its own; the target
    is the sum of coefficients times regulators, rescaled to [0, 1] over all cells.
    """
    u = lambda *k: (F.pmod(F.xxhash64(F.lit(seed), "cell_id", *[F.lit(x) for x in k]), F.lit(1 << 40)) / float(1 << 40))
    cells = spark.range(n).withColumnRenamed("id", "cell_id")
    angle = 2 * math.pi * F.col("cell_id") / n
    cells = cells.withColumns({"angle": angle, "cell_type": F.concat(F.lit("c"), F.floor(F.col("cell_id") * clusters / n).cast("string")), "r": 90 + 20 * u("r")})
    cells = cells.withColumns({"x": F.col("r") * F.cos("angle"), "y": F.col("r") * F.sin("angle")})
    k = F.explode(F.sequence(F.lit(0), F.lit(regulators - 1))).alias("k")
    part = cells.select("cell_id", "angle", "cell_type", k)
    value = F.pmod(F.xxhash64(F.lit(seed), F.lit("x"), "cell_id", "k"), F.lit(1 << 40)) / float(1 << 40)
    phase = F.col("k") * math.pi / max(regulators, 1) + F.regexp_extract("cell_type", r"\d+", 0).cast("double")
    part = part.select("cell_id", F.concat(F.lit("R"), F.col("k").cast("string")).alias("gene"), value.alias("value"), F.sin(F.col("angle") + phase).alias("beta"))
    target = part.groupBy("cell_id").agg(F.sum(F.col("beta") * F.col("value")).alias("t"))
    target = target.withColumn("t", F.col("t") + noise * (u("e") - 0.5))
    lo, hi = target.agg(F.min("t"), F.max("t")).first()
    scaled = target.select("cell_id", F.lit("T").alias("gene"), ((F.col("t") - lo) / ((hi - lo) or 1.0)).alias("value"))
    return {"cells": cells.select("cell_id", "cell_type", "x", "y"), "expr": part.select("cell_id", "gene", "value").union(scaled), "betas": part.select("cell_id", F.col("gene").alias("modulator"), "beta")}
