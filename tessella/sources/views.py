"""The domain's tables projected from the test tables, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"), F.col("c_nationkey").alias("sample"), ((F.col("c_custkey") * 7919) % 10007 / F.lit(10.0)).alias("x"), ((F.col("c_custkey") * 104729) % 9973 / F.lit(10.0)).alias("y"))


def expr(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def lr(spark: SparkSession, d: str) -> DataFrame:
    """Each gene paired with the next one in name order, as ligand and receptor."""
    g = table(spark, d, "part").select(F.col("p_brand").alias("ligand")).distinct()
    from pyspark.sql import Window

    w = Window.orderBy("ligand")  # a few dozen gene names
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return g.select("ligand", F.coalesce(F.lead("ligand").over(w), F.first("ligand").over(whole)).alias("receptor"), F.row_number().over(w).cast("long").alias("ord"))


def half_away(x: Column, digits: int) -> Column:
    """``x`` rounded as SQL's engine does: the product with a power of ten is, not the shortest decimal that ``x`` is written as."""
    return F.round(x * 10.0**digits) / 10.0**digits


def links(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, source, target, coef_mean, p): brands of parts that follow one another."""
    p = table(spark, d, "part")
    mean = F.sum(F.col("p_retailprice").cast("decimal(28,10)")).cast("double") / F.count("p_retailprice")  # whatever the order of its rows
    return p.groupBy(F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("cluster"), F.col("p_brand").alias("source"), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 50).cast("string")).alias("target")).agg(half_away(mean / 1000 - 1.2, 6).alias("coef_mean"), F.round(F.min(F.col("p_partkey") % 1000) / 1000, 6).alias("p"))


def betas(spark: SparkSession, d: str) -> DataFrame:
    """(target, cell_id, modulator, beta): one row per cell and gene."""
    names = ["Brand#1", "Brand#2$Brand#3", "Brand#4#Brand#5", "metab@Glucose"]
    k = F.col("cell_id") % 4
    name = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return expr(spark, d).select(F.col("gene").alias("target"), "cell_id", name.alias("modulator"), (F.col("value") / 10 - 5).alias("beta"))


#: The same tables as common table expressions.
SQL = {
    "cells": "cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, c_nationkey AS sample, ((c_custkey * 7919) % 10007) / 10.0e0 AS x, ((c_custkey * 104729) % 9973) / 10.0e0 AS y FROM customer)",
    "expr": "expr AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "lr": "lr AS (SELECT ligand, coalesce(lead(ligand) OVER (ORDER BY ligand), (SELECT min(p_brand) FROM part)) AS receptor, row_number() OVER (ORDER BY ligand) AS ord FROM (SELECT DISTINCT p_brand AS ligand FROM part) g)",
    "links": "links AS (SELECT 'c' || CAST(p_size % 3 AS VARCHAR) AS cluster, p_brand AS source, 'Brand#' || CAST(p_partkey % 50 AS VARCHAR) AS target, round(avg(p_retailprice) / 1000 - 1.2e0, 6) AS coef_mean, round(min(p_partkey % 1000) / 1000.0e0, 6) AS p FROM part GROUP BY 1, 2, 3)",
    "betas": "betas AS (SELECT gene AS target, cell_id, CASE cell_id % 4 WHEN 0 THEN 'Brand#1' WHEN 1 THEN 'Brand#2$Brand#3' WHEN 2 THEN 'Brand#4#Brand#5' ELSE 'metab@Glucose' END AS modulator, value / 10 - 5 AS beta FROM expr)",
}


def with_views(*names: str) -> str:
    need = list(dict.fromkeys([*(["expr"] if "betas" in names else []), *names]))
    return "WITH " + ",\n".join(SQL[n] for n in need)
