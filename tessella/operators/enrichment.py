"""Which gene sets a list of genes holds more of than chance would give."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln(n!) for whole n of 0 or more, by Stirling's series from 9 on, with error below 1e-12."""
    z = n.cast("double") + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n.cast("double") + float(k))
    return series - F.log(product)


def _choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(k: Column, drawn: Column, marked: Column, every: Column) -> tuple[Column, Column]:
    """(upper tail, two-sided p) of k marked among ``drawn`` of ``every``, of which ``marked`` are; the two-sided p adds all outcomes that are no likelier."""
    one = lambda x: F.exp(_choose(marked, x) + _choose(every - marked, drawn - x) - _choose(every, drawn))
    total = lambda a, b, keep: F.aggregate(F.sequence(a, b), F.lit(0.0), lambda s, x: s + keep(one(x)))
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - every), F.least(drawn, marked)
    seen = one(k) * (1 + 1e-7)
    return F.least(F.lit(1.0), total(k, high, lambda p: p)), F.least(F.lit(1.0), total(low, high, lambda p: F.when(p <= seen, p).otherwise(0.0)))


def enrichment(lists: DataFrame, sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Per list and set that share a gene: sizes, p of that overlap or a larger one, the two-sided p, and both adjusted over all sets.

    lists: (query, gene); sets: (name, gene); universe: (gene).  Genes outside the universe and repeated rows do not count, nor do null
    genes.  Sets without a gene of the list have p 1 and no row, but count among the tests.  ``depleted`` tells overlaps below
    what is expected.  Overlaps come from a join by gene and are counted where they are made, so no list meets a set it shares nothing with.
    """
    known = universe.where("gene is not null").select("gene").distinct()
    a = lists.select("query", "gene").distinct().join(known, "gene", "left_semi")
    b = sets.select("name", "gene").distinct().join(known, "gene", "left_semi")
    size_a, size_b = a.groupBy("query").agg(F.count("*").alias("n_list")), b.groupBy("name").agg(F.count("*").alias("n_set"))
    every, tests = known.count(), size_b.count()
    met = a.join(b, "gene").groupBy("query", "name").agg(F.count("*").alias("n_both")).join(size_a, "query").join(size_b, "name")
    upper, both = hypergeometric(F.col("n_both"), F.col("n_list"), F.col("n_set"), F.lit(every).cast("long"))
    out = met.withColumn("n_all", F.lit(every).cast("long")).withColumn("p", upper).withColumn("p_two", both)
    out = out.withColumn("depleted", F.col("n_both") * F.col("n_all") < F.col("n_list") * F.col("n_set"))
    # one row a set that shares a gene: the windows of a list are as long as there are sets
    for p in ("p", "p_two"):
        up = Window.partitionBy("query").orderBy(F.round(p, 10), "name")
        ranked = out.withColumn("_q", F.col(p) * tests / F.row_number().over(up))
        out = ranked.withColumn(f"{p}_adjusted", F.least(F.lit(1.0), F.min("_q").over(up.rowsBetween(0, Window.unboundedFollowing)))).drop("_q")
    return out
