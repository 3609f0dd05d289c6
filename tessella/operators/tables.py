"""Summaries, filters and rankings of expression, coefficient and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def beta_stats(betas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample standard deviation and count of coefficients; values that are not numbers are left out."""
    return betas.where(F.col("beta").isNotNull() & ~F.isnan("beta")).groupBy(*keys).agg(F.avg("beta").alias("mean"), F.stddev_samp("beta").alias("std"), F.count("*").alias("n"))


def interaction_summary(betas: DataFrame, keys: list[str], above: float = 0.0) -> DataFrame:
    """Mean, least, most, sum of coefficients of size over ``above``, without the intercept; positive and negative are means with values of
    the other sign as 0."""
    return betas.where((F.abs("beta") > above) & ~F.col("modulator").isin("(intercept)", "beta0")).groupBy(*keys).agg(F.avg("beta").alias("mean"), F.min("beta").alias("least"), F.max("beta").alias("most"), F.sum("beta").alias("total"), F.avg(F.greatest("beta", F.lit(0.0))).alias("positive"), F.avg(F.least("beta", F.lit(0.0))).alias("negative"))


def histogram(df: DataFrame, value: str, key: str, bins: int) -> DataFrame:
    """Counts in equal bins between each group's extremes, empty bins as 0; the last bin is closed."""
    lim = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = df.join(lim, key)
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    n = j.where(F.col(value).isNotNull()).groupBy(key, k.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = lim.where("lo is not null").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(n, [key, "bin"], "left").fillna(0, ["n"])


def receptor_filter(expr: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Genes whose largest mean over cell types, absent values as 0, is above the threshold."""
    size = cells.groupBy("cell_type").agg(F.count("*").alias("n"))
    mean = expr.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("gene", "cell_type").agg(F.sum("value").alias("s")).join(F.broadcast(size), "cell_type")
    return mean.groupBy("gene").agg(F.max(F.col("s") / F.col("n")).alias("top_mean")).where(F.col("top_mean") > threshold)


def frequent_genes(expr: DataFrame, n_cells: int, share: float) -> DataFrame:
    return expr.where("value > 0").groupBy("gene").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= share * n_cells)


def log_cpm(expr: DataFrame, scale: float = 1e6) -> DataFrame:
    """log1p of counts per million; depths that are not positive count as 1."""
    depth = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.col("value") / F.when(depth > 0, depth).otherwise(1.0) * scale))


def count_covariates(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"))


def filter_links(links: DataFrame, p: float, most: int, sources: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """Links with p at most ``p``, of the given sources and targets if any, the strongest ``most`` of each cluster."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.abs("coef_mean")), "source", "target")
    kept = links.where(F.col("p") <= p)
    kept = kept if sources is None else kept.where(F.col("source").isin(sources))
    kept = kept if targets is None else kept.where(F.col("target").isin(targets))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def drop_tiny(cells: DataFrame, least: int, most_share: float = 0.02) -> DataFrame:
    """Cells of types of at least ``least``; an error where the others are more than ``most_share`` of all cells."""
    size = cells.groupBy("cell_type").agg(F.count("*").alias("_n"))
    lost, n = size.agg(F.sum(F.when(F.col("_n") < least, F.col("_n")).otherwise(0)), F.sum("_n")).first()
    if n and lost > most_share * n:
        raise ValueError(f"types below {least} cells hold {lost} of {n} cells, more than {most_share:.0%}")
    return cells.join(F.broadcast(size.where(F.col("_n") >= least).select("cell_type")), "cell_type", "left_semi")  # types are few


def encode_labels(df: DataFrame, label: str, out: str) -> DataFrame:
    """Codes of the sorted distinct labels, from 0; the labels are few and are numbered apart from the rows."""
    codes = df.select(label).distinct().withColumn(out, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(codes, label)


def min_max(df: DataFrame, value: str, key: str) -> DataFrame:
    lim = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(lim, key).withColumn(value, scaled).drop("_lo", "_hi")


def top_per_key(df: DataFrame, key: str, value: str, k: int, ties: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), *ties))).where(F.col("rank") <= k)


def network_entropy(links: DataFrame) -> DataFrame:
    """Entropy of the shares of absolute weights of each target's links, over the log of their number."""
    w = links.withColumn("w", F.abs("coef_mean")).where("w > 0")
    share = F.col("w") / F.sum("w").over(Window.partitionBy("cluster", "target"))
    return w.withColumn("s", share).groupBy("cluster", "target").agg((-F.sum(F.col("s") * F.log("s"))).alias("h"), F.count("*").alias("k")).select("cluster", "target", F.when(F.col("k") > 1, F.col("h") / F.log(F.col("k").cast("double"))).otherwise(0.0).alias("entropy"), "k")


def network_degree(links: DataFrame) -> DataFrame:
    ends = links.select("cluster", F.explode(F.array(F.struct(F.col("source").alias("gene"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("gene"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    n = ends.groupBy("cluster").agg(F.countDistinct("e.gene").alias("nodes"))
    d = ends.groupBy("cluster", "e.gene").agg(F.sum("e.o").alias("degree_out"), F.sum("e.i").alias("degree_in"))
    return d.join(n, "cluster").select("cluster", "gene", "degree_out", "degree_in", (F.col("degree_out") + F.col("degree_in")).alias("degree_all"), ((F.col("degree_out") + F.col("degree_in")) / F.greatest(F.col("nodes") - 1, F.lit(1))).alias("centrality"))


def correlate(expr: DataFrame, n_cells: int, pairs: DataFrame) -> DataFrame:
    """Pearson correlation of gene pairs over all cells from sparse sums, absent values as 0; without spread it is 0."""
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    xy = pairs.join(expr.select("cell_id", F.col("gene").alias("g1"), F.col("value").alias("v1")), "g1").join(expr.select("cell_id", F.col("gene").alias("g2"), F.col("value").alias("v2")), ["cell_id", "g2"]).groupBy("g1", "g2").agg(F.sum(F.col("v1") * F.col("v2")).alias("xy"))
    j = pairs.join(xy, ["g1", "g2"], "left").join(s.toDF("g1", "s1", "q1"), "g1").join(s.toDF("g2", "s2", "q2"), "g2")
    top = n_cells * F.coalesce("xy", F.lit(0.0)) - F.col("s1") * F.col("s2")
    low = F.sqrt((n_cells * F.col("q1") - F.col("s1") * F.col("s1")) * (n_cells * F.col("q2") - F.col("s2") * F.col("s2")))
    return j.select("g1", "g2", F.when(low > 0, top / low).otherwise(0.0).alias("r"))


def merge_equal_sets(pairs: DataFrame) -> DataFrame:
    """Entities (name, g1, g2, ord) with equal sets of unordered pairs merged; names are joined by '|' in the order of first sight.

    Without a column ``ord`` names are in name order.
    """
    seen = F.min("ord") if "ord" in pairs.columns else F.lit(0)
    sets = pairs.groupBy("name").agg(F.array_sort(F.collect_set(F.array_sort(F.array("g1", "g2")))).alias("pairs"), seen.alias("_o"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("_o", "name"))), lambda x: x["name"])
    return sets.groupBy("pairs").agg(F.array_join(names, "|").alias("name"))
