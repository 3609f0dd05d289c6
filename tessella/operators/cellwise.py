"""Scores of single cells and their summaries over neighbourhoods, signatures and metabolites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def metabolite_scores(scores: DataFrame, members: DataFrame, keys: list[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """Sum of the pair scores of each metabolite; members: (metabolite, g1, g2).

    With ``allowed`` (ct1, ct2, g1, g2) a pair counts only between the types that it is tested for.
    """
    scores = scores if allowed is None else scores.join(allowed.select("ct1", "ct2", "g1", "g2").distinct(), ["ct1", "ct2", "g1", "g2"], "left_semi")
    return scores.join(members, ["g1", "g2"]).groupBy(*keys, "metabolite").agg(F.sum("c").alias("c"))


def normalised_scores(scores: DataFrame, largest: DataFrame) -> DataFrame:
    """Scores over the largest score that the first gene can reach with itself; division by 0 gives 1."""
    m = largest.select(F.col("gene").alias("g1"), "max_score")
    return scores.join(m, "g1", "left").withColumn("c_norm", F.when(F.coalesce("max_score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("c") / F.col("max_score"))).drop("max_score")


def summarise_neighbourhoods(scores: DataFrame, cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per cell type and entity, from dense (cell_id, entity, cs, p, fdr): share and mean of significant scores and enrichment.

    An enrichment without significant cells in the type is minus infinity, and null where no cell of any type is significant.
    """
    sig = (F.col("fdr") < alpha) & (F.col("cs") > 0)
    s = scores.withColumn("_sig", sig.cast("int"))
    every = s.groupBy("entity").agg(F.avg("_sig").alias("_all"))
    g = s.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "entity").agg(
        F.count("*").alias("n_cells"), F.avg("_sig").alias("frac_sig"), F.avg("cs").alias("mean_cs"), F.avg(F.when(F.col("_sig") == 1, F.col("cs"))).alias("mean_cs_sig"), F.avg(-F.log10("p")).alias("mean_neg_log10_pval")
    )
    share = F.when((F.col("frac_sig") > 0) & (F.col("_all") > 0), F.log2(F.col("frac_sig") / F.col("_all"))).when(F.col("_all") > 0, F.lit(float("-inf")))
    return g.join(every, "entity").withColumn("log2_enrichment", share).drop("_all")


def flux(received: DataFrame, expr: DataFrame, members: DataFrame) -> DataFrame:
    """Received export times own import, summed over a metabolite's pairs (metabolite, g1 exported, g2 imported)."""
    r = received.select("cell_id", F.col("gene").alias("g1"), F.col("value").alias("_r"))
    e = expr.select("cell_id", F.col("gene").alias("g2"), F.col("value").alias("_e"))
    return r.join(members, "g1").join(e, ["cell_id", "g2"]).groupBy("cell_id", "metabolite").agg(F.sum(F.col("_r") * F.col("_e")).alias("value"))


def signature_scores(expr: DataFrame, sets: DataFrame, cells: DataFrame) -> DataFrame:
    """Sum of up genes less sum of down genes for every cell and set (name, gene, sign); repeated members count once."""
    s = expr.join(sets.select("name", "gene", "sign").distinct(), "gene").groupBy("cell_id", "name").agg(F.sum(F.col("sign") * F.col("value")).alias("score"))
    every = cells.select("cell_id").crossJoin(F.broadcast(sets.select("name").distinct()))  # sets are few
    return every.join(s, ["cell_id", "name"], "left").fillna(0.0, ["score"])


def settle_overlap(sets: DataFrame, factors: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Signature members (name, gene, sign) and factors (name, factor, pos) after genes on both sides are settled.

    ``keep`` "target": factors that refer to a member go; "factor": such members go; "both": all stay.
    """
    from tessella.functions.scalars import factor_genes

    if keep not in ("target", "factor", "both"):
        raise ValueError('keep must be "target", "factor" or "both"')
    if keep == "both":
        return sets, factors
    named = factors.select("name", "factor", F.explode(factor_genes(F.col("factor"))).alias("gene")).join(sets.select("name", "gene").distinct(), ["name", "gene"])
    if keep == "target":
        return sets, factors.join(named.select("name", "factor").distinct(), ["name", "factor"], "left_anti")
    return sets.join(named.select("name", "gene").distinct(), ["name", "gene"], "left_anti"), factors


def knockout_impact(deltas: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean change per type, its size, then the mean over genes, per knockout; deltas: (ko, cell_id, gene, d), absent ones are 0."""
    size = cells.groupBy("cell_type").agg(F.count("*").alias("_n"))
    genes = deltas.select("gene").distinct().count()
    m = deltas.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("ko", "cell_type", "gene").agg(F.sum("d").alias("_s")).join(F.broadcast(size), "cell_type")
    return m.groupBy("ko", "cell_type").agg((F.sum(F.abs(F.col("_s") / F.col("_n"))) / genes).alias("impact"))


def subsample_impact(parts: list[DataFrame], cells: DataFrame) -> DataFrame:
    """``knockout_impact`` over the outputs of disjoint subsamples, put together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return knockout_impact(out, cells)


def expression_mask(expr: DataFrame, thresholds: DataFrame, least: float = 1e-9) -> DataFrame:
    """Values above ``least`` of (cell_id, gene) whose threshold is positive; a gene without a threshold is masked."""
    return expr.where(F.col("value") > least).join(thresholds.where("threshold > 0").select("cell_id", "gene"), ["cell_id", "gene"], "left_semi")


def centre_cells(cells: DataFrame) -> DataFrame:
    """The cell nearest to the centroid of each type, ties to the smaller id."""
    c = cells.groupBy("cell_type").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d2 = (F.col("x") - F.col("_cx")) * (F.col("x") - F.col("_cx")) + (F.col("y") - F.col("_cy")) * (F.col("y") - F.col("_cy"))
    return cells.join(F.broadcast(c), "cell_type").groupBy("cell_type").agg(F.min_by("cell_id", F.struct(d2.alias("d"), F.col("cell_id"))).alias("cell_id"))
