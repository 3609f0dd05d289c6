"""Regulators, factor derivatives and the spread of a perturbation through factors and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.lineage import cut, if_small
from tessella.functions.scalars import modulator_group
from tessella.operators.spatial import received

#: Digits of a mean weight that decide ranks and cutoffs; the ones after them depend on the order of summation.
TIE_DIGITS = 9


def known_pairs(pairs: DataFrame, genes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Pairs with both sides among ``genes``; with ``targets``, for each target the pairs without it."""
    g = genes.select("gene").distinct()
    p = pairs.join(g.withColumnRenamed("gene", "ligand"), "ligand", "left_semi").join(g.withColumnRenamed("gene", "receptor"), "receptor", "left_semi")
    if targets is None:
        return p
    return targets.select("target").distinct().join(p, (F.col("ligand") != F.col("target")) & (F.col("receptor") != F.col("target")))


def regulators(links: DataFrame, genes: DataFrame, alpha: float) -> DataFrame:
    """Distinct (target, source) over clusters with p below ``alpha``, without self links, of known genes."""
    return links.where((F.col("p") < alpha) & (F.col("source") != F.col("target"))).join(genes.select(F.col("gene").alias("source")).distinct(), "source", "left_semi").select("target", "source").distinct()


def targets_of(links: DataFrame, genes: DataFrame, alpha: float) -> DataFrame:
    """Distinct (source, target) over clusters with p below ``alpha``, of known target genes."""
    return links.where(F.col("p") < alpha).join(genes.select(F.col("gene").alias("target")).distinct(), "target", "left_semi").select("source", "target").distinct()


def base_regulators(grn: DataFrame, genes: DataFrame) -> DataFrame:
    """(target, tf): candidates of a base network (target, tf, flag), the largest flag over its peaks above 0, both known, none its own."""
    known = genes.select("gene").distinct()
    best = grn.groupBy("target", "tf").agg(F.max("flag").alias("flag")).where("flag > 0 and tf <> target")
    return best.join(known.withColumnRenamed("gene", "tf"), "tf", "left_semi").join(known.withColumnRenamed("gene", "target"), "target", "left_semi").select("target", "tf")


def mask_by_links(betas: DataFrame, links: DataFrame, cells: DataFrame, alpha: float) -> DataFrame:
    """Coefficients of plain factors set to 0 where the cell's cluster has no link (p below ``alpha``); other groups stay."""
    have = links.where(F.col("p") < alpha).select("cluster", F.col("target"), F.col("source").alias("modulator")).distinct().withColumn("_h", F.lit(True))
    b = betas.join(cells.select("cell_id", "cluster"), "cell_id").join(have, ["cluster", "target", "modulator"], "left")
    keep = (modulator_group(F.col("modulator")) != "tf") | F.col("_h")
    return b.select("target", "cell_id", "modulator", F.when(keep, F.col("beta")).otherwise(0.0).alias("beta"))


def best_coaccess(peaks: DataFrame, tss: DataFrame) -> DataFrame:
    """Largest coaccess of each (peak, gene) over linked peaks (peak1, peak2, coaccess) and the gene's own peaks (peak, gene), which count as 1."""
    linked = peaks.join(tss.withColumnRenamed("peak", "peak1"), "peak1").select(F.col("peak2").alias("peak"), "gene", "coaccess")
    own = tss.select("peak", "gene", F.lit(1.0).alias("coaccess"))
    return linked.unionByName(own).groupBy("peak", "gene").agg(F.max("coaccess").alias("coaccess")).where("coaccess > 0")


def pair_members(members: DataFrame) -> DataFrame:
    """Metabolites of each unordered pair, in order."""
    return members.groupBy(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).agg(F.array_join(F.array_sort(F.collect_set("metabolite")), "|").alias("metabolites"), F.count_distinct("metabolite").alias("n"))


def typed_pairs(pairs: DataFrame, present: DataFrame) -> DataFrame:
    """(ct1, ct2, g1, g2) of the pairs whose genes are present in the types; present: (cell_type, gene)."""
    one = present.select(F.col("cell_type").alias("ct1"), F.col("gene").alias("g1"))
    two = present.select(F.col("cell_type").alias("ct2"), F.col("gene").alias("g2"))
    return pairs.join(one, "g1").join(two, "g2").select("ct1", "ct2", "g1", "g2")


def transporter_pairs(roles: DataFrame, ordered: bool = False) -> DataFrame:
    """Pairs of genes (metabolite, gene, role) of a metabolite, each with itself too, in name order, or both orders if ``ordered``.

    Two exporters or two importers (role 1 or -1) make no pair.
    """
    a = roles.select("metabolite", F.col("gene").alias("g1"), F.col("role").alias("r1"))
    b = roles.select("metabolite", F.col("gene").alias("g2"), F.col("role").alias("r2"))
    same = (F.col("r1") == F.col("r2")) & F.col("r1").isin(1, -1)
    pairs = a.join(b, "metabolite").where(~same)
    return (pairs if ordered else pairs.where("g1 <= g2")).select("metabolite", "g1", "g2").distinct()


def receptor_pairs(lr: DataFrame, ordered: bool = False) -> DataFrame:
    """(metabolite, g1, g2) of ligands and receptors (name, ligand, receptor), both orders if ``ordered``."""
    one = lr.where("ligand is not null and receptor is not null").select(F.col("name").alias("metabolite"), F.col("ligand").alias("g1"), F.col("receptor").alias("g2"))
    return (one.union(one.select("metabolite", "g2", "g1")) if ordered else one).distinct()


def motif_table(hits: DataFrame, motifs: DataFrame) -> DataFrame:
    """Distinct (peak, tf): hits (peak, motif) by the factors of each motif (motif, tfs array)."""
    return hits.select("peak", "motif").distinct().join(motifs.select("motif", F.explode("tfs").alias("tf")), "motif").select("peak", "tf").distinct()


def peak_targets(table: DataFrame, tss: DataFrame) -> DataFrame:
    """(target, tfs): factors of each gene over its peaks (peak, gene), sorted."""
    return table.join(tss, "peak").groupBy(F.col("gene").alias("target")).agg(F.array_sort(F.collect_set("tf")).alias("tfs"))


def inverse_lists(lists: DataFrame, key: str, member: str, out: str) -> DataFrame:
    """The lists of keys of each member: (key, member array) turned round."""
    return lists.select(key, F.explode(member).alias("_m")).groupBy(F.col("_m").alias(member)).agg(F.array_sort(F.collect_set(key)).alias(out))


def motif_hits(hits: DataFrame, threshold: float, summed: bool = False) -> DataFrame:
    """Hits (peak, motif, score) of at least ``threshold``; ``summed`` holds it against the sum of a motif in a peak."""
    if not summed:
        return hits.where(F.col("score") >= threshold)
    return hits.groupBy("peak", "motif").agg(F.sum("score").alias("score")).where(F.col("score") >= threshold)


def top_ligands(weights: DataFrame, cutoff: float, k: int = 5, feedback: DataFrame | None = None) -> DataFrame:
    """The k heaviest (tf, ligand, weight) of each tf, then those above ``cutoff``, without the pairs of ``feedback`` (tf, ligand).

    Nothing moves up into a place that cutoff or feedback empty.  Weights count to nine digits, so that means that are equal but for
    the order of their summation are ties.
    """
    w = F.round("weight", TIE_DIGITS)
    order = Window.partitionBy("tf").orderBy(w.desc(), "ligand")
    top = weights.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (w > cutoff))
    return top if feedback is None else top.join(feedback, ["tf", "ligand"], "left_anti")


def top_then_back_fill(weights: DataFrame, cutoff: float, k: int, without: Column | None = None) -> DataFrame:
    """The k heaviest (tf, ligand, weight) of each tf after cutoff and exclusion, so that others take excluded places."""
    weight = F.round("weight", TIE_DIGITS)
    w = weights.where(weight > cutoff)
    w = w.where(~without) if without is not None else w
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("tf").orderBy(weight.desc(), "ligand"))).where(F.col("rank") <= k)


def interface_counts(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per unordered pair the number of type pairs where it is significant, and its largest score there."""
    s = scores.where((F.col("fdr") < alpha) & (F.col("c") > 0))
    return s.groupBy(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).agg(F.count_distinct("ct1", "ct2").alias("n_sig"), F.max("c").alias("c_max"))


def splash(betas: DataFrame, expr: DataFrame, got: DataFrame, scale: float = 1.0, cap: float | None = None, allowed: DataFrame | None = None, zero_tf: bool = False) -> DataFrame:
    """(target, cell_id, gene, d): derivative of each target by each gene, from its factors' coefficients.

    A factor of ligand and receptor adds beta times received ligand to the receptor, where that is expressed, and beta times the
    receptor to the ligand; ligand and regulator likewise, expressed or not; a plain factor its beta, unscaled.  One pass over the
    coefficients makes both sides of a factor.  Metabolites and the intercept have no part.  ``allowed`` (target, source) keeps only
    these plain factors; ``zero_tf`` drops all of them.
    """
    if allowed is not None or zero_tf:
        plain = modulator_group(F.col("modulator")) == "tf"
        kept = betas.where(plain & (F.col("modulator") != "(intercept)"))
        kept = kept.limit(0) if zero_tf else kept.join(allowed.select("target", F.col("source").alias("modulator")).distinct(), ["target", "modulator"], "left_semi")
        betas = betas.where(~plain).unionByName(kept.select(*betas.columns))
    part = F.split("modulator", "[$#]", 2)
    b = betas.withColumn("_grp", modulator_group(F.col("modulator"))).where("_grp <> 'metab' and modulator <> '(intercept)'").select("target", "cell_id", "beta", "_grp", part[0].alias("_l"), F.get(part, F.lit(1)).alias("_r"))
    b = b.join(expr.select("cell_id", F.col("gene").alias("_r"), F.col("value").alias("_x")), ["cell_id", "_r"], "left")
    b = b.join(got.select("cell_id", F.col("gene").alias("_l"), F.col("value").alias("_w")), ["cell_id", "_l"], "left").fillna(0.0, ["_x", "_w"])
    entry = lambda gene, d: F.struct(F.col(gene).alias("gene"), d.alias("d"))
    lig = entry("_l", F.col("beta") * F.col("_x") * scale)
    reg = entry("_r", F.when((F.col("_grp") == "ltf") | (F.col("_x") > 0), F.col("beta") * F.col("_w") * scale).otherwise(0.0))
    rows = F.when(F.col("_grp") == "tf", F.array(entry("_l", F.col("beta").cast("double")))).otherwise(F.array(lig, reg))
    d = b.select("target", "cell_id", F.explode(rows).alias("e")).groupBy("target", "cell_id", "e.gene").agg(F.sum("e.d").alias("d"))
    return d if cap is None else d.withColumn("d", F.least(F.greatest("d", F.lit(-cap)), F.lit(cap)))


def perturb(expr: DataFrame, cells: DataFrame, betas: DataFrame, levels: DataFrame, radius: float, hops: int = 4, scale: float = 1.0, cap: float | None = None, mask: DataFrame | None = None, deltas: str | None = None) -> DataFrame:
    """(cell_id, gene, value) after setting ``levels`` (cell_id, gene, level) and letting the change spread ``hops`` times.

    Each hop takes derivatives at the state before it, replaces the change of a ligand by the change of what is received of it, sums
    over each target's factors, restores the given changes and keeps values between 0 and the gene's largest one.  A gene
    without coefficients does not change.  Every hop is checkpointed, so plans stay short and lost executors cost one hop; expression,
    coefficients and given changes, which every hop reads several times, are written once.  With
    ``mask`` (cell_id, gene) only entries in it are sent; with ``deltas``, a folder, each hop's change is written there as hop=k.
    """
    n = cells.count()
    expr, betas, levels = cut(expr), cut(betas), cut(levels)
    ligands = if_small(betas.where(modulator_group(F.col("modulator")).isin("lr", "ltf")).select(F.split("modulator", "[$#]")[0].alias("gene")).distinct())
    sent = lambda x: x if mask is None else x.join(mask, ["cell_id", "gene"], "left_semi")
    take = lambda x: received(cells, sent(x).join(ligands, "gene", "left_semi"), radius, n, scale)
    plus = lambda x, y: x.unionByName(y).groupBy("cell_id", "gene").agg(F.sum("value").alias("value"))
    minus = lambda x: x.select("cell_id", "gene", (-F.col("value")).alias("value"))
    given = cut(levels.join(expr, ["cell_id", "gene"], "left").select("cell_id", "gene", (F.col("level") - F.coalesce("value", F.lit(0.0))).alias("value")).where("value <> 0"))
    most = if_small(expr.groupBy("gene").agg(F.max("value").alias("_max")))  # a row a gene
    got0 = got = cut(take(expr))
    now, delta = expr, given
    for hop in range(hops):
        slopes = splash(betas, now, got, cap=cap)
        now = cut(plus(expr, delta))
        got = cut(take(now))
        step = delta.join(ligands, "gene", "left_anti").unionByName(plus(got, minus(got0)))
        moved = slopes.withColumnRenamed("d", "_s").join(step, ["cell_id", "gene"]).groupBy("cell_id", F.col("target").alias("gene")).agg(F.sum(F.col("_s") * F.col("value")).alias("value"))
        kept = moved.join(given, ["cell_id", "gene"], "left_anti").unionByName(given)
        at = kept.join(expr.withColumnRenamed("value", "_x"), ["cell_id", "gene"], "left").join(most, "gene", "left").fillna(0.0, ["_x", "_max"])
        x = F.least(F.greatest(F.col("_x") + F.col("value"), F.lit(0.0)), F.col("_max"))
        delta = cut(at.select("cell_id", "gene", (x - F.col("_x")).alias("value")))
        if deltas is not None:
            delta.write.mode("overwrite").parquet(f"{deltas}/hop={hop + 1}")
    forced = levels.select("cell_id", "gene", F.col("level").alias("value"))
    return plus(expr, delta).join(levels, ["cell_id", "gene"], "left_anti").unionByName(forced)


def mean_splash(betas: DataFrame, cells: DataFrame, expr: DataFrame, got: DataFrame, scale: float = 1.0) -> DataFrame:
    """``splash`` with each modulator's mean coefficient over the cells that have it, in every cell."""
    mean = betas.groupBy("target", "modulator").agg(F.avg("beta").alias("beta"))
    return splash(cells.select("cell_id").crossJoin(if_small(mean)), expr, got, scale)  # a table of coefficients


def masked_perturb(expr: DataFrame, cells: DataFrame, betas: DataFrame, levels: DataFrame, mask: DataFrame, radius: float, **kw) -> DataFrame:
    """``perturb`` where a cell sends a gene only if (cell_id, gene) is in ``mask``."""
    return perturb(expr, cells, betas, levels, radius, mask=mask, **kw)
