"""Standardisation, rank tests and summaries over replicates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.lineage import if_small
from tessella.functions.scalars import normal_sf
from tessella.functions.tails import student_p
from tessella.operators.communication import benjamini_hochberg

#: Genes whose two numbers are fitted together.
MOST_GENES = 200_000


def standardise_counts(expr: DataFrame, cells: DataFrame, group: str | None = None, eps: float = 1e-10) -> DataFrame:
    """(cell_id, gene, z) of every cell and gene: counts against a negative binomial whose mean follows depth, within ``group``.

    Zeros have a z of their own, so the result is dense; sums come from the sparse rows alone.  A cell without depth or a gene
    without counts in the group has z 0.
    """
    by = [group] if group else []
    at = cells.select("cell_id", *by).join(expr.groupBy("cell_id").agg(F.sum("value").alias("u")), "cell_id", "left").fillna(0.0, ["u"])
    total = at.groupBy(*by).agg(F.sum("u").alias("total"), F.sum(F.col("u") * F.col("u")).alias("u2"), F.count("*").cast("double").alias("n"))
    x = expr.join(at, "cell_id")
    sums = x.groupBy("gene", *by).agg(F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("q"), F.sum(F.col("value") * F.col("u")).alias("xu"))
    sums = sums.join(F.broadcast(total), by) if by else sums.crossJoin(F.broadcast(total))
    t, u2, all_u = F.col("t"), F.col("u2"), F.col("total")
    # sum over cells of (x - mu)^2, with mu = t u / total
    spread = F.col("q") - 2 * t / all_u * F.col("xu") + t * t / (all_u * all_u) * u2
    size = (t * t / all_u) * u2 / all_u / (spread - t + eps)
    sums = sums.select("gene", *by, "t", "total", F.greatest(F.when(size < 0, 1e9).otherwise(size), F.lit(eps)).alias("size"))
    # every cell meets every gene of its group, which is the result's own size; the genes' table is sent round if it is small
    sums = if_small(sums)
    dense = at.join(sums, by) if by else at.crossJoin(sums)
    dense = dense.join(expr.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left")
    mu = F.col("t") * F.col("u") / F.col("total")
    z = (F.coalesce("value", F.lit(0.0)) - mu) / F.sqrt(mu * (1 + mu / F.col("size")))
    return dense.select("cell_id", "gene", F.when(mu > 0, z).otherwise(0.0).alias("z"))


def rank_sums(expr: DataFrame, cells: DataFrame, one: Column) -> DataFrame:
    """Per gene: group sizes, rank sum of group ``one`` with ties averaged, tie term, sums and squares of both groups.

    Values are 0 or more, and absent ones are 0, whose shared rank has a closed form.  Rows are counted by value first, so a
    window sorts a gene's distinct values, not its cells.  Group sizes are doubles, as their products exceed the integers.
    """
    n, n1 = cells.agg(F.count("*"), F.count_if(one)).first()
    v = expr.where("value > 0").join(cells.select("cell_id", F.coalesce(one, F.lit(False)).cast("int").alias("_g")), "cell_id")
    by = v.groupBy("gene", "value").agg(F.count("*").alias("m"), F.sum("_g").alias("m1"))
    gene = Window.partitionBy("gene")
    before = F.coalesce(F.sum("m").over(gene.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("rank", n - F.sum("m").over(gene) + before + (F.col("m") + 1) / 2)
    m, m1, x = F.col("m").cast("double"), F.col("m1"), F.col("value")
    g = by.groupBy("gene").agg(F.sum(m1 * F.col("rank")).alias("r"), F.sum("m").alias("k"), F.sum("m1").alias("k1"), F.sum(m * m * m - m).alias("t"), F.sum(x * m1).alias("s1"), F.sum(x * x * m1).alias("q1"), F.sum(x * m).alias("s"), F.sum(x * x * m).alias("q"))
    n0 = (n - F.col("k")).cast("double")
    return g.select("gene", F.lit(float(n1)).alias("n1"), F.lit(float(n - n1)).alias("n2"), (F.col("r") + (n1 - F.col("k1")) * (n0 + 1) / 2).alias("r1"), (F.col("t") + n0 * n0 * n0 - n0).alias("ties"), "s1", "q1", (F.col("s") - F.col("s1")).alias("s2"), (F.col("q") - F.col("q1")).alias("q2"))


def rank_sum_degs(expr: DataFrame, cells: DataFrame, one: Column) -> DataFrame:
    """Rank-sum test of each gene between a group and the rest, on log values: log2fc, score and two-sided p."""
    r = rank_sums(expr, cells, one)
    n1, n2 = F.col("n1"), F.col("n2")
    z = (F.col("r1") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    ratio = (F.expm1(F.col("s1") / n1) + 1e-9) / (F.expm1(F.col("s2") / n2) + 1e-9)
    return r.select("gene", F.log2(ratio).alias("log2fc"), z.alias("score")).withColumn("p", F.least(F.lit(1.0), 2 * normal_sf(F.abs("score"))))


def mann_whitney_greater(expr: DataFrame, cells: DataFrame, one: Column) -> DataFrame:
    """z (ties and continuity corrected) and upper tail of the U statistic of a group, and Cohen's d (0 without spread)."""
    r = rank_sums(expr, cells, one)
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.col("r1") - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sd
    squares = F.col("q1") - F.col("s1") * F.col("s1") / n1 + F.col("q2") - F.col("s2") * F.col("s2") / n2
    pooled = F.sqrt(squares / (n - 2))
    out = r.select("gene", F.when(sd > 0, z).otherwise(0.0).alias("z"), F.when(pooled > 0, (F.col("s1") / n1 - F.col("s2") / n2) / pooled).otherwise(0.0).alias("d"))
    return out.withColumn("p", normal_sf(F.col("z")))


def combine_degs(degs: DataFrame, n_batches: int, sign_share: float = 0.7, sig_share: float = 0.7, alpha: float = 0.05) -> DataFrame:
    """Genes that agree over batches (batch, gene, log2fc, score, pval, pval_adj), with Fisher's combined p.

    The chi-squared tail has an even number of degrees of freedom and is summed in closed form; a missing p counts as 1.
    """
    n = F.count("log2fc")
    g = degs.groupBy("gene").agg(
        F.avg("log2fc").alias("log2fc"), F.avg("score").alias("score"), n.alias("n_batches"), F.count_if(F.col("pval_adj") < alpha).alias("n_batches_sig"),
        (F.greatest(F.count_if(F.col("log2fc") > 0), F.count_if(F.col("log2fc") < 0)) / F.when(n > 0, n)).alias("sign_consistency"),
        F.sum(-F.log(F.least(F.greatest(F.coalesce("pval", F.lit(1.0)), F.lit(1e-300)), F.lit(1.0)))).alias("_x"),
    )
    terms = sum(((F.pow(F.col("_x"), F.lit(i)) / math.factorial(i)) for i in range(1, n_batches)), F.lit(1.0))
    kept = g.where((F.col("sign_consistency") >= sign_share) & (F.col("n_batches_sig") >= sig_share * n_batches))
    return kept.withColumn("pval", F.least(F.lit(1.0), F.exp(-F.col("_x")) * terms)).drop("_x")


def variation_fit(expr: DataFrame, n_cells: int) -> DataFrame:
    """log2 of the mean and of the coefficient of variation (sample deviation) per gene over all cells, absent values as 0."""
    g = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") > 0).alias("detected"))
    mean, var = F.col("s") / n_cells, (F.col("q") - F.col("s") * F.col("s") / n_cells) / (n_cells - 1)
    return g.where("s > 0").select("gene", "detected", F.log2(mean).alias("log_mean"), F.log2(F.sqrt(var) / mean).alias("log_cv"))


def interval_stats(samples: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.05, 0.95)) -> DataFrame:
    """Least, most, mean, population variance, squared mean, mean square and percentiles over replicates."""
    v = F.col(value)
    return samples.groupBy(*keys).agg(F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.pow(F.avg(v), F.lit(2)).alias("mean_sq"), F.avg(v * v).alias("msd"), *[F.percentile(v, p).alias(f"p{round(p * 100)}") for p in points])


def penalty_path(path: DataFrame, keys: list[str]) -> DataFrame:
    """Least, most, sign changes over rising penalty (zeros skipped), share of zeros and sign stability of (penalty, beta)."""
    w = Window.partitionBy(*keys).orderBy("penalty")
    s = F.signum("beta")
    last = F.last(F.when(s != 0, s), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flips = path.withColumn("_f", ((s != 0) & (last != s)).cast("int"))
    out = flips.groupBy(*keys).agg(F.min("beta").alias("least"), F.max("beta").alias("most"), F.coalesce(F.sum("_f"), F.lit(0)).alias("n_sign_flips"), F.avg((F.col("beta") == 0).cast("double")).alias("frac_zero"))
    return out.withColumn("stable_sign", F.col("n_sign_flips") == 0)


def sign_stable(lo: Column, hi: Column, strict: bool = False) -> Column:
    """Whether an interval lies on one side of zero; ``strict`` leaves out those that touch it."""
    return (lo > 0) | (hi < 0) if strict else (lo >= 0) | (hi <= 0)


def adjusted_degs(degs: DataFrame, p: str = "p", by: list[str] = ()) -> DataFrame:
    """``degs`` (gene, p, ...) with p_adj over all genes of a batch."""
    return benjamini_hochberg(degs, p, "p_adj", by, ["gene"])


def combined_and_adjusted(degs: DataFrame, n_batches: int, **kw) -> DataFrame:
    """``combine_degs`` with the combined p adjusted over the genes that are kept."""
    return benjamini_hochberg(combine_degs(degs, n_batches, **kw), "pval", "pval_adj", tie=["gene"])


def type_gene_filter(expr: DataFrame, cells: DataFrame, share: float | None = 0.2, alpha: float | None = None) -> DataFrame:
    """(cell_type, gene): genes that a type expresses in at least ``share`` of its cells, and with ``alpha`` that a one-sided rank test
    against all other cells (adjusted over the type's genes) and a positive effect size single out."""
    size = cells.groupBy("cell_type").agg(F.count("*").alias("_n"))  # types are few
    t = cells.select("cell_id", "cell_type")
    every = size.select("cell_type").crossJoin(expr.select("gene").distinct())
    out = every
    if share is not None:
        n = expr.where("value > 0").join(t, "cell_id").groupBy("cell_type", "gene").agg(F.count("*").alias("_c")).join(F.broadcast(size), "cell_type")
        out = out.join(n.where(F.col("_c") >= share * F.col("_n")).select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
    if alpha is not None:
        tests = None
        for (name,) in sorted(size.select("cell_type").collect()):
            one = mann_whitney_greater(expr, cells, F.col("cell_type") == name).withColumn("cell_type", F.lit(name))
            tests = one if tests is None else tests.unionByName(one)
        tests = benjamini_hochberg(tests, by=["cell_type"], tie=["gene"]).where((F.col("fdr") < alpha) & (F.col("d") > 0))
        out = out.join(tests.select("cell_type", "gene"), ["cell_type", "gene"], "left_semi")
    return out


def conditional_log(expr: DataFrame, over: float = 100.0) -> DataFrame:
    """log1p of all values if the largest of them exceeds ``over``, else the values as they are."""
    most = expr.agg(F.max("value")).first()[0]
    return expr.withColumn("value", F.log1p("value")) if most is not None and most > over else expr


# ---------------------------------------------------------------- correlation of tables


def shifted_ranks(values: DataFrame, key: str, n_cells: int) -> DataFrame:
    """Average ranks over all cells less the rank of an absent value (0), which stays 0: correlations of these are those of ranks."""
    v = values.where("value <> 0")
    by = v.groupBy(key, "value").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(key)
    zeros = n_cells - F.sum("_m").over(w)
    before = F.coalesce(F.sum("_m").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("_m"))).over(w), F.lit(0))
    rank = before + F.when(F.col("value") > 0, zeros).otherwise(0) + (F.col("_m") + 1) / 2
    ranks = by.withColumn("_s", (rank - (below + (zeros + 1) / 2)).cast("double"))
    return v.join(ranks.select(key, "value", "_s"), [key, "value"]).select("cell_id", key, F.col("_s").alias("value"))


def table_correlation(scores: DataFrame, modules: DataFrame, n_cells: int, method: str = "pearson") -> DataFrame:
    """(entity, module, r, p, fdr) of every entity (cell_id, entity, value) with every module (cell_id, module, value) over all cells.

    Absent values are 0.  Without spread r is 0 and p is 1; rates are over all pairs.  Scaling an entity to its extremes first, as the
    reference offers, changes no correlation.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError('method must be "pearson" or "spearman"')
    a, b = scores.select("cell_id", "entity", "value"), modules.select("cell_id", "module", "value")
    if method == "spearman":
        a, b = shifted_ranks(a, "entity", n_cells), shifted_ranks(b, "module", n_cells)
    one = a.groupBy("entity").agg(F.sum("value").alias("_s1"), F.sum(F.col("value") * F.col("value")).alias("_q1"))
    two = b.groupBy("module").agg(F.sum("value").alias("_s2"), F.sum(F.col("value") * F.col("value")).alias("_q2"))
    names = scores.select("entity").distinct().join(one, "entity", "left").crossJoin(if_small(modules.select("module").distinct().join(two, "module", "left")))  # tables of names
    xy = a.join(b.withColumnRenamed("value", "_v"), "cell_id").groupBy("entity", "module").agg(F.sum(F.col("value") * F.col("_v")).alias("_xy"))
    j = names.join(xy, ["entity", "module"], "left").fillna(0.0, ["_s1", "_q1", "_s2", "_q2", "_xy"])
    n = float(n_cells)
    var = (n * F.col("_q1") - F.col("_s1") * F.col("_s1")) * (n * F.col("_q2") - F.col("_s2") * F.col("_s2"))
    r = F.when(var > 1e-9, F.greatest(F.least((n * F.col("_xy") - F.col("_s1") * F.col("_s2")) / F.sqrt(var), F.lit(1.0)), F.lit(-1.0)))
    j = j.select("entity", "module", r.alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.lit(n - 2), 1 - F.col("r") * F.col("r")))
    j = j.withColumn("p", F.when(F.col("r").isNull(), 1.0).when(F.abs("r") >= 1, 0.0).otherwise(student_p(t, F.lit(n - 2)))).fillna(0.0, ["r"])
    return benjamini_hochberg(j, tie=["entity", "module"])


def type_correlations(one: DataFrame, two: DataFrame, cells: DataFrame, n_genes: int) -> DataFrame:
    """(type1, type2, r): mean correlation over genes of cells of type1 in one table with cells of type2 in another, less that of type1
    with itself in the first.

    A mean over all pairs of cells is the product of the mean standardised vectors, so no pair is ever made.
    """

    def mean_vectors(values: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        s = values.groupBy("cell_id").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
        m = F.col("_s") / n_genes
        s = s.select("cell_id", m.alias("_m"), F.sqrt(F.greatest(F.col("_q") / n_genes - m * m, F.lit(0.0))).alias("_d")).where("_d > 1e-12")
        size = cells.groupBy("cell_type").agg(F.count("*").alias("_n"))
        at = s.join(cells.select("cell_id", "cell_type"), "cell_id")
        off = at.groupBy("cell_type").agg(F.sum(F.col("_m") / F.col("_d")).alias("_off"))
        up = values.join(at, "cell_id").groupBy("cell_type", "gene").agg(F.sum(F.col("value") / F.col("_d")).alias("_up"))
        base = size.join(off, "cell_type", "left").fillna(0.0, ["_off"])
        # (type, gene) sums of the nonzero part, and what every gene has besides
        return up.join(F.broadcast(base), "cell_type").select(F.col("cell_type").alias(name), "gene", (F.col("_up") / F.col("_n")).alias("_u")), base.select(F.col("cell_type").alias(name), (F.col("_off") / F.col("_n")).alias("_o"))

    def products(a, b, x, y):
        (u, o), (v, w) = a, b
        uv = u.join(v.withColumnRenamed("_u", "_v"), "gene").groupBy(x, y).agg(F.sum(F.col("_u") * F.col("_v")).alias("_uv"))
        su = u.groupBy(x).agg(F.sum("_u").alias("_su")).join(o.withColumnRenamed("_o", "_ou"), x, "right").fillna(0.0, ["_su"])
        sv = v.groupBy(y).agg(F.sum("_u").alias("_sv")).join(w.withColumnRenamed("_o", "_ov"), y, "right").fillna(0.0, ["_sv"])
        every = su.crossJoin(F.broadcast(sv)).join(uv, [x, y], "left").fillna(0.0, ["_uv"])  # tables of types
        return every.select(x, y, ((F.col("_uv") - F.col("_su") * F.col("_ov") - F.col("_sv") * F.col("_ou") + n_genes * F.col("_ou") * F.col("_ov")) / n_genes).alias("r"))

    cross = products(mean_vectors(one, "type1"), mean_vectors(two, "type2"), "type1", "type2")
    own = products(mean_vectors(one, "type1"), mean_vectors(one, "_t"), "type1", "_t").where("type1 = _t").select("type1", F.col("r").alias("_own"))
    return cross.join(own, "type1").select("type1", "type2", (F.col("r") - F.col("_own")).alias("r"))


# ---------------------------------------------------------------- paired and variation tests


def signed_rank(pairs: DataFrame, greater: bool, keys: list[str] = ()) -> DataFrame:
    """(keys, n, w, z, p): Wilcoxon's signed rank test of x - y, one-sided, by the normal with ties corrected; differences of 0 are left out.

    Rows are counted by difference first, so a window sorts distinct sizes.
    """
    keys = list(keys)
    d = pairs.select(*keys, (F.col("x") - F.col("y")).alias("_d")).where("_d <> 0")
    by = d.groupBy(*keys, F.abs("_d").alias("_a")).agg(F.count("*").alias("_m"), F.count_if(F.col("_d") > 0).alias("_p"))
    w = Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("_r", F.coalesce(F.sum("_m").over(w), F.lit(0)) + (F.col("_m") + 1) / 2)
    m = F.col("_m").cast("double")
    g = by.groupBy(*keys).agg(F.sum("_m").cast("double").alias("n"), F.sum(F.col("_p") * F.col("_r")).alias("w"), F.sum(m * m * m - m).alias("_t"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("_t") / 48
    z = F.when(var > 0, (F.col("w") - mean) / F.sqrt(var)).otherwise(0.0)
    return g.select(*keys, F.col("n").cast("long").alias("n"), "w", z.alias("z")).withColumn("p", normal_sf(F.col("z") if greater else -F.col("z")))


def clipped(score: Column, positive: bool) -> Column:
    return F.greatest(score, F.lit(0.0)) if positive else F.least(score, F.lit(0.0))


def support_vectors(x: np.ndarray, y: np.ndarray, gamma: float, c: float = 1.0, epsilon: float = 0.1, settled: float = 1e-5, bins: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(weights of the points, centres, weights of the centres, bias) of a regression by support vectors on one variable.

    The kernel is exp(-gamma (a - b)^2).  Points fall into narrow bins whose centres stand for them, so a step costs their number, not
    a row of a matrix.  A step moves weight between the two points that gain most from it, as far as the nearest bound (0 or ``c`` in
    size), until no pair gains more than ``settled``.
    """
    low, high = float(x.min()), float(x.max())
    width = (high - low) / bins or 1.0
    at = np.minimum(((x - low) / width).astype(int), bins - 1)
    centre = low + (np.arange(bins) + 0.5) * width
    used, at = np.unique(at, return_inverse=True)
    centre = centre[used]
    k = np.exp(-gamma * (centre[:, None] - centre[None, :]) ** 2)
    w, f = np.zeros(len(x)), np.zeros(len(centre))
    while True:
        base = f[at] - y
        up = np.where(w < c, base + np.where(w >= 0, epsilon, -epsilon), np.inf)
        down = np.where(w > -c, base + np.where(w > 0, epsilon, -epsilon), -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        gain = down[j] - up[i]
        if gain <= settled:
            break
        a, b = at[i], at[j]
        room = min((-w[i] if w[i] < 0 else c - w[i]), (w[j] if w[j] > 0 else c + w[j]))
        bend = k[a, a] + k[b, b] - 2 * k[a, b]
        t = room if bend <= 1e-12 else min(room, gain / bend)
        for n, v in ((i, w[i] + t), (j, w[j] - t)):  # bounds are met exactly
            w[n] = next((z for z in (0.0, c, -c) if abs(v - z) < 1e-14), v)
        f += t * (k[:, a] - k[:, b])
    return w, centre, np.bincount(at, w, len(centre)), -(up[i] + down[j]) / 2


def _parabola(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.polyval(np.polyfit(x, y, 2), x)


def _kernel_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gamma = 150.0 / len(x)
    _, centre, weight, bias = support_vectors(x, y, gamma)
    out = np.empty(len(x))
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.exp(-gamma * (x[k : k + 4096, None] - centre[None, :]) ** 2) @ weight + bias
    return out


def variable_genes(expr: DataFrame, n_cells: int, most: int, least_cells: int = 2, most_mean: float = 20.0, least_mean: float = 0.0, genes: DataFrame | None = None, fit: str = "kernel") -> DataFrame:
    """(gene, score, selected): log2 CV over a curve in log2 mean; the ``most`` highest and one, with ties.

    The curve is a regression by support vectors (``fit`` kernel; gamma 150 over the number of genes) or a parabola by least squares.
    Sums over cells are made in all tasks; two numbers a gene are fitted together (refused above MOST_GENES).  Genes outside the limits take no
    part in the fit and get a score just below the least; fewer than three genes have no scores.
    """
    v = variation_fit(expr, n_cells).withColumn("_mean", F.pow(F.lit(2.0), F.col("log_mean")))
    ok = (F.col("detected") > least_cells) & (F.col("_mean") < most_mean) & (F.col("_mean") > least_mean) & F.col("log_cv").isNotNull()
    every = expr.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    rows = v.where(ok).select("gene", "log_mean", "log_cv").orderBy("gene").limit(MOST_GENES + 1).collect()
    if len(rows) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    if len(rows) < 3:
        return every.select("gene", F.lit(None).cast("double").alias("score"), F.lit(False).alias("selected"))
    x, y = np.array([r.log_mean for r in rows]), np.array([r.log_cv for r in rows])
    score = y - {"kernel": _kernel_fit, "parabola": _parabola}[fit](x, y)
    kind = T.StructType([v.schema["gene"], T.StructField("score", T.DoubleType())])
    scored = expr.sparkSession.createDataFrame([(r.gene, float(s)) for r, s in zip(rows, score)], kind)
    nth = float(np.sort(score)[::-1][min(most, len(score) - 1)])
    out = every.join(F.broadcast(scored), "gene", "left").withColumn("score", F.coalesce("score", F.lit(float(score.min()) - 1e-16)))
    return out.withColumn("selected", F.col("score") >= nth)


def winsorised(expr: DataFrame, n_cells: int, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Values clipped to each gene's quantiles over all cells, absent ones counted as 0; values must be 0 or more."""
    v = expr.where("value > 0")
    n = v.groupBy("gene").agg(F.count("*").alias("_n"))
    # place of the quantile among all cells' sorted values, zeros first
    ranked = v.join(n, "gene").withColumn("_i", n_cells - F.col("_n") + F.row_number().over(Window.partitionBy("gene").orderBy("value", "cell_id")) - 1)

    def quantile(q: float, name: str) -> DataFrame:
        at = q * (n_cells - 1)
        lo, part = math.floor(at), at - math.floor(at)
        a, b = F.coalesce(F.max(F.when(F.col("_i") == lo, F.col("value"))), F.lit(0.0)), F.coalesce(F.max(F.when(F.col("_i") == lo + 1, F.col("value"))), F.lit(0.0))
        return ranked.groupBy("gene").agg((a + (F.when(F.lit(lo + 1 < n_cells), b).otherwise(a) - a) * part).alias(name))

    lim = quantile(low, "_lo").join(quantile(high, "_hi"), "gene")
    return v.join(lim, "gene").select("cell_id", "gene", F.greatest(F.least("value", "_hi"), "_lo").alias("value"))


def highly_variable(expr: DataFrame, n_cells: int, most: int) -> DataFrame:
    """(gene, mean, dispersion, norm, rank) of the ``most`` genes of highest dispersion (variance over mean) normalised inside its bin of
    means: less the bin's median, over its scaled median absolute deviation.  Bins are the twentieths of means from the tenth percentile on."""
    g = expr.groupBy("gene").agg((F.sum("value") / n_cells).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    g = g.withColumn("_v", (F.col("_q") - n_cells * F.col("mean") * F.col("mean")) / (n_cells - 1)).where("mean > 0")
    g = g.select("gene", "mean", (F.col("_v") / F.col("mean")).alias("dispersion"))
    cuts = g.agg(F.percentile("mean", F.array(*[F.lit(k / 100) for k in range(10, 105, 5)]))).first()[0] or []
    bin_ = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda acc, c: acc + F.when(F.col("mean") > c, 1).otherwise(0)) if cuts else F.lit(0)
    g = g.withColumn("_b", bin_)
    med = g.groupBy("_b").agg(F.percentile("dispersion", 0.5).alias("_m"))
    g = g.join(med, "_b")
    mad = g.groupBy("_b").agg((F.percentile(F.abs(F.col("dispersion") - F.col("_m")), 0.5) / 0.6744897501960817).alias("_d"))
    g = g.join(mad, "_b").withColumn("norm", F.when(F.col("_d") > 0, (F.col("dispersion") - F.col("_m")) / F.col("_d")))
    order = Window.orderBy(F.round("norm", 9).desc_nulls_last(), "gene")  # one row a gene; the order of a sum decides no place
    return g.select("gene", "mean", "dispersion", "norm", F.row_number().over(order).alias("rank")).where((F.col("rank") <= most) & F.col("norm").isNotNull())


def mitochondrial_free(expr: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``expr`` without genes named MT- in any case and, given the cells, without cells that have no label."""
    kept = expr.where(~F.upper("gene").startswith("MT-"))
    return kept if cells is None else kept.join(cells.where(F.col("cell_type").isNotNull()).select("cell_id"), "cell_id", "left_semi")
