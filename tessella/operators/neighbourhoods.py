"""Transitions between cells, smoothing over neighbourhoods, grids and flows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.lineage import cut, numbered
from tessella.operators.spatial import nearest, transition_probabilities


def median_scale(cells: DataFrame, spacing: float = 15.0) -> DataFrame:
    """Coordinates in units where the median distance to the nearest other cell is ``spacing``; the old ones stay as x_raw, y_raw."""
    m = nearest(cells, cells, 1).agg(F.percentile(F.sqrt("d2"), 0.5)).first()[0]
    f = spacing / m if m else 1.0
    return cells.withColumns({"x_raw": F.col("x"), "y_raw": F.col("y"), "x": F.col("x") * f, "y": F.col("y") * f})


def smooth(values: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Mean of (cell_id, gene, value) over a cell and its nearest, k with itself, absent values as 0."""
    near = nearest(cells, cells, k, with_self=True).select("i", "j")
    n = near.groupBy("i").agg(F.count("*").alias("_n"))
    s = near.join(values.withColumnRenamed("cell_id", "j"), "j").groupBy("i", "gene").agg(F.sum("value").alias("_s"))
    return s.join(n, "i").select(F.col("i").alias("cell_id"), "gene", (F.col("_s") / F.col("_n")).alias("value"))


def smooth_labels(cells: DataFrame, k: int) -> DataFrame:
    """Most frequent type among a cell and its nearest, k with itself, ties to the first name."""
    types = cells.select(F.col("cell_id").alias("j"), "cell_type")
    c = nearest(cells, cells, k, with_self=True).join(types, "j").groupBy("i", "cell_type").agg(F.count("*").alias("n"))
    return c.groupBy(F.col("i").alias("cell_id")).agg(F.min_by("cell_type", F.struct((-F.col("n")).alias("n"), F.col("cell_type"))).alias("cell_type"))


def impute(values: DataFrame, edges: DataFrame, cells: DataFrame, by: str | None = None, least: int = 16) -> DataFrame:
    """Weighted mean of (cell_id, gene, value) over edges (i, j, w), of the same ``by`` if given; clusters below ``least`` cells pass through."""
    e = edges.select("i", "j", "w")
    alone = None
    if by:
        t = lambda c, z: cells.select(F.col("cell_id").alias(c), F.col(by).alias(z))
        size = cells.groupBy(by).agg(F.count("*").alias("_n"))  # clusters are few
        tiny = cells.join(F.broadcast(size.where(F.col("_n") < least)), by, "left_semi").select("cell_id")
        e = e.join(t("i", "_a"), "i").join(t("j", "_b"), "j").where("_a = _b").join(tiny.withColumnRenamed("cell_id", "i"), "i", "left_anti").select("i", "j", "w")
        alone = values.join(tiny, "cell_id", "left_semi")
    n = e.groupBy("i").agg(F.sum("w").alias("_n"))
    s = e.join(values.withColumnRenamed("cell_id", "j"), "j").groupBy("i", "gene").agg(F.sum(F.col("w") * F.col("value")).alias("_s"))
    out = s.join(n.where("_n > 0"), "i").select(F.col("i").alias("cell_id"), "gene", (F.col("_s") / F.col("_n")).alias("value"))
    return out if alone is None else out.unionByName(alone.select("cell_id", "gene", "value"))


def diffuse(values: DataFrame, edges: DataFrame, times: int) -> DataFrame:
    """Values after ``times`` steps of the row-normalised edges (i, j, w): a power of the diffusion operator, one written step a time."""
    n = edges.groupBy("i").agg(F.sum("w").alias("_n"))
    p = cut(edges.join(n, "i").select("i", "j", (F.col("w") / F.col("_n")).alias("w")))
    now = values.select("cell_id", "gene", "value")
    for _ in range(times):
        now = cut(p.join(now.withColumnRenamed("cell_id", "j"), "j").groupBy(F.col("i").alias("cell_id"), "gene").agg(F.sum(F.col("w") * F.col("value")).alias("value")))
    return now


def project(p: DataFrame, cells: DataFrame, unit: bool = False) -> DataFrame:
    """Expected displacement of each cell over transition probabilities (i, j, p), of unit steps if asked for."""
    a = cells.select(F.col("cell_id").alias("i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    b = cells.select(F.col("cell_id").alias("j"), "x", "y")
    e = p.join(a, "i").join(b, "j").withColumns({"_dx": F.col("x") - F.col("_x"), "_dy": F.col("y") - F.col("_y")})
    if unit:
        size = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
        e = e.withColumn("_l", F.when(size > 0, size).otherwise(1.0)).withColumns({"_dx": F.col("_dx") / F.col("_l"), "_dy": F.col("_dy") / F.col("_l")})
    return e.groupBy(F.col("i").alias("cell_id")).agg(F.sum(F.col("p") * F.col("_dx")).alias("dx"), F.sum(F.col("p") * F.col("_dy")).alias("dy"))


def _types(cells: DataFrame):
    return lambda c, z: cells.select(F.col("cell_id").alias(c), F.col("cell_type").alias(z))


def zone_means(p: DataFrame, cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean transition probability from type to type over all ordered pairs of their cells, absent ones as 0."""
    n = cells.groupBy("cell_type").agg(F.count("*").alias("n"))  # types are few
    t = _types(cells)
    s = p.join(t("i", "zone1"), "i").join(t("j", "zone2"), "j").groupBy(*keys, "zone1", "zone2").agg(F.sum("p").alias("_s"))
    s = s.join(F.broadcast(n.toDF("zone1", "_n1")), "zone1").join(F.broadcast(n.toDF("zone2", "_n2")), "zone2")
    return s.select(*keys, "zone1", "zone2", (F.col("_s") / (F.col("_n1") * F.col("_n2"))).alias("p"))


def fates(p: DataFrame, cells: DataFrame) -> DataFrame:
    """Each cell's most probable type to go to, ties to the first name, with its mass."""
    m = p.join(cells.select(F.col("cell_id").alias("j"), F.col("cell_type").alias("fate")), "j").groupBy("i", "fate").agg(F.sum("p").alias("mass"))
    w = Window.partitionBy("i").orderBy(F.desc(F.round("mass", 9)), "fate")
    return m.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("i").alias("cell_id"), "fate", "mass")


def transition_summary(p: DataFrame, cells: DataFrame) -> DataFrame:
    """Least, mean and most over start types of the mean probability of each fate."""
    t = _types(cells)
    m = p.join(t("i", "start"), "i").join(t("j", "fate"), "j").groupBy("start", "fate").agg(F.avg("p").alias("_m"))
    return m.groupBy("fate").agg(F.min("_m").alias("least"), F.avg("_m").alias("mean"), F.max("_m").alias("most"))


def annotate_transitions(p: DataFrame, cells: DataFrame, allowed: list[str] | None = None, threshold: float = 0.0002, none: str = "null") -> DataFrame:
    """(cell_id, start, transition): where each cell goes by the mean of its probabilities (i, j, p) over all cells of each type.

    The best allowed type is taken if its mean exceeds that of the cell's own type, the threshold and the least mean that any cell of the
    start type has for its own; else ``none`` if the own mean is below the threshold, else the own type.  Ties go to the first name.
    """
    t = _types(cells)
    size = cells.groupBy(F.col("cell_type").alias("fate")).agg(F.count("*").alias("_n"))
    size = size if allowed is None else size.where(F.col("fate").isin(allowed))  # types are few
    mass = p.join(t("j", "fate"), "j").groupBy("i", "fate").agg(F.sum("p").alias("_s"))
    every = t("i", "start").crossJoin(F.broadcast(size)).join(mass, ["i", "fate"], "left").withColumn("m", F.coalesce("_s", F.lit(0.0)) / F.col("_n"))
    g = every.groupBy("i", "start").agg(F.max(F.when(F.col("fate") == F.col("start"), F.col("m"))).alias("own"), F.min_by(F.struct("fate", "m"), F.struct((-F.round("m", 12)).alias("a"), F.col("fate").alias("b"))).alias("best"))
    g = cut(g.withColumn("own", F.coalesce("own", F.lit(0.0))))
    floor = g.groupBy("start").agg(F.min("own").alias("_least"))
    go = (F.col("best.m") > F.col("own")) & (F.col("best.m") > threshold) & (F.col("best.m") > F.col("_least"))
    to = F.when(go, F.col("best.fate")).when(F.col("own") < threshold, F.lit(none)).otherwise(F.col("start"))
    return g.join(F.broadcast(floor), "start").select(F.col("i").alias("cell_id"), "start", to.alias("transition"))


def transition_counts(annotated: DataFrame, keys: list[str] = ()) -> DataFrame:
    return annotated.groupBy(*keys, "start", "transition").agg(F.count("*").alias("n"))


def minus_null(p: DataFrame, null: DataFrame) -> DataFrame:
    """(i, j, d): probabilities less those of a null model."""
    return p.join(null.withColumnRenamed("p", "_q"), ["i", "j"], "left").select("i", "j", (F.col("p") - F.coalesce("_q", F.lit(0.0))).alias("d"))


def rescaled(d: DataFrame, n_cells: int) -> DataFrame:
    """(i, j, p, rest): differences scaled from their least to their most over all pairs of cells, then to sum 1 a cell.

    A pair without a row has difference 0, which scales to ``rest`` too, alike for all such pairs of a cell.
    """
    lo, hi = d.agg(F.least(F.min("d"), F.lit(0.0)), F.greatest(F.max("d"), F.lit(0.0))).first()
    if lo is None or hi <= lo:
        return d.select("i", "j", F.lit(0.0).alias("p"), F.lit(0.0).alias("rest"))
    base = -lo / (hi - lo)
    v = d.withColumn("_v", (F.col("d") - lo) / (hi - lo))
    w = Window.partitionBy("i")
    total = F.sum("_v").over(w) + (n_cells - F.count("*").over(w)) * base
    return v.select("i", "j", (F.col("_v") / total).alias("p"), (F.lit(base) / total).alias("rest"))


def spatial_map(cells: DataFrame, m: int, n: int) -> DataFrame:
    """Distance of every cell to the centres of an m x n grid over all cells, scaled to [0, 1] per cell."""
    x0, x1, y0, y1 = (v or 0.0 for v in cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())
    at = F.sqrt(F.pow(F.col("x") - (F.lit(x0) + (F.col("gx") + 0.5) * (x1 - x0) / m), 2) + F.pow(F.col("y") - (F.lit(y0) + (F.col("gy") + 0.5) * (y1 - y0) / n), 2))
    every = cells.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = every.select("cell_id", "gx", "gy", at.alias("_d"))
    w = Window.partitionBy("cell_id")
    return d.select("cell_id", "gx", "gy", ((F.col("_d") - F.min("_d").over(w)) / F.greatest(F.max("_d").over(w) - F.min("_d").over(w), F.lit(1e-15))).alias("d"))


def niche_groups(cells: DataFrame, perturbed: DataFrame, control: DataFrame, k: int, others: DataFrame | None = None, cell_type: str | None = None) -> DataFrame:
    """(cell_id, niche): the k nearest of perturbed and of control sources, without the perturbed sources themselves.

    A neighbour of both is one of the perturbed.  ``others`` are further cells that are left out, such as those perturbed otherwise;
    ``cell_type`` keeps neighbours of one type.
    """
    near = lambda s: nearest(s, cells, k, with_self=True).select(F.col("j").alias("cell_id")).distinct()
    a = cut(near(perturbed).join(perturbed.select("cell_id"), "cell_id", "left_anti"))
    out = a.withColumn("niche", F.lit("perturbed")).union(near(control).join(a, "cell_id", "left_anti").join(perturbed.select("cell_id"), "cell_id", "left_anti").withColumn("niche", F.lit("control")))
    if others is not None:
        out = out.join(others.select("cell_id"), "cell_id", "left_anti")
    return out if cell_type is None else out.join(cells.where(F.col("cell_type") == cell_type).select("cell_id"), "cell_id", "left_semi")


def balanced_neighbours(near: DataFrame, k: int, most_in: int, rounds: int = 500) -> DataFrame:
    """(i, j, d2) of ``near`` (i, j, d2), k a cell at most, so that no cell is the neighbour of more than ``most_in`` others.

    Cells choose one after the other, those that most lists of ``near`` name first, of equal ones the larger id: each takes the nearest
    that are not full, ties to the smaller id.  All of them do so at once here: cells ask their nearest that have not refused them, and a
    cell asked by too many refuses those that come last in that order, until nobody is refused.  As all cells prefer by the same
    order, that ends with the same choice.
    """
    e = near.select("i", "j", "d2").where("i <> j")
    named = e.groupBy(F.col("j").alias("i")).agg(F.count("*").alias("_l"))
    left = cut(e.join(named, "i", "left").fillna(0, ["_l"]))
    for _ in range(rounds):
        asked = left.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("d2", "j"))).where(F.col("_r") <= k)
        asked = asked.withColumn("_s", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("_l"), F.desc("i"))))
        refused = cut(asked.where(F.col("_s") > most_in).select("i", "j"))
        if refused.isEmpty():
            return asked.select("i", "j", "d2")
        left = cut(left.join(refused, ["i", "j"], "left_anti"))
    raise RuntimeError("neighbours did not settle")


def mutual(edges: DataFrame) -> DataFrame:
    """(i, j, w): the smaller of both directions' weights, where both are there."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("_w"))
    return edges.join(back, ["i", "j"]).select("i", "j", F.least("w", "_w").alias("w"))


# ---------------------------------------------------------------- grids


def grid(cells: DataFrame, m: int, n: int, pad: float = 0.0) -> DataFrame:
    """(cell_id, gx, gy, x, y): m x n points from border to border of the cells' box, padded by a share of its sides; the high border's
    pad is of the side that is already padded below."""
    x0, x1, y0, y1 = (v or 0.0 for v in cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())

    def ends(lo, hi):
        lo = lo - pad * abs(hi - lo)
        return lo, hi + pad * abs(hi - lo)

    (x0, x1), (y0, y1) = ends(x0, x1), ends(y0, y1)
    at = cells.sparkSession.range(m * n).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / n).alias("gx"), (F.col("id") % n).alias("gy"))
    return at.withColumns({"x": F.lit(x0) + F.col("gx") * ((x1 - x0) / max(m - 1, 1)), "y": F.lit(y0) + F.col("gy") * ((y1 - y0) / max(n - 1, 1))})


def knn_regression(cells: DataFrame, points: DataFrame, value: str, k: int) -> DataFrame:
    """(cell_id, value): mean of ``value`` over the k cells nearest to each point."""
    v = cells.select(F.col("cell_id").alias("j"), F.col(value).alias("_v"))
    return nearest(points, cells, k, with_self=True).join(v, "j").groupBy(F.col("i").alias("cell_id")).agg(F.avg("_v").alias("value"))


def gradient(values: DataFrame) -> DataFrame:
    """(gx, gy, dx, dy): central differences of (gx, gy, value) along both axes of a whole grid, one-sided at its borders."""

    def along(axis: str, other: str, out: str) -> DataFrame:
        w = Window.partitionBy(other).orderBy(axis)  # one line of the grid
        before, after, own = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        d = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2)
        return values.select("gx", "gy", d.alias(out))

    return along("gx", "gy", "dx").join(along("gy", "gx", "dy"), ["gx", "gy"])


def root_normalised(field: DataFrame) -> DataFrame:
    """Vectors (dx, dy) over the root of their length."""
    size = F.sqrt(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return field.withColumn("_s", F.when(size == 0, 1.0).otherwise(size)).withColumns({"dx": F.col("dx") / F.col("_s"), "dy": F.col("dy") / F.col("_s")}).drop("_s")


def alignment(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 1e-8) -> DataFrame:
    """(keys, inner, cosine) of two vector fields (keys, dx, dy)."""
    j = a.join(b.withColumnsRenamed({"dx": "_dx", "dy": "_dy"}), keys)
    inner = F.col("dx") * F.col("_dx") + F.col("dy") * F.col("_dy")
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    return j.select(*keys, inner.alias("inner"), (inner / (length + eps)).alias("cosine"))


def type_alignment(cells: DataFrame, points: DataFrame, value: str, agg: str = "mean") -> DataFrame:
    """(cell_type, alignment) of the value at each cell's nearest grid point, highest first."""
    v = points.select(F.col("cell_id").alias("j"), F.col(value).alias("_v"))
    met = nearest(cells, points, 1, with_self=True).join(v, "j").join(cells.select(F.col("cell_id").alias("i"), "cell_type"), "i")
    fun = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "min": F.min, "max": F.max, "sum": F.sum}[agg]
    return met.groupBy("cell_type").agg(fun("_v").alias("alignment")).orderBy(F.desc("alignment"), "cell_type")


def mass_on_grid(points: DataFrame, cells: DataFrame, k: int, width: float) -> DataFrame:
    """(cell_id, mass): density of the cells at each point, a normal of deviation ``width`` over its k nearest."""
    pdf = F.exp(-F.col("d2") / (2 * width * width)) / (width * math.sqrt(2 * math.pi))
    return nearest(points, cells, k, with_self=True).groupBy(F.col("i").alias("cell_id")).agg(F.sum(pdf).alias("mass"))


def flow_on_grid(points: DataFrame, cells: DataFrame, moves: DataFrame, k: int, width: float, top: float = 0.995) -> DataFrame:
    """(cell_id, dx, dy, nx, ny, mass): moves (cell_id, dx, dy) averaged at each point by the same weights, mass 1 at least.

    nx, ny are over the ``top`` quantile of the lengths of all points.
    """
    w = F.exp(-F.col("d2") / (2 * width * width)) / (width * math.sqrt(2 * math.pi))
    m = moves.select(F.col("cell_id").alias("j"), "dx", "dy")
    s = nearest(points, cells, k, with_self=True).withColumn("_w", w).join(m, "j", "left").fillna(0.0, ["dx", "dy"])
    s = s.groupBy(F.col("i").alias("cell_id")).agg(F.sum("_w").alias("mass"), F.sum(F.col("_w") * F.col("dx")).alias("_x"), F.sum(F.col("_w") * F.col("dy")).alias("_y"))
    s = cut(s.select("cell_id", (F.col("_x") / F.greatest("mass", F.lit(1.0))).alias("dx"), (F.col("_y") / F.greatest("mass", F.lit(1.0))).alias("dy"), "mass"))
    q = s.agg(F.percentile(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), top)).first()[0] or 1.0
    return s.select("cell_id", "dx", "dy", (F.col("dx") / q).alias("nx"), (F.col("dy") / q).alias("ny"), "mass")


# ---------------------------------------------------------------- walks


def walk_matrix(p: DataFrame, near: DataFrame, sigma_d: float, sigma_w: float) -> DataFrame:
    """(i, j, p): transition probabilities (i, j, p) damped by distance, mixed with a fifth of noise; rows sum to 1.

    near: (i, j, d2) of the pairs that noise may join, self included.  The diagonal is a row's largest damped probability.
    """
    kernel = lambda s: F.exp(-F.col("d2") / (2 * s * s))
    damped = near.where("i <> j").join(p, ["i", "j"]).select("i", "j", (F.col("p") * kernel(sigma_d)).alias("v"))
    own = damped.groupBy("i").agg(F.max("v").alias("v")).select("i", F.col("i").alias("j"), "v")
    norm = lambda df: df.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("i")))
    one = norm(damped.union(own)).withColumnRenamed("v", "a")
    two = norm(near.select("i", "j", kernel(sigma_w).alias("v"))).withColumnRenamed("v", "b")
    mixed = one.join(two, ["i", "j"], "full").select("i", "j", (0.8 * F.coalesce("a", F.lit(0.0)) + 0.2 * F.coalesce("b", F.lit(0.0))).alias("v"))
    return norm(mixed).withColumnRenamed("v", "p")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts, which SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def walk(p: DataFrame, starts: DataFrame, steps: int, copies: int = 1, seed: int = 0) -> DataFrame:
    """(start, copy, step, cell): ``copies`` walks from each start over (i, j, p) whose rows sum to 1, by cumulative probability.

    Each step is written, so plans stay short; a cell without a way on stays.
    """
    w = Window.partitionBy("i").orderBy("j")
    line = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    hops = cut(p.select("i", "j", (line - F.col("p")).alias("lo"), line.alias("hi"), F.row_number().over(w).alias("_k"), F.count("*").over(Window.partitionBy("i")).alias("_n")))
    now = cut(starts.select(F.col("cell_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.col("cell_id").alias("cell")))
    out = now.select("start", "copy", F.lit(0).alias("step"), "cell")
    for s in range(1, steps + 1):
        u = now.withColumn("_u", uniform(F.lit(seed), "start", "copy", F.lit(s)))
        # the last interval takes what rounding leaves over
        hit = (F.col("_u") >= F.col("lo")) & ((F.col("_u") < F.col("hi")) | (F.col("_k") == F.col("_n")))
        moved = u.join(hops.withColumnRenamed("i", "cell"), "cell").where(hit).select("start", "copy", F.col("j").alias("_to"))
        now = cut(now.join(moved, ["start", "copy"], "left").select("start", "copy", F.coalesce("_to", "cell").alias("cell")))
        out = out.union(now.select("start", "copy", F.lit(s).alias("step"), "cell"))
    return out


def walk_table(walks: DataFrame, cells: DataFrame, last: int) -> DataFrame:
    """(start_type, end_type, n): walks by the type where they start and where step ``last`` is."""
    t = _types(cells)
    w = walks.where(F.col("step") == last)
    return w.join(t("start", "start_type"), "start").join(t("cell", "end_type"), "cell").groupBy("start_type", "end_type").agg(F.count("*").alias("n"))


def markov_step(p: DataFrame, state: DataFrame) -> DataFrame:
    """One step of a distribution (i, mass) over transition probabilities (i, j, p)."""
    return state.join(p, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))


def null_probabilities(edges: DataFrame) -> DataFrame:
    """What no change at all gives: every neighbour alike, as a correlation that is none counts as 1."""
    return transition_probabilities(edges.select("i", "j"), F.lit(1.0)).select("i", "j", "p")


def by_rank(cells: DataFrame) -> DataFrame:
    """Cells with their place in id order, for graphs made by rank."""
    return numbered(cells, ["cell_id"], "rank")


# ---------------------------------------------------------------- development


def digitised(points: DataFrame, bins: int, inner: bool = True) -> DataFrame:
    """(cell_id, score, pseudotime, ...) with ``bin``: equal widths from the least to the most pseudotime.

    ``inner``: ids 0 to bins - 1 by the inner borders; else ids from 0 by all borders of bins - 1 widths, the last one the most alone.
    """
    lo, hi = points.agg(F.min("pseudotime"), F.max("pseudotime")).first()
    if lo is None:
        return points.withColumn("bin", F.lit(0).cast("long"))
    width = (hi - lo) / (bins if inner else bins - 1)
    if width == 0:
        return points.withColumn("bin", F.lit(0).cast("long"))
    edges = [lo + k * width for k in range(1, bins)]
    n = F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0).cast("long"), lambda acc, e: acc + F.when(F.col("pseudotime") >= e, 1).otherwise(0))
    return points.withColumn("bin", n)


def score_sums(points: DataFrame, positive: bool, keys: list[str] = ()) -> DataFrame:
    """(keys, bin, score): sums of the positive or of the negative scores per bin."""
    return points.where(F.col("score") > 0 if positive else F.col("score") < 0).groupBy(*keys, "bin").agg(F.sum("score").alias("score"))


def rank_knockouts(sums: DataFrame, bins: list[int] = tuple(range(10)), misc: str | None = None, positive: bool = False) -> DataFrame:
    """(gene, score, rank): score sums (gene, misc, bin, score) over the chosen bins, lowest first, or highest if ``positive``."""
    s = sums.where(F.col("bin").isin(list(bins)))
    s = s if misc is None else s.where(F.col("misc") == misc)
    s = s.groupBy("gene").agg(F.sum("score").alias("score"))
    by = F.round("score", 9)  # the order of a sum decides no place
    order = Window.orderBy(by.desc() if positive else by.asc(), "gene")  # one row a gene
    return s.withColumn("rank", F.row_number().over(order))


def lineage_pseudotime(values: DataFrame) -> DataFrame:
    """(cell_id, pseudotime): mean over lineages (cell_id, lineage, pseudotime), those without one left out."""
    return values.where("pseudotime is not null").groupBy("cell_id").agg(F.avg("pseudotime").alias("pseudotime"))
