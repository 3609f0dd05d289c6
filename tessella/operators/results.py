"""Result tables: filters on cells and genes, summaries of significance, sets, and what the viewer shows."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.lineage import if_small
from tessella.functions.scalars import number_text

# ---------------------------------------------------------------- cells, genes and names


def select_cells(cells: DataFrame, column: str | None = None, values: list | None = None, ids: list | None = None) -> DataFrame:
    """Cells whose column holds one of the values, and whose id is listed.

    A value that no cell holds is an error; an id that no cell has is warned about.
    """
    out = cells
    if column is not None:
        values = list(values)
        have = {r[0] for r in cells.where(F.col(column).isin(values)).select(column).distinct().collect()}
        if missing := [v for v in values if v not in have]:
            raise ValueError(f"no cell has {column} = {missing}")
        out = out.where(F.col(column).isin(values))
    if ids is not None:
        want = cells.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], cells.select("cell_id").schema)
        unknown = want.join(cells.select("cell_id"), "cell_id", "left_anti").count()
        if unknown:
            warnings.warn(f"{unknown} listed ids are no cells", stacklevel=2)
        out = out.join(want, "cell_id", "left_semi")
    return out


def focus_genes(genes: DataFrame, focus: list[str]) -> DataFrame:
    """(gene, pos) of the listed genes that are known, first places kept; an empty list, a string, or no known gene is an error."""
    if isinstance(focus, str) or not focus:
        raise ValueError("give a list of genes")
    want = genes.sparkSession.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(focus))], "gene string, pos int")
    known = genes.select("gene").distinct()
    lost = [r[0] for r in want.join(known, "gene", "left_anti").collect()]
    if len(lost) == len(set(focus)):
        raise ValueError("no listed gene is known")
    if lost:
        warnings.warn(f"unknown genes left out: {sorted(lost)}", stacklevel=2)
    return want.join(known, "gene", "left_semi")


def kept_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """``df`` with the columns of ``keep`` that it has, in their order."""
    return df.select(*[c for c in keep if c in df.columns])


def is_mouse(genes: DataFrame) -> bool:
    """Whether more gene names are written like Abc1 than like ABC1; all names are read."""
    mouse, human = genes.select("gene").distinct().agg(F.count_if(F.col("gene").rlike("^[A-Z][^A-Z]+$")), F.count_if(F.col("gene").rlike("[A-Z]") & ~F.col("gene").rlike("[a-z]"))).first()
    return mouse > human


def relabelled(df: DataFrame, label: str, groups: dict[str, list[str]], other: str | None = None, out: str | None = None) -> DataFrame:
    """Labels merged into groups; those in none keep their name, or become ``other``."""
    c = F.lit(other) if other is not None else F.col(label)
    for name, members in groups.items():
        c = F.when(F.col(label).isin(members), name).otherwise(c)
    return df.withColumn(out or label, c)


def remaining_genes(genes: DataFrame, *done: DataFrame) -> DataFrame:
    """Genes that are in none of the other tables (done, locked, orphaned)."""
    out = genes.select("gene").distinct()
    for d in done:
        out = out.join(d.select("gene"), "gene", "left_anti")
    return out


def with_pathway(results: DataFrame, pathways: DataFrame) -> DataFrame:
    """``results`` (metabolite, ...) with the pathway of each, or its own name where none is known."""
    one = pathways.groupBy("metabolite").agg(F.min("pathway").alias("pathway"))
    return results.join(one, "metabolite", "left").withColumn("pathway", F.coalesce("pathway", "metabolite"))


def matched_betas(betas: DataFrame, matching: DataFrame) -> DataFrame:
    """Coefficients of a reference's cells given to other cells: matching (cell_id, reference_cell); cells without a match have none."""
    m = matching.select("cell_id", F.col("reference_cell").alias("_c"))
    return m.join(betas.withColumnRenamed("cell_id", "_c"), "_c", "left").drop("_c")


def first_kept(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


# ---------------------------------------------------------------- sets


def stacked(*tables: DataFrame, fill: dict | None = None) -> DataFrame:
    """All rows under the union of the columns, absent ones null or filled."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.fillna(fill) if fill else out


def stacked_common(*tables: DataFrame) -> DataFrame:
    """All rows under the columns that every table has."""
    cols = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    out = tables[0].select(*cols)
    for t in tables[1:]:
        out = out.union(t.select(*cols))
    return out


def united(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def shared(*tables: DataFrame) -> DataFrame:
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.intersect(t)
    return out


def without(table: DataFrame, *others: DataFrame) -> DataFrame:
    out = table.distinct()
    for t in others:
        out = out.exceptAll(t.distinct().intersect(out))
    return out


def pair_key(a: str = "g1", b: str = "g2") -> Column:
    """One key for a pair in either order."""
    return F.concat(F.least(a, b), F.lit("__"), F.greatest(a, b))


def pair_sets(members: DataFrame) -> DataFrame:
    """(metabolite, g1, g2) with each unordered pair once."""
    return members.select("metabolite", F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).distinct()


def with_pair(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``table`` (id ``A__B`` or ``B__A``) that meet a pair (g1, g2) in either order."""
    part = F.split("id", "__", 2)
    keyed = table.withColumn("_k", F.concat(F.least(part[0], part[1]), F.lit("__"), F.greatest(part[0], part[1])))
    return keyed.join(pairs.select(pair_key().alias("_k"), "g1", "g2").distinct(), "_k").drop("_k")


def combinations(items: DataFrame, key: str, a: str, b: str, ordered: bool = False, by: list[str] = ()) -> DataFrame:
    """Pairs of a small table's items inside ``by``, each with itself too, in one order or in both."""
    one, two = items.select(*by, F.col(key).alias(a)).distinct(), items.select(*by, F.col(key).alias(b)).distinct()
    met = one.join(two, list(by)) if by else one.crossJoin(if_small(two))  # a product is what is asked for
    return met if ordered else met.where(F.col(a) <= F.col(b))


# ---------------------------------------------------------------- significance summaries


def fdr_text(c: Column) -> Column:
    """A rate in scientific form with one decimal and two digits of exponent, 'na' where there is none."""
    return number_text(c, "scientific", "na")


def is_tcell(label: Column, background: str = "other") -> Column:
    return F.coalesce(F.lower(F.trim(label)) != background.strip().lower(), F.lit(False))


def involvement(ct1: Column, ct2: Column, background: str = "other") -> Column:
    """How a pair of cell types involves T cells, whatever its order."""
    t1, t2 = is_tcell(ct1, background), is_tcell(ct2, background)
    return (
        F.when(ct1.isNull() | ct2.isNull(), "cell_type_independent")
        .when(ct1 == ct2, F.when(t1, "within_Tcell").otherwise("within_other"))
        .when(t1 | t2, "Tcell_interface").otherwise("non_Tcell_interface")
    )


def significant_pair_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(metabolite, n): significant rows (g1, g2) over the pairs that support each metabolite, in either order."""
    m = pair_sets(members).select("metabolite", pair_key().alias("_k"))
    return pairs.select(pair_key().alias("_k")).join(m, "_k").groupBy("metabolite").agg(F.count("*").alias("n"))


def tier_summary(results: DataFrame, background: str = "other") -> DataFrame:
    """One row a metabolite with significant interactions (metabolite, ct1, ct2, fdr, selected) of a tier.

    n_sig_pairs, interactions (those with T cells first, then by rate), within_tcell, tcell_interfaces, tcell_involved; the two types
    of an interaction have no direction.
    """
    a, b = F.least("ct1", "ct2"), F.greatest("ct1", "ct2")
    t1, t2 = is_tcell(F.col("ct1"), background), is_tcell(F.col("ct2"), background)
    same = F.col("ct1") == F.col("ct2")
    name = F.concat(F.when(same, F.concat("ct1", F.lit(" (self)"))).otherwise(F.concat(a, F.lit("--"), b)), F.lit(" ("), fdr_text(F.col("fdr")), F.lit(")"))
    s = results.where("selected").select("metabolite", (t1 | t2).alias("t"), (same & t1).alias("within"), (~same & (t1 | t2)).alias("face"), "fdr", name.alias("label"))
    joined = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda x: x["label"]), "; ")
    entry = F.struct((~F.col("t")).alias("other"), "fdr", "label")
    return s.groupBy("metabolite").agg(
        F.count("*").alias("n_sig_pairs"), joined(F.collect_list(entry)).alias("interactions"), joined(F.collect_list(F.when(F.col("within"), entry))).alias("within_tcell"),
        joined(F.collect_list(F.when(F.col("face"), entry))).alias("tcell_interfaces"), F.bool_or("t").alias("tcell_involved"),
    )


def master_table(members: DataFrame, results: DataFrame, sig_pairs: DataFrame, tiers: dict[str, DataFrame], background: str = "other") -> DataFrame:
    """One row a metabolite: its pairs and genes, its own significance (metabolite, selected, fdr), significant pairs, and each tier's summary."""
    genes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("g1", "g2"))))), ", ")
    out = members.groupBy("metabolite").agg(F.count("*").alias("n_gene_pairs"), genes.alias("transporter_genes"))
    out = out.join(results.select("metabolite", F.col("selected").alias("global_significant"), F.col("fdr").alias("global_fdr")), "metabolite", "left").fillna(False, ["global_significant"])
    out = out.join(significant_pair_counts(sig_pairs, members).withColumnRenamed("n", "n_sig_gene_pairs_global"), "metabolite", "left").fillna(0, ["n_sig_gene_pairs_global"])
    for tier, rows in tiers.items():
        s = tier_summary(rows, background)
        names = {c: f"{tier}_{c}" for c in s.columns if c != "metabolite"}
        out = out.join(s.withColumnsRenamed(names), "metabolite", "left")
        out = out.fillna(0, [f"{tier}_n_sig_pairs"]).fillna("", [f"{tier}_{c}" for c in ("interactions", "within_tcell", "tcell_interfaces")]).fillna(False, [f"{tier}_tcell_involved"])
    return out


def pair_table(tiers: dict[str, DataFrame], members: DataFrame, background: str = "other") -> DataFrame:
    """All significant pair rows (ct1, ct2, g1, g2, fdr, c, selected) of all tiers with their metabolites and involvement, in order."""
    m = pair_sets(members).groupBy(pair_key().alias("_k")).agg(F.array_join(F.array_sort(F.collect_set("metabolite")), " | ").alias("metabolites"))
    out = None
    for tier, rows in tiers.items():
        one = rows.where("selected").select(F.lit(tier).alias("tier"), "ct1", "ct2", "g1", "g2", "fdr", "c")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("_k", pair_key()).join(m, "_k", "left").drop("_k").fillna("", ["metabolites"])
    return out.withColumn("involvement", involvement(F.col("ct1"), F.col("ct2"), background)).orderBy("tier", "involvement", "fdr", "ct1", "ct2", "g1", "g2")


def cluster_thresholds(values: DataFrame, cells: DataFrame, p: float = 0.3) -> DataFrame:
    """(cell_id, gene, value): sums of significant communication (ligand, receptor, ct1, ct2, value, p) that a cell's type sends and receives."""
    v = values.where(F.col("p") < p)
    live = v.groupBy("ligand", "receptor").agg(F.sum("value").alias("_s")).where("_s > 0").select("ligand", "receptor")
    v = v.join(live, ["ligand", "receptor"], "left_semi")
    s = v.select(F.col("ct1").alias("cell_type"), F.col("ligand").alias("gene"), "value").union(v.select("ct2", "receptor", "value"))
    return cells.select("cell_id", "cell_type").join(s.groupBy("cell_type", "gene").agg(F.sum("value").alias("value")), "cell_type").select("cell_id", "gene", "value")


def kept_share(thresholds: DataFrame, cells: DataFrame, n_genes: int) -> float:
    """The share of all cells and genes with a positive threshold."""
    n = cells.count() * n_genes
    return thresholds.where("value > 0").count() / n if n else 0.0


def subsampled_pairs(members: DataFrame, replicates: int, share: float, seed: int = 0, attempts: int = 64) -> DataFrame:
    """(rep, metabolite, g1, g2): each pair kept with probability ``share``, independently in each replicate; an empty draw is drawn again."""
    from tessella.operators.neighbourhoods import uniform

    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    tries = members.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    kept = tries.where(uniform(F.lit(seed), "rep", "_t", "metabolite", "g1", "g2") < share)
    first = kept.groupBy("rep").agg(F.min("_t").alias("_t"))
    return kept.join(F.broadcast(first), ["rep", "_t"], "left_semi").select("rep", "metabolite", "g1", "g2")  # one row a replicate


def pair_names(members: DataFrame) -> DataFrame:
    """Each pair as a metabolite of its own, ``name-g1_g2``."""
    return members.select(F.concat("metabolite", F.lit("-"), "g1", F.lit("_"), "g2").alias("metabolite"), "g1", "g2")


def next_run(names: list[str]) -> int:
    """One past the highest ``run_N`` among names."""
    import re

    return max((int(m[1]) for n in names if (m := re.fullmatch(r"run_(\d+)", n))), default=0) + 1


def params_slug(method: str, penalty: float, l1_ratio: float = 0.5, standardize: bool = True) -> str:
    """File name of a fit's settings."""
    num = lambda x: format(x, "g").replace(".", "p").replace("-", "m").replace("+", "")
    return f"{method}_p{num(penalty)}" + (f"_l{num(l1_ratio)}" if method == "elastic" else "") + ("" if standardize else "_nostd")


def run_grid(targets: DataFrame, specs: DataFrame, penalties: list[float], done: DataFrame | None = None) -> DataFrame:
    """(target, label, penalty, ...): every run of targets by specs by penalties that is not done yet."""
    grid = targets.select("target").distinct().crossJoin(if_small(specs)).withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))  # a product is what is asked for
    return grid if done is None else grid.join(done.select("target", "label", "penalty"), ["target", "label", "penalty"], "left_anti")


def type_specs(types: list[str], column: str, covariates: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
    """(label, column, value, covariate) of runs on all types pooled and on each alone."""
    out = [("all_pooled" if c is None else f"all_pooled_cov_{c}", column, None, c) for c in covariates] if len(types) > 1 else []
    return out + [(f"{t}_only", column, t, None) for t in types]


# ---------------------------------------------------------------- viewer


def is_selected(fdr: Column, c: Column, threshold: float = 0.05) -> Column:
    return F.coalesce((fdr < threshold) & (c > 0), F.lit(False))


def edge_bundle(results: DataFrame, threshold: float | None = None) -> DataFrame:
    """(entity, edges): interfaces (entity, ct1, ct2, fdr, c) of each entity, strongest first."""
    r = results if threshold is None else results.where(is_selected(F.col("fdr"), F.col("c"), threshold))
    edges = F.sort_array(F.collect_list(F.struct(F.abs("c").alias("size"), F.col("ct1").alias("source"), F.col("ct2").alias("target"), "fdr", "c")), asc=False)
    return r.groupBy("entity").agg(edges.alias("edges"))


def ranked_metabolites(entities: DataFrame, tier: str) -> DataFrame:
    """Places of metabolites (id, global_significant, n_sig_gene_pairs_global, tiers map of (tcell_involved, n_sig_pairs)) in a tier's list.

    Those that are significant nowhere come last; then by involvement, number of pairs, own significance and pairs; ties by id.
    """
    t = F.try_element_at(F.col("tiers"), F.lit(tier))
    involved, n = F.coalesce(t["tcell_involved"], F.lit(False)), F.coalesce(t["n_sig_pairs"], F.lit(0))
    score = F.when(involved, 1_000_000).otherwise(0) + n * 1000 + F.when(F.col("global_significant"), 100).otherwise(0) + F.coalesce("n_sig_gene_pairs_global", F.lit(0))
    anywhere = F.col("global_significant") | (F.coalesce("n_sig_gene_pairs_global", F.lit(0)) > 0) | F.exists(F.map_values("tiers"), lambda x: F.coalesce(x["tcell_involved"], F.lit(False)) | (F.coalesce(x["n_sig_pairs"], F.lit(0)) > 0))
    e = entities.select("id", score.alias("score"), (~F.coalesce(anywhere, F.lit(False))).alias("eliminated"), involved.alias("involved"))
    return e.withColumn("rank", F.row_number().over(Window.orderBy("eliminated", F.desc("score"), "id")))  # a list to show


def ranked_pairs(pairs: DataFrame, results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Places of gene pairs (id, n_metabolites) by significant interfaces (id in either order, fdr, c), then metabolites, then id; none last."""
    part = lambda c: F.split(c, "__", 2)
    key = lambda c: F.concat(F.least(part(c)[0], part(c)[1]), F.lit("__"), F.greatest(part(c)[0], part(c)[1]))
    n = results.where(is_selected(F.col("fdr"), F.col("c"), threshold)).groupBy(key(F.col("id")).alias("_k")).agg(F.count("*").alias("n_sig"))
    p = pairs.withColumn("_k", key(F.col("id"))).join(n, "_k", "left").fillna(0, ["n_sig"]).drop("_k").withColumn("eliminated", F.col("n_sig") == 0)
    return p.withColumn("rank", F.row_number().over(Window.orderBy("eliminated", F.desc("n_sig"), F.desc("n_metabolites"), "id")))


def beta_scale(values: DataFrame, value: str, decades: float = 4.0) -> DataFrame:
    """``values`` with ``scaled`` in [0, 1]: the log of a size over the floor, ``decades`` below the largest of all; at or under it 0."""
    top = values.agg(F.max(F.abs(value))).first()[0] or 0.0
    floor = top / 10**decades
    size = F.abs(F.col(value))
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(size) - F.log10(F.lit(floor or 1.0))) / decades))
    return values.withColumn("scaled", F.when(F.col(value).isNull() | (F.lit(top) == 0) | (size <= floor), 0.0).otherwise(ramp))


def edge_widths(edges: DataFrame, value: str, least: float = 2.0, most: float = 15.0) -> DataFrame:
    """``edges`` with ``width``: log1p of the strength (0 at least) from the least to the most there; without spread the most."""
    v = F.greatest(F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0)), F.lit(0.0))
    lo, hi = edges.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return edges.withColumn("width", F.lit(most))
    a, b = F.log1p(F.lit(float(lo))), F.log1p(F.lit(float(hi)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log1p(v) - a) / (b - a))) if hi > lo else F.lit(1.0)
    return edges.withColumn("width", F.lit(least) + (most - least) * t)


def beta_blocks(rows: DataFrame) -> DataFrame:
    """(cell_type, feature, n, peak, means map by gene, place): rows (cell_type, a, b, gene, mean, n) by feature and type, largest size first."""
    feature = F.concat("a", F.lit("__"), F.coalesce("b", F.lit("")))
    g = rows.groupBy("cell_type", feature.alias("feature")).agg(F.max("n").alias("n"), F.max(F.abs(F.coalesce("mean", F.lit(0.0)))).alias("peak"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("gene", "mean")))).alias("means"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("peak"), "feature")))


def selected_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows (a, b, ...) whose feature ``a__b`` is chosen."""
    return rows.where(F.concat("a", F.lit("__"), F.coalesce("b", F.lit(""))).isin(features))
