"""The store of factors that regressions read, and what a target's design takes from it."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.lineage import cut, if_small
from tessella.operators.factors import TIE_DIGITS, base_regulators, known_pairs, top_then_back_fill
from tessella.operators.spatial import ligand_radii, received, received_by_radius
from tessella.operators.tables import receptor_filter


def first_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (ligand, receptor), each with its first row's columns in the order of ``ord``."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("ligand", "receptor").orderBy("ord"))).where("_r = 1").drop("_r")


def expand_complexes(pairs: DataFrame, sep: str = "_") -> DataFrame:
    """Rows for each member of a ligand or receptor made of several genes."""
    return pairs.withColumn("ligand", F.explode(F.split("ligand", sep))).withColumn("receptor", F.explode(F.split("receptor", sep)))


def factor_map(genes: DataFrame, grn: DataFrame, pairs: DataFrame, weights: DataFrame, targets: DataFrame, cutoff: float = 0.01, k: int = 5) -> DataFrame:
    """(target, factor, kind, pos): regulators, then pairs, then for each regulator its k heaviest ligands, none with the target itself.

    grn: (target, tf, flag); pairs: (ligand, receptor, ord) that passed their filters; weights: (tf, ligand, weight).
    """
    t = targets.select("target").distinct()
    tfs = base_regulators(grn.join(t, "target", "left_semi"), genes)
    plain = tfs.select("target", F.col("tf").alias("factor"), F.lit(0).alias("_k"), F.struct(F.col("tf").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c")).alias("_o"))
    lr = known_pairs(pairs.select("ligand", "receptor", "ord"), genes, t)
    both = lr.select("target", F.concat("ligand", F.lit("$"), "receptor").alias("factor"), F.lit(1).alias("_k"), F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.col("ord").cast("long").alias("c")).alias("_o"))
    w = weights.join(pairs.select("ligand").distinct(), "ligand", "left_semi").join(tfs, "tf").where("ligand <> target")
    weight = F.round("weight", TIE_DIGITS)
    order = Window.partitionBy("target", "tf").orderBy(weight.desc(), "ligand")
    top = w.where(weight > cutoff).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    ltf = top.select("target", F.concat("ligand", F.lit("#"), "tf").alias("factor"), F.lit(2).alias("_k"), F.struct(F.col("tf").alias("a"), F.lit("").alias("b"), F.col("_n").cast("long").alias("c")).alias("_o"))
    every = plain.union(both).union(ltf)
    pos = F.row_number().over(Window.partitionBy("target").orderBy("_k", "_o", "factor"))
    return every.select("target", "factor", F.element_at(F.array(F.lit("tf"), F.lit("lr"), F.lit("ltf")), F.col("_k") + 1).alias("kind"), pos.cast("long").alias("pos"))


def factor_values(map_: DataFrame, expr: DataFrame, got: DataFrame) -> DataFrame:
    """(cell_id, factor, x): a regulator's expression, or a ligand received times its partner's expression; each factor once for all targets.

    Absent entries are 0, so a factor that is 0 in every cell has no row.  Values are rounded to single precision.  What a cell expresses and what it
    receives meet once, as arrays, and factors are made there: no row of a cell and factor is shuffled.
    """
    f = map_.select("factor").distinct().withColumns({"_l": F.split("factor", "[$#]")[0], "_p": F.get(F.split("factor", "[$#]"), F.lit(1))})
    f = if_small(f)  # names of factors
    plain = expr.withColumnRenamed("gene", "_l").join(f.where("_p is null"), "_l").select("cell_id", "factor", F.col("value").cast("double").alias("x"))
    entry = lambda df, own: df.select("cell_id", F.struct(F.lit(own).alias("own"), "gene", F.col("value").cast("double").alias("v")).alias("_e"))
    partner = f.where("_p is not null")
    rows = entry(expr.join(partner.select(F.col("_p").alias("gene")).distinct(), "gene", "left_semi"), True).unionByName(entry(got.join(partner.select(F.col("_l").alias("gene")).distinct(), "gene", "left_semi"), False))
    cell = rows.where("cell_id is not null").groupBy("cell_id").agg(F.collect_list("_e").alias("_e"))
    own, met = (F.filter("_e", lambda e: e["own"]), F.filter("_e", lambda e: ~e["own"]))
    one = cell.select("cell_id", F.explode(own).alias("_o"), met.alias("_r")).select("cell_id", F.col("_o.gene").alias("_p"), F.col("_o.v").alias("_v"), "_r").join(partner, "_p")
    both = one.select("cell_id", "factor", "_v", F.explode(F.filter("_r", lambda e: e["gene"] == F.col("_l"))).alias("_w")).select("cell_id", "factor", (F.col("_w.v") * F.col("_v")).alias("x"))
    return plain.union(both).withColumn("x", F.col("x").cast("float").cast("double")).where("x <> 0")


def build_store(cells: DataFrame, expr: DataFrame, grn: DataFrame, pairs: DataFrame, weights: DataFrame, targets: DataFrame, secreted: float = 300.0, contact: float = 50.0, least_receptor: float = 0.01, cutoff: float = 0.01, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(values (cell_id, factor, x), map (target, factor, kind, pos, n)) of the targets that are expressed genes; n counts a factor's values,
    and factors without one go.

    Radii come from a ligand's first row among known genes, before receptors are filtered.  Values are not written here: whoever reads
    them more than once does so.
    """
    genes = expr.select("gene").distinct()
    t = targets.join(genes.withColumnRenamed("gene", "target"), "target", "left_semi")
    known = known_pairs(pairs, genes)
    radii = ligand_radii(known, secreted, contact)
    good = receptor_filter(expr, cells, least_receptor).select(F.col("gene").alias("receptor"))
    kept = first_pairs(known.join(good, "receptor", "left_semi"))
    map_ = cut(factor_map(genes, grn, kept, weights, t, cutoff))
    ligands = map_.where("kind <> 'tf'").select(F.split("factor", "[$#]")[0].alias("gene")).distinct()
    got = received_by_radius(cells, expr, radii.join(ligands, "gene", "left_semi"), cells.count(), scale)
    got = cut(got.groupBy("cell_id").agg(F.collect_list(F.struct("gene", "value")).alias("_e"))).select("cell_id", F.explode("_e").alias("_e")).select("cell_id", "_e.gene", "_e.value")
    values = factor_values(map_, expr, got)
    there = if_small(values.groupBy("factor").agg(F.count("*").alias("n")))
    return values, map_.join(there, "factor").select(*map_.columns, "n")


def gene_design(map_: DataFrame, target: str, metabolites: DataFrame | None = None, metabs: list[str] | str | None = None, customs: DataFrame | None = None, custom: list[str] | str | None = None) -> DataFrame:
    """(target, factor, pos) of one target: its own factors, then chosen metabolites, then chosen custom columns.

    metabolites, customs: (factor, pos) of what is stored; "all" takes them all.  An unknown metabolite is warned about, an unknown custom
    column or target is an error.
    """
    own = map_.where(F.col("target") == target).select("target", "factor", F.struct(F.lit(0).alias("k"), F.col("pos").cast("long").alias("p")).alias("_o"))
    if own.isEmpty():
        raise KeyError(f"{target!r} is not in the store")

    def chosen(have: DataFrame | None, want, k: int, strict: bool, bare) -> DataFrame | None:
        if want is None or have is None:
            return None
        rows = {r["factor"]: r["pos"] for r in have.collect()}  # names of stored columns
        names = sorted(rows, key=rows.get) if want in ("all", True) else []
        for name in () if want in ("all", True) else want:
            full = name if name in rows else bare(name)
            if full in rows:
                names.append(full)
            elif strict:
                raise ValueError(f"custom column {name!r} is not stored")
            else:
                warnings.warn(f"metabolite {name!r} is not stored", stacklevel=3)
        return map_.sparkSession.createDataFrame([(target, f, (k, i)) for i, f in enumerate(names)], "target string, factor string, _o struct<k:int,p:bigint>")

    for part in (chosen(metabolites, metabs, 1, False, lambda n: f"metab@{n}"), chosen(customs, custom, 2, True, lambda n: n)):
        own = own if part is None else own.union(part)
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("target").orderBy("_o", "factor")).cast("long")).drop("_o")


def merge_custom(have: DataFrame, new: DataFrame) -> DataFrame:
    """Custom columns (cell_id, factor, x) with those of ``new`` whose names are not there yet."""
    return have.unionByName(new.join(have.select("factor").distinct(), "factor", "left_anti").select(*have.columns))


def expression_factors(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_id, factor, x) of the genes' own expression; genes that nobody expresses have no row."""
    return expr.join(genes.select("gene").distinct(), "gene", "left_semi").select("cell_id", F.col("gene").alias("factor"), F.col("value").alias("x"))


def pattern_genes(expr: DataFrame, pattern: str) -> DataFrame:
    """Genes whose whole name matches a pattern."""
    return expr.select("gene").distinct().where(F.col("gene").rlike(f"^({pattern})$"))


def neighbourhood_scores(cells: DataFrame, expr: DataFrame, sets: DataFrame, radius: float, scale: float = 1.0, by_type: bool = False, proximity: bool = False) -> DataFrame:
    """(cell_id, factor, x): what a cell receives of the summed expression of each set (name, gene).

    ``by_type`` splits it by the senders' type into columns ``type-name``; ``proximity`` adds ``type-proximity``, with 1 sent by each cell.
    """
    n = cells.count()
    sent = expr.join(sets.select("name", "gene").distinct(), "gene").groupBy("cell_id", F.col("name").alias("gene")).agg(F.sum("value").alias("value"))
    t = cells.select("cell_id", "cell_type")
    if by_type:
        sent = sent.join(t, "cell_id").select("cell_id", F.concat("cell_type", F.lit("-"), "gene").alias("gene"), "value")
    if proximity:
        sent = sent.unionByName(t.select("cell_id", F.concat("cell_type", F.lit("-proximity")).alias("gene"), F.lit(1.0).alias("value")))
    return received(cells, sent, radius, n, scale).select("cell_id", F.col("gene").alias("factor"), F.col("value").alias("x"))


def signature_factors(map_: DataFrame, members: DataFrame, mode: str = "union") -> DataFrame:
    """(name, factor, pos): factors of the members (name, gene, ord) of each signature, in the order of first sight.

    "union": of any member; "intersection": of all members that have factors, in the first one's order.
    """
    if mode not in ("union", "intersection"):
        raise ValueError('mode must be "union" or "intersection"')
    m = members.groupBy("name", "gene").agg(F.min("ord").alias("ord")).join(map_.select(F.col("target").alias("gene"), "factor", "pos"), "gene")
    seen = m.groupBy("name", "factor").agg(F.min(F.struct("ord", "pos")).alias("_o"), F.count_distinct("gene").alias("_n"))
    if mode == "intersection":
        n = m.groupBy("name").agg(F.count_distinct("gene").alias("_all"))
        seen = seen.join(n, "name").where("_n = _all")
    return seen.select("name", "factor", F.row_number().over(Window.partitionBy("name").orderBy("_o", "factor")).cast("long").alias("pos"))


def count_columns(covariates: DataFrame) -> DataFrame:
    """Count covariates (cell_id, total, n_genes) as custom columns."""
    return covariates.select("cell_id", F.explode(F.array(F.struct(F.lit("n_total_transcripts").alias("f"), F.col("total").cast("double").alias("x")), F.struct(F.lit("n_total_genes").alias("f"), F.col("n_genes").cast("double").alias("x")))).alias("e")).select("cell_id", F.col("e.f").alias("factor"), F.col("e.x").alias("x"))


def filled(values: DataFrame, rows: DataFrame, names: DataFrame) -> DataFrame:
    """(cell_id, factor, x) with a row for every cell and name, absent ones as 0: the dense form that a sparse one stands for."""
    return rows.select("cell_id").crossJoin(if_small(names.select("factor").distinct())).join(values, ["cell_id", "factor"], "left").fillna(0.0, ["x"])  # names are few


def paired_samples(tables: dict[str, DataFrame], common: bool = False) -> DataFrame:
    """Long tables (cell_id, factor, x) of several samples under one another with ``sample``; ``common`` keeps factors that all have."""
    out, shared = None, None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("sample"), "cell_id", "factor", "x")
        names = df.select("factor").distinct()
        out, shared = (one, names) if out is None else (out.unionByName(one), shared.intersect(names))
    return out.join(shared, "factor", "left_semi").select("sample", "cell_id", "factor", "x") if common else out


def back_filled(weights: DataFrame, cutoff: float, k: int) -> DataFrame:
    return top_then_back_fill(weights, cutoff, k)
