"""Writers: selections, result tables, networks, bundles and tables of an annotated matrix.

Small results are written as one file by the driver; tables by Spark, whose committer makes a write appear whole or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import modulator_group


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by any file system that Spark writes: under a name of its own first, then moved, so no reader sees a part of it."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{jvm.java.util.UUID.randomUUID().toString()}")
    out = fs.create(part, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"could not move {part.toString()} to {path}")


def write_csv(df: DataFrame, path: str, order: list[Column | str] = ()) -> None:
    """A result table as CSV with a header, rows in order."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def selection_entries(members: DataFrame, significant: DataFrame | None = None, names: list[str] | None = None) -> list[dict]:
    """Entries {name, gene_pairs} in name order: members (metabolite, g1, g2, pos), of chosen names, only pairs that are significant (g1, g2)."""
    m = members if names is None else members.where(F.col("metabolite").isin(list(names)))
    if significant is not None:
        key = lambda a, b: F.concat(F.least(a, b), F.lit("__"), F.greatest(a, b))
        every = m.select("metabolite").distinct()
        m = every.join(m.withColumn("_k", key("g1", "g2")).join(significant.select(key("g1", "g2").alias("_k")).distinct(), "_k", "left_semi").drop("_k"), "metabolite", "left")
    rows = m.groupBy("metabolite").agg(F.array_sort(F.collect_list(F.when(F.col("g1").isNotNull(), F.struct("pos", "g1", "g2")))).alias("p")).orderBy("metabolite").collect()
    return [{"name": r["metabolite"], "gene_pairs": [[p["g1"], p["g2"]] for p in r["p"]]} for r in rows]


def write_selection(members: DataFrame, path: str, significant: DataFrame | None = None, names: list[str] | None = None, mapping: bool = False) -> None:
    """A selection as YAML, or JSON where the path ends so; ``mapping`` writes the layout {name: {gene_pair}}."""
    entries = selection_entries(members, significant, names)
    data = {e["name"]: {"gene_pair": e["gene_pairs"]} for e in entries} if mapping else {"metabolites": entries}
    if path.endswith(".json"):
        text = json.dumps(data)
    else:
        import yaml

        text = yaml.safe_dump(data, sort_keys=False)
    write_text(members.sparkSession, path, text)


def write_results(results: dict[str, DataFrame], folder: str, tier: str | None = None) -> None:
    """Each result as a CSV of its name in the folder, or in the tier's folder."""
    for name, df in results.items():
        write_csv(df, "/".join(x for x in (folder.rstrip("/"), tier, f"{name}.csv") if x))


def network_json(members: DataFrame) -> dict:
    """Counts, genes and pairs of a metabolite network (metabolite, g1, g2)."""
    pairs = [(r["g1"], r["g2"]) for r in members.select("g1", "g2").distinct().orderBy("g1", "g2").collect()]
    per: dict[str, list] = {}
    for r in members.distinct().orderBy("metabolite", "g1", "g2").collect():
        per.setdefault(r["metabolite"], []).append([r["g1"], r["g2"]])
    genes = sorted({g for p in pairs for g in p})
    return {"num_transporter_genes": len(genes), "num_metab": len(per), "num_gp": len(pairs), "metabolite_pair_counts": {k: len(v) for k, v in per.items()}, "transporter_genes": genes, "gp": [list(p) for p in pairs], "gp_per_metabolite": {k: {"gene_pair": v} for k, v in per.items()}}


def write_network(members: DataFrame, path: str) -> None:
    write_text(members.sparkSession, path, json.dumps(network_json(members)))


# File names and columns of each group's table.
GROUP_FILES = {"metab": ("metabolites", "metabolite", None), "lr": ("ligand_receptor", "ligand", "receptor"), "ltf": ("ligand_tf", "ligand", "tf"), "tf": ("transcription_factor", "tf", None)}


def group_table(stats: DataFrame, group: str) -> DataFrame:
    """Statistics (gene, modulator, cell_type, mean, std, n) of one group with its modulator in columns of their own."""
    _, one, two = GROUP_FILES[group]
    s = stats.where(modulator_group(F.col("modulator")) == group)
    end = ["cell_type", "mean", "std", "n"]
    if group == "metab":
        return s.select("gene", F.regexp_replace("modulator", "^metab@", "").alias(one), *end)
    if two is None:
        return s.where("modulator <> '(intercept)'").select("gene", F.col("modulator").alias(one), *end)
    part = F.split("modulator", "[$]" if group == "lr" else "#", 2)
    return s.select("gene", part[0].alias(one), part[1].alias(two), F.col("modulator").alias("pair"), *end)


def write_groups(stats: DataFrame, folder: str, tier: str, groups: list[str] = ("metab", "lr", "ltf", "tf")) -> None:
    for g in groups:
        write_csv(group_table(stats, g), f"{folder.rstrip('/')}/{tier}/{GROUP_FILES[g][0]}.csv")


def write_perturbed(values: DataFrame, folder: str, target: str, hops: int, level: float | None) -> str:
    """(cell_id, gene, value) after a perturbation, under a name of target, hops and level (none: its largest); the path."""
    path = f"{folder.rstrip('/')}/{target}_{hops}n_{'max' if level is None else format(level, 'g')}x.parquet"
    values.write.mode("overwrite").parquet(path)
    return path


def write_screen(values: DataFrame, folder: str) -> None:
    """(ko_gene, cell_id, gene, value) of many perturbations, a folder each."""
    values.write.mode("overwrite").partitionBy("ko_gene").parquet(folder)


def write_bundle(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    """Tables as JSON lines in the folder of a data set, with a manifest of their names and rows."""
    spark = next(iter(tables.values())).sparkSession
    base, rows = f"{folder.rstrip('/')}/{name}", {}
    for key, df in tables.items():
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{base}/{key}")
        rows[key] = df.count()
    write_text(spark, f"{base}/manifest.json", json.dumps({"name": name, "tables": rows}))


def write_annotated(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of an annotated matrix (obs, var, layers, graphs) as Parquet, one folder each; read by ``readers.read_annotated``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_motifs(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of a motif scan (hits, motifs, tss) in a folder, like ``write_annotated``."""
    write_annotated(tables, folder)


def write_links(links: DataFrame, folder: str) -> None:
    links.write.mode("overwrite").partitionBy("cluster").parquet(folder)
