"""Readers and writers: long tables in Parquet, pair tables in CSV, selections in YAML or JSON, peaks in BED."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TARGET = r"^(.+)_betadata\.parquet$"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths under a folder or glob, by any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    out = []
    for s in found or []:
        for f in fs.listStatus(s.getPath()) if s.isDirectory() and not s.getPath().getName().endswith(".parquet") else [s]:
            out.append(f.getPath().toString())
    return sorted(out)


def beta_files(spark: SparkSession, path: str, genes: list[str] | None = None) -> DataFrame:
    """(target, path) of the coefficient files of a folder or glob, of the given targets if any."""
    import re
    from urllib.parse import unquote

    rows = [(m[1], f) for f in _files(spark, path) if (m := re.match(_TARGET, unquote(f.rpartition("/")[2])))]
    return spark.createDataFrame([r for r in rows if genes is None or r[0] in set(genes)], "target string, path string")


def read_wide_betas(spark: SparkSession, path: str, group: str | None = None, genes: list[str] | None = None, cells: DataFrame | None = None, single: bool = False, seed: int | None = None) -> DataFrame:
    """Long (target, cell column, modulator, grp, beta) from ``{gene}_betadata.parquet`` files; only the wanted group's columns are read.

    Each file is read by its own schema, so a column of one target costs the others nothing.  ``cells`` keeps the rows whose first column
    is in its ``cell_id``; ``single`` rounds to single precision; ``seed`` puts standard normal numbers, alike in reruns, in place of the
    coefficients.
    """
    from tessella.functions.scalars import modulator_group

    pick = {"metab": lambda c: "@" in c, "lr": lambda c: "@" not in c and "$" in c, "ltf": lambda c: "@" not in c and "$" not in c and "#" in c, "tf": lambda c: not set(c) & set("@$#")}
    files = {r["target"]: r["path"] for r in beta_files(spark, path, genes).collect()}  # one entry a target
    schemas: dict[tuple, list[str]] = {}
    for f in files.values():
        schemas.setdefault(tuple(spark.read.parquet(f).columns), []).append(f)
    out = None
    for columns, paths in schemas.items():
        names = [c for c in columns if c == "beta0" or c.startswith("beta_")]
        ids = [c for c in columns if c not in names]
        if group:
            names = [c for c in names if c != "beta0" and pick[group](c)]
        if not names:
            continue
        # a target's table is one file, or a folder of part files
        target = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_betadata\.parquet(?:/[^/]*)?$", 1))
        rows = spark.read.parquet(*paths).select(target.alias("target"), *[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
        if cells is not None:
            rows = rows.join(cells.select(F.col("cell_id").alias(ids[0])), ids[0], "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])
        long = rows.unpivot(["target", *ids], [F.col(f"`{c}`") for c in names], "modulator", "beta").where("beta is not null")
        out = long if out is None else out.unionByName(long, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "target string, cell string, modulator string, beta double, grp string")
    out = out.withColumn("modulator", F.when(F.col("modulator") == "beta0", "(intercept)").otherwise(F.regexp_replace("modulator", "^beta_", "")))
    if seed is not None:
        u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "target", "modulator", F.col(out.columns[1])), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        out = out.withColumn("beta", F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1)))
    if single:
        out = out.withColumn("beta", F.col("beta").cast("float"))
    return out.withColumn("grp", modulator_group(F.col("modulator")))


def beta_catalogue(betas: DataFrame, genes: DataFrame) -> DataFrame:
    """(kind, gene, index): ligands, receptors and regulators that the modulators of all targets name, with their place among ``genes`` in name order."""
    from pyspark.sql import Window

    m = betas.where("modulator <> '(intercept)' and grp <> 'metab'").select("modulator", "grp").distinct()
    part = F.split("modulator", "[$#]", 2)
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("gene"))
    ends = F.when(F.col("grp") == "lr", F.array(entry("ligand", part[0]), entry("receptor", F.get(part, F.lit(1))))).when(F.col("grp") == "ltf", F.array(entry("tfl_ligand", part[0]), entry("tfl_regulator", F.get(part, F.lit(1))))).otherwise(F.array(entry("tf", F.col("modulator"))))
    at = genes.select("gene").distinct().withColumn("index", (F.row_number().over(Window.orderBy("gene")) - 1).cast("long"))  # one row a gene
    return m.select(F.explode(ends).alias("e")).select("e.kind", "e.gene").distinct().join(at, "gene", "left").select("kind", "gene", "index")


def write_betas(betas: DataFrame, path: str) -> None:
    """Betas by target, without (target, modulator) columns that are zero throughout."""
    live = betas.groupBy("target", "modulator").agg(F.max((F.col("beta") != 0).cast("int")).alias("any")).where("any = 1").select("target", "modulator")
    betas.join(live, ["target", "modulator"], "left_semi").write.partitionBy("target").mode("overwrite").parquet(path)


def orphans(betas: DataFrame) -> DataFrame:
    """Targets without any coefficient other than zero."""
    return betas.groupBy("target").agg(F.max((F.col("beta") != 0).cast("int")).alias("any")).where("any = 0").select("target", F.lit("all coefficients are zero").alias("reason"))


def read_pairs_csv(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """ligand, receptor, pathway, signaling, ord, in the order of files by name and of rows in them; with ``species`` from ``{species}_pairs.csv``
    in the folder.  Columns are found by their place."""
    files = _files(spark, f"{path.rstrip('/')}/{species}_pairs.csv" if species else path)
    cols = "ligand string, receptor string, pathway string, signaling string"
    out = None
    for k, f in enumerate(files):
        one = spark.read.csv(f, header=True, schema=cols).withColumn("ord", F.lit(k).cast("long") * (1 << 42) + F.monotonically_increasing_id())
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], cols + ", ord long")


def read_base_grn(spark: SparkSession, path: str) -> DataFrame:
    """Long (target, tf, flag) from a wide table peak_id, gene_short_name, one column a factor; zeros are left out."""
    wide = spark.read.parquet(path)
    tfs = [c for c in wide.columns if c not in ("peak_id", "gene_short_name")]
    rows = wide.select("peak_id", F.col("gene_short_name").alias("target"), *[F.col(f"`{c}`").cast("double").alias(c) for c in tfs])
    return rows.unpivot(["peak_id", "target"], [F.col(f"`{c}`") for c in tfs], "tf", "flag").where("flag <> 0").select("peak_id", "target", "tf", "flag")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Long (tf, ligand, weight) from a matrix with factors in the first column and a column a ligand, from a local or shared path."""
    wide = spark.read.parquet(path)
    key, *ligands = wide.columns
    rows = wide.select(F.col(f"`{key}`").alias("tf"), *[F.col(f"`{c}`").cast("double").alias(c) for c in ligands])
    return rows.unpivot(["tf"], [F.col(f"`{c}`") for c in ligands], "ligand", "weight").where("weight is not null")


def read_promoter_grn(spark: SparkSession, folder: str, organism: str, version: str = "") -> DataFrame:
    """The base network of one organism, from ``{organism}{version}_promoter_base_grn.parquet`` in a folder."""
    return read_base_grn(spark, f"{folder.rstrip('/')}/{organism}{version}_promoter_base_grn.parquet")


LINK_COLUMNS = "cluster string, source string, target string, coef_mean double, coef_abs double, p double, neg_log_p double"


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link tables of all clusters, in Parquet; columns that a file lacks are null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    have = {c.lower(): c for c in df.columns}
    cols = [x.split() for x in LINK_COLUMNS.split(", ")]
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in cols])


def read_annotated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an annotated matrix that ``sinks.write_annotated`` wrote, by name."""
    return {f.rstrip("/").rpartition("/")[2].removesuffix(".parquet"): spark.read.parquet(f) for f in _files(spark, f"{folder.rstrip('/')}/*.parquet")}


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Metabolite selections, list or mapping layout, as rows (metabolite, g1, g2, pos); repeated names accumulate."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    data = data.get("metabolites", data)
    items = [(m["name"], m["gene_pairs"]) for m in data] if isinstance(data, list) else [(k, v["gene_pair"]) for k, v in data.items()]
    seen: dict[str, int] = {}
    rows = []
    for name, pairs in items:
        for a, b in pairs:
            rows.append((name, a, b, seen.get(name, 0)))
            seen[name] = seen.get(name, 0) + 1
    return spark.createDataFrame(rows, "metabolite string, g1 string, g2 string, pos int")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, name string, score string, strand string")


def peak_columns(df: DataFrame, peak: str = "peak_id") -> DataFrame:
    """``chr_start_end`` to columns; names of chromosomes may hold underscores."""
    part = lambda k: F.regexp_extract(peak, r"^(.+)_(\d+)_(\d+)$", k)
    return df.withColumns({"chrom": part(1), "start": part(2).cast("long"), "end": part(3).cast("long")})


def peak_strings(df: DataFrame, out: str = "peak_id") -> DataFrame:
    """``chrom``, ``start``, ``end`` to ``chr_start_end``."""
    return df.withColumn(out, F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string")))


def discover_tiers(spark: SparkSession, folder: str, needed: list[str]) -> DataFrame:
    """(tier, available, missing) of each subfolder: whether it has all the needed files; an incomplete run is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()) if fs.exists(p) else []:
        if s.isDirectory():
            have = {f.getPath().getName() for f in fs.listStatus(s.getPath())}
            missing = [n for n in needed if n not in have]
            rows.append((s.getPath().getName(), not missing, missing))
    return spark.createDataFrame(rows, "tier string, available boolean, missing array<string>")


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result tables: index column dropped, ``metabolite`` spelled one way, ``selected`` boolean."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    df = df.drop(*[c for c in df.columns if c in ("", "_c0", "Unnamed: 0")])
    if "Metabolite" in df.columns:
        df = df.withColumnRenamed("Metabolite", "metabolite")
    return df.withColumn("selected", F.lower(F.col("selected").cast("string")) == "true") if "selected" in df.columns else df
