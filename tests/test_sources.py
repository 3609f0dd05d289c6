"""Readers and writers: what is written comes back, whatever the names."""

import json

import pytest

from tessella.operators import design as G
from tessella.operators import results as R
from tessella.operators import tables as T
from tessella.sources import readers, sinks
from tessella.sources.simulator import simulate


def betas(spark, path):
    spark.createDataFrame([("c0", 1.0, 2.0, 0.5, 3.0), ("c1", 0.0, 0.0, 0.25, 1.0)], "cell string, beta0 double, `beta_metab@G` double, `beta_A$B` double, beta_TF double").write.parquet(f"{path}/CD_4_betadata.parquet")
    spark.createDataFrame([("c0", 2.0, 7.0)], "cell string, beta0 double, `beta_L#TF` double").write.parquet(f"{path}/X_betadata.parquet")


def test_coefficients(spark, tmp_path):
    path = str(tmp_path / "b")
    betas(spark, path)
    assert {r.target for r in readers.beta_files(spark, path).collect()} == {"CD_4", "X"}
    assert {r.target for r in readers.beta_files(spark, path, ["X"]).collect()} == {"X"}
    whole = readers.read_wide_betas(spark, path)
    assert whole.count() == 10 and {r.modulator for r in whole.where("target = 'X'").collect()} == {"(intercept)", "L#TF"}
    some = readers.read_wide_betas(spark, path, cells=spark.createDataFrame([("c1",)], "cell_id string"), single=True)
    assert {r.modulator: r.beta for r in some.collect()} == {"(intercept)": 0.0, "metab@G": 0.0, "A$B": 0.25, "TF": 1.0}
    a, b = (sorted((r.target, r.cell, r.modulator, r.beta) for r in readers.read_wide_betas(spark, path, seed=4).collect()) for _ in range(2))
    assert a == b and len({x[3] for x in a}) == 10
    cat = {(r.kind, r.gene): r["index"] for r in readers.beta_catalogue(whole, spark.createDataFrame([(g,) for g in ("TF", "A", "B")], "gene string")).collect()}
    assert cat == {("ligand", "A"): 0, ("receptor", "B"): 1, ("tf", "TF"): 2, ("tfl_ligand", "L"): None, ("tfl_regulator", "TF"): 2}
    kept = str(tmp_path / "kept")
    readers.write_betas(whole.withColumnRenamed("cell", "cell_id"), kept)
    assert ("CD_4", "metab@G") in {(r.target, r.modulator) for r in spark.read.parquet(kept).collect()}
    zero = spark.createDataFrame([("t", "c", "m", 0.0)], "target string, cell_id string, modulator string, beta double")
    assert [r.target for r in readers.orphans(zero).collect()] == ["t"]


def test_pairs_keep_the_order_of_files(spark, tmp_path):
    for name, rows in (("b", "L3,R3,p,Secreted Signaling\n"), ("a", "L1,R1,p,Secreted Signaling\nL2,R2,q,Cell-Cell Contact\nL1,R9,p,Cell-Cell Contact\n")):
        (tmp_path / f"{name}_pairs.csv").write_text("ligand,receptor,pathway,signaling\n" + rows)
    got = [r.ligand for r in readers.read_pairs_csv(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == ["L1", "L2", "L1", "L3"]
    one = readers.read_pairs_csv(spark, str(tmp_path), "a")
    from tessella.operators.spatial import ligand_radii

    assert {r.gene: r.radius for r in ligand_radii(one, 300.0, 50.0).collect()} == {"L1": 300.0, "L2": 50.0}
    assert G.first_pairs(one.union(one)).count() == 3


def test_networks_and_matrices(spark, tmp_path):
    spark.createDataFrame([("p1", "T", 1, 0), ("p2", "T", 0, 0)], "peak_id string, gene_short_name string, A int, B int").write.parquet(str(tmp_path / "fly_promoter_base_grn.parquet"))
    assert [(r.target, r.tf) for r in readers.read_promoter_grn(spark, str(tmp_path), "fly").collect()] == [("T", "A")]
    spark.createDataFrame([("tf1", 0.5, None)], "tf string, L1 double, L2 double").write.parquet(str(tmp_path / "w"))
    assert [tuple(r) for r in readers.read_weights(spark, str(tmp_path / "w")).collect()] == [("tf1", "L1", 0.5)]
    links = spark.createDataFrame([("c0", "a", "b", 0.5, 0.01)], "cluster string, source string, target string, coef_mean double, p double")
    sinks.write_links(links, str(tmp_path / "l"))
    assert readers.read_links(spark, str(tmp_path / "l")).first()[:4] == ("c0", "a", "b", 0.5)
    sinks.write_annotated({"obs": links, "layer": links.select("p")}, str(tmp_path / "ann"))
    got = readers.read_annotated(spark, str(tmp_path / "ann"))
    assert set(got) == {"obs", "layer"} and got["obs"].count() == 1


def test_selections_go_round(spark, tmp_path):
    m = spark.createDataFrame([("m2", "a", "b", 0), ("m1", "c", "d", 0), ("m1", "e", "f", 1)], "metabolite string, g1 string, g2 string, pos int")
    sig = spark.createDataFrame([("d", "c"), ("a", "b")], "g1 string, g2 string")
    for name, mapping in (("s.yaml", False), ("s.json", False), ("map.yaml", True)):
        sinks.write_selection(m, str(tmp_path / name), mapping=mapping)
        back = readers.read_selection(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))
    assert sinks.selection_entries(m, sig) == [{"name": "m1", "gene_pairs": [["c", "d"]]}, {"name": "m2", "gene_pairs": [["a", "b"]]}]
    assert not [p for p in tmp_path.iterdir() if p.suffix not in (".yaml", ".json", ".crc")]


def test_result_tables_and_bundles(spark, tmp_path):
    s = spark.createDataFrame([("g", m, "ct", 1.0, 0.5, 3) for m in ("metab@a|b", "L$R", "L#T", "TF", "(intercept)")], "gene string, modulator string, cell_type string, mean double, std double, n long")
    sinks.write_groups(s, str(tmp_path), "tier1")
    lr = readers.read_result_csv(spark, str(tmp_path / "tier1" / "ligand_receptor.csv")).first()
    assert (lr.ligand, lr.receptor, lr.pair, lr.n) == ("L", "R", "L$R", 3)
    assert readers.read_result_csv(spark, str(tmp_path / "tier1" / "metabolites.csv")).first().metabolite == "a|b"
    assert readers.read_result_csv(spark, str(tmp_path / "tier1" / "transcription_factor.csv")).count() == 1
    found = {r.tier: (r.available, r.missing) for r in readers.discover_tiers(spark, str(tmp_path), ["metabolites.csv", "x.csv"]).collect()}
    assert found["tier1"] == (False, ["x.csv"])
    pairs = spark.createDataFrame([("m", "a", "b"), ("m", "b", "b"), ("n", "a", "b")], "metabolite string, g1 string, g2 string")
    sinks.write_network(pairs, str(tmp_path / "net.json"))
    net = json.loads((tmp_path / "net.json").read_text())
    assert (net["num_gp"], net["num_metab"], net["metabolite_pair_counts"]) == (2, 2, {"m": 2, "n": 1})
    sinks.write_bundle({"edges": pairs, "none": pairs.limit(0)}, str(tmp_path / "bundle"), "d1")
    assert json.loads((tmp_path / "bundle" / "d1" / "manifest.json").read_text())["tables"] == {"edges": 3, "none": 0}
    path = sinks.write_perturbed(pairs, str(tmp_path), "KO", 4, None)
    assert path.endswith("KO_4n_maxx.parquet") and spark.read.parquet(path).count() == 3
    peaks = spark.createDataFrame([("chr_Un_1", 10, 20)], "chrom string, start long, end long")
    assert readers.peak_columns(readers.peak_strings(peaks).select("peak_id")).select("chrom", "start", "end").first() == ("chr_Un_1", 10, 20)


def test_simulated_coefficients_are_found_again(spark):
    t = simulate(spark, 240, clusters=2, regulators=3)
    v = {r.cell_id: r.value for r in t["expr"].where("gene = 'T'").collect()}
    assert t["cells"].count() == 240 and t["betas"].count() == 720 and min(v.values()) == 0 and max(v.values()) == 1
    parts = {}
    b = {(r.cell_id, r.modulator): r.beta for r in t["betas"].collect()}
    for r in t["expr"].where("gene <> 'T'").collect():
        parts[r.cell_id] = parts.get(r.cell_id, 0) + b[r.cell_id, r.gene] * r.value
    lo, hi = min(parts.values()), max(parts.values())
    assert all(abs((parts[c] - lo) / (hi - lo) - v[c]) < 1e-9 for c in v)


def test_refusals(spark):
    cells = spark.createDataFrame([(i, "big" if i < 95 else "tiny") for i in range(100)], "cell_id long, cell_type string")
    with pytest.raises(ValueError):
        T.drop_tiny(cells, 16)
    assert T.drop_tiny(cells, 16, 0.1).count() == 95
    with pytest.raises(ValueError):
        R.select_cells(cells, "cell_type", ["big", "none"])
    with pytest.warns(UserWarning):
        assert R.select_cells(cells, "cell_type", ["tiny"], [96, 5, 1000]).count() == 1
    genes = spark.createDataFrame([("A",), ("Abc",)], "gene string")
    for focus in ("A", [], ["X"]):
        with pytest.raises(ValueError):
            R.focus_genes(genes, focus)
    map_ = spark.createDataFrame([("T", "A", 1)], "target string, factor string, pos long")
    with pytest.raises(KeyError):
        G.gene_design(map_, "U")
    with pytest.raises(ValueError):
        G.gene_design(map_, "T", customs=spark.createDataFrame([("c", 0)], "factor string, pos int"), custom=["d"])
    with pytest.warns(UserWarning):
        G.gene_design(map_, "T", spark.createDataFrame([("metab@m", 0)], "factor string, pos int"), ["n"])
    assert R.params_slug("elastic", 5e-3, 0.5, False) == "elastic_p0p005_l0p5_nostd" and R.next_run(["run_3", "x", "run_12"]) == 13


def test_result_folders_and_screens(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1, "g", 0.5), ("k2", 1, "g", 1.5)], "ko_gene string, cell_id long, gene string, value double")
    sinks.write_screen(df, str(tmp_path / "screen"))
    assert spark.read.parquet(str(tmp_path / "screen")).where("ko_gene = 'k2'").first().value == 1.5
    sinks.write_results({"one": df, "two": df.limit(0)}, str(tmp_path / "res"), "tierA")
    assert readers.read_result_csv(spark, str(tmp_path / "res" / "tierA" / "one.csv")).count() == 2
    sinks.write_motifs({"hits": df}, str(tmp_path / "motifs"))
    assert readers.read_annotated(spark, str(tmp_path / "motifs"))["hits"].count() == 2


def test_changes_of_each_hop_and_masks(spark, tmp_path):
    from tessella.operators import factors as X

    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, 0.0)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(c, g, v) for c in (0, 1) for g, v in (("L", 2.0), ("R", 1.0), ("T", 3.0))], "cell_id long, gene string, value double")
    betas = spark.createDataFrame([("T", c, "L$R", 0.7) for c in (0, 1)], "target string, cell_id long, modulator string, beta double")
    levels = spark.createDataFrame([(c, "L", 0.0) for c in (0, 1)], "cell_id long, gene string, level double")
    values = lambda df: {(r.cell_id, r.gene): round(r.value, 9) for r in df.collect() if r.value}
    plain = values(X.perturb(expr, cells, betas, levels, 30.0, hops=2, deltas=str(tmp_path / "d")))
    hops = spark.read.parquet(str(tmp_path / "d"))
    assert {r.hop for r in hops.collect()} == {1, 2} and plain[0, "T"] < 3
    every = expr.select("cell_id", "gene")
    assert values(X.masked_perturb(expr, cells, betas, levels, every, 30.0, hops=2)) == plain
    assert values(X.masked_perturb(expr, cells, betas, levels, every.limit(0), 30.0, hops=2))[0, "T"] == 3
    some = X.splash(betas.union(betas.selectExpr("target", "cell_id", "'R' as modulator", "beta")), expr, expr, allowed=spark.createDataFrame([("T", "Q")], "target string, source string"))
    assert X.splash(betas, expr, expr).count() == some.count()


def test_halves_round_as_the_sql_engine_rounds_them(spark):
    """The product with a million is a half, though the shortest decimal of the number is below one."""
    import duckdb
    from pyspark.sql import functions as F
    from tessella.sources import views as V

    x = [-0.29788749999999997, -0.2619775, 0.5, -0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.half_away(F.col("x"), 6)).collect()]
    assert got == [duckdb.sql(f"SELECT round(CAST({v!r} AS DOUBLE), 6)").fetchall()[0][0] for v in x]
