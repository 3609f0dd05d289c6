"""Centralities of link networks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.lineage import cut, if_small
from tessella.operators.tables import network_degree


#: Genes of a block of shortest paths, links of a cluster that a task holds, and genes of all clusters in a vector.
ROOTS, MOST_LINKS, MOST_NODES = 32, 5_000_000, 2_000_000


def node_degrees(links: DataFrame) -> DataFrame:
    """(cluster, degree, nodes): how many genes of a network have each degree."""
    return network_degree(links).groupBy("cluster", F.col("degree_all").alias("degree")).agg(F.count("*").alias("nodes"))


def _links(links: DataFrame) -> DataFrame:
    return links.select("cluster", "source", "target", F.col("coef_mean").cast("double").alias("coef_mean"))


def _times(shared):
    """Per task: the product of its edges with a vector, a row a node that they reach."""

    def run(batches):
        x = shared.value
        for t in batches:
            a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
            to, value = np.r_[a, b], np.r_[w * x[b], w * x[a]]
            order = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0]) if len(to) else np.zeros(0, np.int64)
            sums = np.add.reduceat(value[order], first) if len(to) else value
            yield pa.RecordBatch.from_arrays([pa.array(to[order][first]), pa.array(sums)], ["node", "y"])

    return run


def eigenvector_centrality(links: DataFrame, most: int = 300, settled: float = 1e-11) -> DataFrame:
    """(cluster, gene, eigenvector): leading eigenvector of the undirected network weighted by the size of coefficients, largest entry 1.

    Lanczos' method from equal entries, for all clusters at once: edges stay dealt over tasks, and a step is one product with a
    vector of a number a gene and cluster, which the driver holds and sends round (refused above MOST_NODES).
    """
    e = cut(_links(links).where("coef_mean is not null"))
    names = e.select("cluster", F.explode(F.array("source", "target")).alias("gene")).distinct()
    nodes = names.orderBy("cluster", "gene").limit(MOST_NODES + 1).collect()
    if len(nodes) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} genes of clusters")
    spark = links.sparkSession
    ids = cut(spark.createDataFrame([(r.cluster, r.gene, i) for i, r in enumerate(nodes)], T.StructType([*names.schema, T.StructField("node", T.LongType())])))
    at = lambda c, out: F.broadcast(ids.select(F.col("cluster").alias("_c"), F.col("gene").alias(c), F.col("node").alias(out)))
    e = e.withColumn("_c", F.col("cluster")).join(at("source", "a"), ["_c", "source"]).join(at("target", "b"), ["_c", "target"])
    e = cut(e.where("a <> b").groupBy("a", "b").agg(F.sum(F.abs("coef_mean")).alias("w")))
    n = len(nodes)
    group = np.unique([str(r.cluster) for r in nodes], return_inverse=True)[1] if n else np.zeros(0, int)
    inside = lambda u, v: np.bincount(group, u * v, group.max() + 1)
    q = [np.ones(n)]
    if n:
        q[0] /= np.sqrt(inside(q[0], q[0]))[group]
    diag, side, done = [], [], np.zeros(group.max() + 1 if n else 0, bool)
    out = np.ones(n)
    for _ in range(most if n else 0):
        shared = spark.sparkContext.broadcast(q[-1])
        y = np.zeros(n)
        for r in e.mapInArrow(_times(shared), "node bigint, y double").groupBy("node").agg(F.sum("y").alias("y")).collect():
            y[r.node] = r.y
        shared.unpersist()
        diag.append(inside(y, q[-1]))
        for _ in range(2):  # against all before, as rounding brings them back
            for v in q:
                y -= inside(y, v)[group] * v
        size = np.sqrt(inside(y, y))
        side.append(size)
        for c in np.flatnonzero(~done).tolist():
            t = np.diag([x[c] for x in diag]) + np.diag([x[c] for x in side[:-1]], 1) + np.diag([x[c] for x in side[:-1]], -1)
            value, vector = np.linalg.eigh(t)
            scale = max(abs(value).max(), 1e-300)
            if size[c] * abs(vector[-1, -1]) <= settled * scale or size[c] <= 1e-12 * scale:
                mine = group == c
                out[mine] = sum(s * v[mine] for s, v in zip(vector[:, -1], q))
                done[c] = True
        if done.all():
            break
        q.append(np.where(done[group], 0.0, y / np.where(size > 0, size, 1)[group]))
    else:
        if n:
            raise RuntimeError("eigenvectors did not settle")
    for c in range(len(done)):
        v = out[group == c]
        out[group == c] = v / v[np.abs(v).argmax()]
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(out)], "node long, eigenvector double")
    return ids.join(F.broadcast(values), "node").select("cluster", "gene", "eigenvector")


def _between(roots: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    """Brandes' algorithm from some roots over one cluster's directed links, lengths the sizes of coefficients."""
    out: dict[str, dict[str, float]] = {}
    for s, t, w in zip(pdf["source"], pdf["target"], pdf["coef_mean"].abs()):
        out.setdefault(t, {})
        if s != t:
            d = out.setdefault(s, {})
            d[t] = min(w, d.get(t, float("inf")))
    score = dict.fromkeys(sorted(out), 0.0)
    for root in roots["root"]:
        dist, paths, before, order = {}, {root: 1.0}, {root: []}, []
        seen, heap, k = {root: 0.0}, [(0.0, 0, root)], 0
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in sorted(out[v].items()):
                far = d + w
                if u not in dist and far < seen.get(u, float("inf")) - 1e-12:
                    seen[u], paths[u], before[u] = far, paths[v], [v]
                    k += 1
                    heapq.heappush(heap, (far, k, u))
                elif u not in dist and abs(far - seen.get(u, float("inf"))) <= 1e-12:
                    paths[u] += paths[v]
                    before[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != root:
                score[v] += share[v]
    return pd.DataFrame({"cluster": roots["cluster"].iat[0], "gene": list(score), "betweenness": list(score.values())})


def betweenness(links: DataFrame) -> DataFrame:
    """(cluster, gene, betweenness) of directed shortest paths.

    Paths are sought from some genes a task: a cluster's genes are dealt into blocks, each meets the cluster's links (refused above
    MOST_LINKS, which a task can hold), and what paths from all genes add to a gene is summed.
    """
    e = cut(_links(links).where("coef_mean is not null").groupBy("cluster", "source", "target").agg(F.min(F.abs("coef_mean")).alias("coef_mean")))
    most = e.groupBy("cluster").count().agg(F.max("count")).first()[0] or 0
    if most > MOST_LINKS:
        raise ValueError(f"a cluster of {most} links is more than a task can hold")
    roots = e.select("cluster", F.explode(F.array("source", "target")).alias("root")).distinct()
    size = roots.groupBy("cluster").agg(F.ceil(F.count("*") / ROOTS).cast("int").alias("blocks"))  # clusters are few
    dealt = cut(roots.join(F.broadcast(size), "cluster").withColumn("block", F.pmod(F.xxhash64("root"), "blocks").cast("int")).drop("blocks"))
    met = e.toDF(*e.columns).join(if_small(dealt.select("cluster", "block").distinct()), "cluster")
    kind = T.StructType([e.schema["cluster"], T.StructField("gene", T.StringType()), T.StructField("betweenness", T.DoubleType())])
    parts = dealt.groupBy("cluster", "block").cogroup(met.groupBy("cluster", "block")).applyInPandas(_between, kind)
    return parts.groupBy("cluster", "gene").agg(F.sum("betweenness").alias("betweenness"))


def network_scores(links: DataFrame) -> DataFrame:
    """All scores of each gene of each cluster's network in one table."""
    keys = ["cluster", "gene"]
    return network_degree(links).join(betweenness(links), keys).join(eigenvector_centrality(links), keys, "left").fillna(0.0, ["eigenvector"])
