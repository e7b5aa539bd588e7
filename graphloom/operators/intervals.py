"""Credible intervals of any metric of a network that is only partly observed, and bias against a known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import credible_interval
from ..model import distance_to_counts, roster
from .community import champ, leiden
from .paths import passes
from .reconstruct import Setup, compute_setup, reconstruction_corpus


def total_weight(edges: pd.DataFrame, ids: list) -> float:
    return float(edges["weight"].sum())


def density(edges: pd.DataFrame, ids: list) -> float:
    n = len(ids)
    return len(edges) / (n * (n - 1)) if n > 1 else 0.0


def max_weight(edges: pd.DataFrame, ids: list) -> float:
    return float(edges["weight"].max()) if len(edges) else 0.0


def top_strength(edges: pd.DataFrame, ids: list) -> float:
    return float(edges.groupby("dst")["weight"].sum().max()) if len(edges) else 0.0


def strength_gini(edges: pd.DataFrame, ids: list) -> float:
    x = np.sort(edges.groupby("dst")["weight"].sum().reindex(ids, fill_value=0.0).to_numpy())
    n = len(x)
    return float((2 * np.arange(1, n + 1) - n - 1) @ x / (n * x.sum())) if n > 1 and x.sum() > 0 else 0.0


METRICS = {"total_weight": total_weight, "density": density, "max_weight": max_weight, "top_strength": top_strength, "strength_gini": strength_gini}


def node_strength(edges: pd.DataFrame, ids: list) -> pd.Series:
    """Weight of each node's arcs, out and in."""
    return edges.groupby("src")["weight"].sum().reindex(ids, fill_value=0.0) + edges.groupby("dst")["weight"].sum().reindex(ids, fill_value=0.0)


def node_betweenness(edges: pd.DataFrame, ids: list) -> pd.Series:
    """Betweenness of each node by tie strength, arcs of weight 0 left out."""
    own = edges[(edges["weight"] > 0) & (edges["src"] != edges["dst"])].groupby(["src", "dst"], as_index=False)["weight"].sum()
    names = pd.Index(ids)
    s, t = names.get_indexer(own["src"]), names.get_indexer(own["dst"])
    o = np.lexsort((t, s))
    start = np.searchsorted(s[o], np.arange(len(names) + 1))
    return pd.Series(passes(len(names), start, t[o], 1 / own["weight"].to_numpy()[o], list(range(len(names))), False)[2], index=ids)


NODE_METRICS = {"strength": node_strength, "betweenness": node_betweenness}


def node_metric(metric: str, node: str):
    """A metric of a network: one node's score, for ``network_intervals`` and the bootstrap."""
    return lambda edges, ids: float(NODE_METRICS[metric](edges, ids).get(node, 0.0))


def community_labels(edges: DataFrame, nodes: DataFrame, directed: bool = True, weighted: bool = True, method: str = "champ", seed: int = 1) -> DataFrame:
    """``[id, community]`` of every node of the roster, nodes without ties included, by CHAMP or Leiden."""
    if method not in ("champ", "leiden"):
        raise ValueError(f"unknown method {method!r}")
    found = champ(edges, nodes, directed=directed, weighted=weighted, seed=seed)["membership"] if method == "champ" else leiden(edges, nodes, directed=directed, weighted=weighted, seed=seed)
    return nodes.select("id").join(found.select("id", "community"), "id", "left")


def network_intervals(edges: DataFrame, nodes: DataFrame | None = None, metrics: dict | None = None, directed: bool = True, weighted: bool = True, pi_node: float = 0.1, pi_edge: float = 0.1, rho: float = 0.0, labels: DataFrame | None = None, weight_semantics: str = "count", weight_method: str = "scaled_reciprocal", tau: float | None = None, n_replicates: int = 1000, prob: float = 0.89, seed: int = 1, detect: str | None = None, **options) -> DataFrame:
    """``[metric, lower, median, upper, mean, sd, prob, n_valid]`` over replicates of the completed network.

    Without ``labels``, ``detect`` ("champ" or "leiden") finds communities first. Replicates that fail the gate are left out.
    """
    metrics = metrics or METRICS
    if weight_semantics == "distance":
        edges = distance_to_counts(edges, weight_method, tau)
    if labels is None and detect:
        labels = community_labels(edges, roster(edges, nodes), directed, weighted, detect, seed)
    setup = compute_setup(edges, roster(edges, nodes), labels, directed, weighted, pi_node, pi_edge, rho, **options)
    return summarize(reconstruction_corpus(edges.sparkSession, setup, n_replicates, rho, seed, metrics), list(metrics), prob)


def summarize(corpus: DataFrame, metrics: list[str], prob: float = 0.89) -> DataFrame:
    if "gate_passed" in corpus.columns:
        corpus = corpus.filter("gate_passed")
    long = corpus.unpivot(["sample_id"], metrics, "metric", "value")
    return credible_interval(long, "value", prob, ["metric"])


def bias(intervals: DataFrame, truth: dict[str, float]) -> DataFrame:
    """``[metric, median, truth, bias]``: (median - truth) / |truth|."""
    t = intervals.sparkSession.createDataFrame([(k, float(v)) for k, v in truth.items()], "metric string, truth double")
    return intervals.join(F.broadcast(t), "metric").select("metric", "median", "truth", F.when(F.col("truth") != 0, (F.col("median") - F.col("truth")) / F.abs("truth")).alias("bias"))


def node_bias(scores: DataFrame, truth: DataFrame, spearman: bool = False) -> DataFrame:
    """One row: 1 - correlation between each node's median over replicates (sample_id, id, score) and its true score (id, score)."""
    m = scores.groupBy("id").agg(F.percentile("score", F.lit(0.5)).alias("m")).join(truth.select("id", F.col("score").alias("t")), "id")
    if spearman:
        from ..functions.scalars import with_tied_rank

        m = with_tied_rank(with_tied_rank(m, "m", "_rm"), "t", "_rt").select("id", F.col("_rm").alias("m"), F.col("_rt").alias("t"))
    return m.agg((1 - F.corr("m", "t")).alias("bias"), F.count("*").alias("n"))


def weight_bootstrap(edges: DataFrame, pi_edge: float, metrics: dict | None = None, b: int = 1000, seed: int = 1) -> DataFrame:
    """``[sample_id, <metric>...]``: b times, the weight that a share ``pi_edge`` of missing weight implies is added in proportion to present weights."""
    if not 0 <= pi_edge < 1:
        raise ValueError("pi_edge must lie in [0, 1)")
    metrics = metrics or METRICS
    arcs = edges.select("src", "dst", "weight").toPandas().sort_values(["src", "dst"], ignore_index=True)
    spark = edges.sparkSession
    held = spark.sparkContext.broadcast(arcs)
    ids = sorted({*arcs["src"], *arcs["dst"]})

    def run(frames):
        a = held.value
        w = a["weight"].to_numpy(float)
        units = round(pi_edge * w.sum() / (1 - pi_edge))
        for pdf in frames:
            rows = []
            for i in pdf["id"].tolist():
                extra = np.random.default_rng([seed, i]).multinomial(units, w / w.sum()) if units and w.sum() else 0
                rows.append([i, *(float(f(a.assign(weight=w + extra), ids)) for f in metrics.values())])
            yield pd.DataFrame(rows, columns=["sample_id", *metrics])

    return spark.range(b).mapInPandas(run, ", ".join(["sample_id long", *(f"{m} double" for m in metrics)]))


def random_loss(edges: pd.DataFrame, pi_edge: float, seed: int) -> pd.DataFrame:
    """A share of the weight units taken away at random; rows stay, at weight 0 if need be."""
    w = np.rint(edges["weight"].to_numpy()).astype(np.int64)
    gone = np.random.default_rng(seed).multivariate_hypergeometric(w, round(pi_edge * int(w.sum()))) if w.sum() else 0
    return edges.assign(weight=(w - gone).astype(float))


def validation(edges: DataFrame, metric: str, pi_edges: list[float], b: int = 200, repetitions: int = 10, prob: float = 0.95, seed: int = 99) -> DataFrame:
    """``[pi_edge, lower, median, upper, truth, covers]``: mean bands of the bootstrap after controlled loss, against the full network's value."""
    f = METRICS[metric]
    arcs = edges.select("src", "dst", "weight").toPandas().sort_values(["src", "dst"], ignore_index=True)
    ids = sorted({*arcs["src"], *arcs["dst"]})
    truth = float(f(arcs, ids))
    spark = edges.sparkSession
    cells = spark.createDataFrame([(float(p), r) for p in pi_edges for r in range(repetitions)], "pi_edge double, rep int")
    held = spark.sparkContext.broadcast(arcs)

    def run(frames):
        for pdf in frames:
            rows = []
            for p, r in zip(pdf["pi_edge"], pdf["rep"]):
                seen = random_loss(held.value, p, seed * 7919 + r)
                w = seen["weight"].to_numpy()
                units = round(p * w.sum() / (1 - p))
                rng = np.random.default_rng([seed, r, round(p * 1e6)])
                v = [f(seen.assign(weight=w + (rng.multinomial(units, w / w.sum()) if units and w.sum() else 0)), ids) for _ in range(b)]
                rows.append([p, r, *np.quantile(v, [(1 - prob) / 2, 0.5, (1 + prob) / 2]).tolist()])
            yield pd.DataFrame(rows, columns=["pi_edge", "rep", "lo", "mid", "hi"])

    out = cells.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, "pi_edge double, rep int, lo double, mid double, hi double")
    a = out.groupBy("pi_edge").agg(F.avg("lo").alias("lower"), F.avg("mid").alias("median"), F.avg("hi").alias("upper"))
    return a.select("*", F.lit(truth).alias("truth"), F.lit(truth).between(F.col("lower"), F.col("upper")).alias("covers"))


__all__ = ["METRICS", "Setup", "bias", "network_intervals", "node_bias", "random_loss", "summarize", "validation", "weight_bootstrap"]
