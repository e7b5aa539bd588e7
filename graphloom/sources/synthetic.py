"""Synthetic networks: stochastic block model, preferential attachment, and a random weighted graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Network


def blocks(spark: SparkSession, n: int, k: int) -> DataFrame:
    """``[id, block]``: blocks of nearly equal size, the first ones larger by one where k doesn't divide n."""
    size, more = divmod(n, k)
    i = F.col("id")
    edge = more * (size + 1)
    b = F.when(i < edge, F.floor(i / (size + 1))).otherwise(more + F.floor((i - edge) / max(size, 1))) + 1
    return spark.range(n).select((i + 1).cast("string").alias("id"), b.cast("int").alias("block"))


def chosen(rng: np.random.Generator, p: float, lo: int, hi: int) -> np.ndarray:
    """The numbers from lo on below hi of which each is taken with probability p, by the gaps between them: work grows with what is taken."""
    if p <= 0 or hi <= lo:
        return np.zeros(0, np.int64)
    out, at = [], lo - 1
    while at < hi:
        places = at + np.cumsum(rng.geometric(min(p, 1.0), int((hi - at) * p * 1.1) + 16))
        out.append(places[places < hi])
        at = int(places[-1])
    return np.concatenate(out)


def _drawn(spark: SparkSession, n: int, row) -> DataFrame:
    """Arcs of each of n nodes, by ``row(i)``, which gives the ends' numbers and the weights."""

    def run(frames):
        for pdf in frames:
            for i in pdf["id"].tolist():
                to, w = row(i)
                yield pd.DataFrame({"src": str(i + 1), "dst": (to + 1).astype(str), "weight": np.asarray(w, float)})

    return spark.range(n).mapInPandas(run, "src string, dst string, weight double")


def block_model(spark: SparkSession, n: int = 600, k: int = 6, p_in: float = 0.10, p_out: float = 0.008, directed: bool = False, weighted: bool = False, rate: float = 2.0, seed: int = 42) -> Network:
    """Each pair is tied by chance, more often within a block. Only tied pairs are made, each node's by its own seed."""
    size, more = divmod(n, k)

    def row(i: int):
        b = i // (size + 1) if i < more * (size + 1) else more + (i - more * (size + 1)) // size
        lo = b * size + min(b, more)
        hi = lo + size + (b < more)
        rng = np.random.default_rng([seed, i])
        parts = ((0, lo, p_out), (lo, hi, p_in), (hi, n, p_out)) if directed else ((i + 1, hi, p_in), (hi, n, p_out))
        to = np.concatenate([chosen(rng, p, a, z) for a, z, p in parts])
        to = to[to != i]
        return to, 1 + rng.poisson(rate, len(to)) if weighted else np.ones(len(to))

    return Network(_drawn(spark, n, row), blocks(spark, n, k), {"directed": directed, "weighted": weighted})


def attachment_edges(n: int, m: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A clique of m + 1, then each new node tied to m distinct nodes in proportion to their ties."""
    src = [i for i in range(m + 1) for j in range(i)]
    dst = [j for i in range(m + 1) for j in range(i)]
    ends = src + dst
    for v in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[rng.integers(len(ends))])
        for u in sorted(chosen):
            src.append(v)
            dst.append(u)
            ends += [v, u]
    return np.array(src), np.array(dst)


def preferential_attachment(spark: SparkSession, n: int = 250, m: int = 2, directed: bool = False, weighted: bool = False, rate: float = 1.0, seeds: list[int] = (42,)) -> Network:
    """One network a seed (column ``network``), each grown in one task: growth is sequential by nature."""

    def run(frames):
        for pdf in frames:
            for seed in pdf["seed"].tolist():
                rng = np.random.default_rng(seed)
                s, d = attachment_edges(n, m, rng)
                w = 1.0 + rng.poisson(rate, len(s)) if weighted else np.ones(len(s))
                yield pd.DataFrame({"network": f"pa_{seed}", "src": (s + 1).astype(str), "dst": (d + 1).astype(str), "weight": w})

    e = spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(len(seeds)).mapInPandas(run, "network string, src string, dst string, weight double")
    names = spark.createDataFrame([(f"pa_{s}",) for s in seeds], "network string")
    nodes = spark.range(1, n + 1).select(F.col("id").cast("string")).crossJoin(F.broadcast(names)).select("network", "id")
    return Network(e, nodes, {"directed": directed, "weighted": weighted})


def random_weighted(spark: SparkSession, n: int = 50, density: float = 0.08, rate: float = 3.0, seed: int = 42) -> Network:
    """Arcs by chance, with Poisson weights of at least 1."""

    def row(i: int):
        rng = np.random.default_rng([seed, i])
        to = chosen(rng, density, 0, n)
        to = to[to != i]
        return to, np.maximum(1, rng.poisson(rate, len(to)))

    return Network(_drawn(spark, n, row), spark.range(1, n + 1).select(F.col("id").cast("string")), {"directed": True, "weighted": True})


def write_corpus(spark: SparkSession, out: str, seed: int = 42) -> dict[str, str]:
    """Block models and preferential attachment networks, each directed or not and weighted or not, as eight GraphML files by name."""
    from .graphml import write_graphml

    files = {}
    for directed in (False, True):
        for weighted in (False, True):
            kind = f"{'directed' if directed else 'undirected'}_{'weighted' if weighted else 'unweighted'}"
            grown = preferential_attachment(spark, directed=directed, weighted=weighted, seeds=[seed])
            for name, net in ((f"block_model_{kind}", block_model(spark, directed=directed, weighted=weighted, seed=seed)), (f"preferential_attachment_{kind}", Network(grown.edges.drop("network"), grown.nodes.drop("network"), grown.meta))):
                files[name] = f"{out}/{name}.graphml"
                write_graphml(Network(net.edges, net.nodes, net.meta | {"network_name": name}), files[name])
    return files


def degree_distribution(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """``[degree, n]``: how many nodes have so many ties."""
    from ..operators.degree import total_degree

    return total_degree(edges, nodes, weighted=False, directed=directed).groupBy(F.col("total_degree").alias("degree")).agg(F.count("*").alias("n"))


def check_network(net: Network, n_nodes: int | None = None, n_edges: int | None = None, directed: bool | None = None, weighted: bool | None = None) -> DataFrame:
    """``[check, passed]``: counts and flags as expected, ends in the roster, no loops or repeated pairs, weights of the kind that the network says."""
    e, v = net.edges, net.nodes
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    pair = ["src", "dst"] if net.meta.get("directed") else [low.alias("src"), high.alias("dst")]
    one = e.agg(F.count("*").alias("m"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count_distinct("weight").alias("kinds")).first()
    strangers = e.select(F.col("src").alias("id")).union(e.select("dst")).join(v.select("id"), "id", "left_anti")
    checks = {"ends_known": strangers.isEmpty(), "no_loops": one["loops"] == 0, "no_repeats": e.select(*pair).distinct().count() == one["m"], "has_edges": one["m"] > 0}
    if n_nodes is not None:
        checks["n_nodes"] = v.count() == n_nodes
    if n_edges is not None:
        checks["n_edges"] = one["m"] == n_edges
    for flag, want in (("directed", directed), ("weighted", weighted)):
        if want is not None:
            checks[f"{flag}_flag"] = net.meta.get(flag) is want
    if weighted:
        checks |= {"weights_least_1": one["lo"] is not None and one["lo"] >= 1, "weights_vary": one["kinds"] > 1}
    elif weighted is False:
        checks["weights_all_1"] = one["lo"] == one["hi"] == 1
    return e.sparkSession.createDataFrame([(k, bool(x)) for k, x in checks.items()], "check string, passed boolean")
