"""Modularity, Leiden communities by independent seeded runs, and the CHAMP choice among resolutions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, aggregate, no_loops, roster, undirected

#: Arcs of a graph that one run may hold.
MAX_ARCS = 5_000_000


def modularity(edges: DataFrame, membership: DataFrame, directed: bool = False, gamma: float = 1.0, weighted: bool = True, by: By = ()) -> DataFrame:
    """``[*by, modularity]`` of given labels (id, community): inner weight less gamma times its expectation, over all weight.

    Undirected edges are one row a pair; a loop counts twice in its node's degree.
    """
    e = aggregate(edges, "sum", by) if directed else undirected(edges, "sum", by)
    if not weighted:
        e = e.withColumn("weight", F.lit(1.0))
    m = membership.select(*by, "id", F.col("community").alias("c"))
    e = e.join(m.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), [*by, "src"]).join(m.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), [*by, "dst"])
    ends = e.select(*by, F.col("cs").alias("c"), F.col("weight").alias("o"), F.lit(0.0).alias("i")).union(e.select(*by, "cd", F.lit(0.0), "weight"))
    k = ends.groupBy(*by, "c").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    expected = (F.col("o") * F.col("i")) if directed else (F.col("o") + F.col("i")) ** 2 / 4
    a = k.groupBy(*by).agg(F.sum(expected).alias("x"), F.sum("o").alias("m"))
    inner = e.groupBy(*by).agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inner"))
    j = a.join(inner, list(by)) if by else a.crossJoin(F.broadcast(inner))  # one row each
    return j.select(*by, F.when(F.col("m") > 0, F.col("inner") / F.col("m") - gamma * F.col("x") / F.col("m") ** 2).otherwise(0.0).alias("modularity"))


def partition_line(edges: DataFrame, membership: DataFrame, directed: bool = False, by: By = ()) -> DataFrame:
    """``[*by, a, p]``: quality at resolution gamma is a - gamma * p."""
    q0, q1 = (modularity(edges, membership, directed, g, by=by).withColumnRenamed("modularity", f"q{int(g)}") for g in (0.0, 1.0))
    j = q0.join(q1, list(by)) if by else q0.crossJoin(F.broadcast(q1))
    return j.select(*by, F.col("q0").alias("a"), (F.col("q0") - F.col("q1")).alias("p"))


class Graph:
    """A graph as lists of neighbours with weights out and in; undirected graphs have both directions."""

    def __init__(self, n: int, src, dst, w, directed: bool):
        self.n, self.directed = n, directed
        self.out: list[dict[int, float]] = [{} for _ in range(n)]
        self.into: list[dict[int, float]] = [{} for _ in range(n)] if directed else self.out
        for a, b, x in zip(src, dst, w):
            self.out[a][b] = self.out[a].get(b, 0.0) + x
            if directed:
                self.into[b][a] = self.into[b].get(a, 0.0) + x
            elif a != b:
                self.out[b][a] = self.out[b].get(a, 0.0) + x
        loops = [o.get(i, 0.0) for i, o in enumerate(self.out)]
        self.k_out = np.array([sum(o.values()) for o in self.out]) + (0 if directed else np.array(loops))
        self.k_in = np.array([sum(o.values()) for o in self.into]) if directed else self.k_out
        self.total = float(self.k_out.sum()) if directed else float(self.k_out.sum()) / 2

    def quality(self, c: np.ndarray, gamma: float) -> float:
        if not self.total:
            return 0.0
        inner = sum(w for a, o in enumerate(self.out) for b, w in o.items() if c[a] == c[b] and (self.directed or a <= b))
        k_out, k_in = np.bincount(c, self.k_out), np.bincount(c, self.k_in)
        return inner / self.total - gamma * float(k_out @ k_in) / (self.total**2 if self.directed else 4 * self.total**2)

    def gain_of(self, c: np.ndarray, sums_out, sums_in, i: int, gamma: float) -> dict[int, float]:
        """Quality, times the total weight, that node i adds to each community around it (its own included), i itself taken out."""
        ties: dict[int, float] = {int(c[i]): 0.0}
        for side in (self.out[i], self.into[i]) if self.directed else (self.out[i],):
            for j, w in side.items():
                if j != i:
                    ties[int(c[j])] = ties.get(int(c[j]), 0.0) + w
        own = int(c[i])
        out = {}
        for k, w in ties.items():
            so, si = sums_out[k] - (self.k_out[i] if k == own else 0.0), sums_in[k] - (self.k_in[i] if k == own else 0.0)
            expected = (self.k_out[i] * si + self.k_in[i] * so) / self.total if self.directed else self.k_out[i] * so / (2 * self.total)
            out[k] = w - gamma * expected
        return out


def local_moves(g: Graph, c: np.ndarray, gamma: float, rng: np.random.Generator) -> bool:
    """Moves nodes, in random order, to their best community until none gains; neighbours of a moved node are looked at again."""
    sums_out, sums_in = (np.bincount(c, k, minlength=g.n + 1).astype(float) for k in (g.k_out, g.k_in))
    queue = rng.permutation(g.n).tolist()
    waiting, moved = set(queue), False
    while queue:
        i = queue.pop()
        waiting.discard(i)
        gains = g.gain_of(c, sums_out, sums_in, i, gamma)
        own = int(c[i])
        best = max(gains, key=lambda k: (gains[k], k == own, -k))
        if best != own and gains[best] > gains[own] + 1e-12:
            for sums, k in ((sums_out, g.k_out[i]), (sums_in, g.k_in[i])):
                sums[own] -= k
                sums[best] += k
            c[i], moved = best, True
            for j in (*g.out[i], *(g.into[i] if g.directed else ())):
                if c[j] != best and j not in waiting:
                    waiting.add(j)
                    queue.insert(0, j)
    return moved


def connected_parts(g: Graph, c: np.ndarray) -> np.ndarray:
    """Communities split into their connected parts, numbered from 0."""
    out, k = np.full(g.n, -1), 0
    for s in range(g.n):
        if out[s] < 0:
            out[s], stack = k, [s]
            while stack:
                v = stack.pop()
                for w in (*g.out[v], *(g.into[v] if g.directed else ())):
                    if out[w] < 0 and c[w] == c[s]:
                        out[w] = k
                        stack.append(w)
            k += 1
    return out


def leiden_run(n: int, src, dst, w, directed: bool, gamma: float, seed: int, rounds: int = 10) -> tuple[np.ndarray, float]:
    """One run: local moves, split into connected parts, contract, until nothing moves. Gives labels by node and their quality."""
    rng = np.random.default_rng(seed)
    first = g = Graph(n, src, dst, w, directed)
    place = np.arange(n)
    labels = np.arange(n)
    if not g.total:
        return labels, 0.0
    for _ in range(rounds):
        c = np.arange(g.n)
        moved = local_moves(g, c, gamma, rng)
        c = connected_parts(g, c)
        labels = c[place]
        if not moved or c.max() + 1 == g.n:
            break
        a = [(int(c[i]), int(c[j]), x) for i, o in enumerate(g.out) for j, x in o.items() if directed or i <= j]
        g = Graph(int(c.max()) + 1, *(zip(*a) if a else ((), (), ())), directed)
        place = labels
    return labels, first.quality(labels, gamma)


def runs(edges: DataFrame, nodes=None, gammas: list[float] = (1.0,), n_runs: int = 5, directed: bool = True, weighted: bool = True, rounds: int = 10, seed: int = 1) -> DataFrame:
    """``[gamma, run, quality, labels array<struct<id, community>>]``, one task a run; a graph of at most ``MAX_ARCS`` arcs travels to each."""
    e = no_loops(aggregate(edges)) if directed else no_loops(undirected(edges, "max"))
    if not weighted:
        e = e.withColumn("weight", F.lit(1.0))
    if e.count() > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} arcs in one graph")
    arcs, ids = e.select("src", "dst", "weight").toPandas(), np.array(sorted(str(x["id"]) for x in roster(edges, nodes).collect()))
    arcs = arcs.sort_values(["src", "dst"])
    spark = edges.sparkSession
    held = spark.sparkContext.broadcast((ids, np.searchsorted(ids, arcs["src"].to_numpy().astype(str)), np.searchsorted(ids, arcs["dst"].to_numpy().astype(str)), arcs["weight"].to_numpy()))
    grid = spark.createDataFrame([(float(x), r) for x in gammas for r in range(n_runs)], "gamma double, run int")

    def kernel(frames):
        for pdf in frames:
            for gamma, run in zip(pdf["gamma"], pdf["run"]):
                names, s, d, w = held.value
                labels, q = leiden_run(len(names), s.tolist(), d.tolist(), w.tolist(), directed, gamma, seed * 1_000_003 + run)
                yield pd.DataFrame({"gamma": [gamma], "run": [run], "quality": [q], "labels": [[{"id": str(i), "community": int(c) + 1} for i, c in zip(names, labels)]]})

    return grid.repartition(max(1, min(len(gammas) * n_runs, spark.sparkContext.defaultParallelism))).mapInPandas(kernel, "gamma double, run int, quality double, labels array<struct<id: string, community: int>>")


def leiden(edges: DataFrame, nodes=None, n_runs: int = 5, resolution: float = 1.0, directed: bool = True, weighted: bool = True, seed: int = 1) -> DataFrame:
    """``[id, community, quality]`` of the best of ``n_runs``."""
    best = runs(edges, nodes, [resolution], n_runs, directed, weighted, seed=seed).agg(F.max_by(F.struct("labels", "quality"), F.struct("quality", -F.col("run"))).alias("b"))
    return best.select(F.explode("b.labels").alias("l"), F.col("b.quality").alias("quality")).select("l.id", "l.community", "quality")


def dominant(lines: DataFrame, lo: float, hi: float) -> DataFrame:
    """Of the partitions' lines a - gamma * p (key, a, p), those that are on top somewhere in [lo, hi], with the gammas between which they are.

    The lines are one for each run of a grid, tens or hundreds: the self join is over that bounded table.
    """
    a = lines.select("key", "a", "p")
    b = lines.select(F.col("key").alias("k2"), F.col("a").alias("a2"), F.col("p").alias("p2"))
    cross = (F.col("a") - F.col("a2")) / (F.col("p") - F.col("p2"))
    j = a.crossJoin(F.broadcast(b))
    return j.groupBy("key", "a", "p").agg(
        F.max(F.when(F.col("p") < F.col("p2"), cross)).alias("low"), F.min(F.when(F.col("p") > F.col("p2"), cross)).alias("high"), F.count_if((F.col("p") == F.col("p2")) & ((F.col("a2") > F.col("a")) | ((F.col("a2") == F.col("a")) & (F.col("k2") < F.col("key"))))).alias("beaten"),
    ).withColumn("low", F.greatest(F.coalesce("low", F.lit(lo)), F.lit(lo))).withColumn("high", F.least(F.coalesce("high", F.lit(hi)), F.lit(hi))).filter("beaten = 0 and low < high").drop("beaten")


def champ(edges: DataFrame, nodes=None, resolution_range: tuple[float, float] = (0.1, 1.8), n_resolutions: int = 30, n_runs: int = 5, directed: bool = False, weighted: bool = True, seed: int = 1) -> dict:
    """Leiden over a grid of resolutions; the partitions that are best somewhere; and of neighbouring ones with more than one community the step with the largest change in p, its lower side.
    Without arcs every node is its own community, there are no lines, and gamma is the range's lower end.

    Returns ``membership`` (id, community), ``lines`` and ``dominant`` as DataFrames, and the chosen gamma.
    """
    from ..model import cut

    lo, hi = resolution_range
    gammas = [lo + k * (hi - lo) / (n_resolutions - 1) for k in range(n_resolutions)] if n_resolutions > 1 else [lo]
    found = cut(runs(edges, nodes, gammas, n_runs, directed, weighted, seed=seed).withColumn("key", F.format_string("%08.5f-%03d", "gamma", "run")))
    membership = found.select("key", F.explode("labels").alias("l")).select("key", "l.id", "l.community")
    # every line needs the same arcs: arcs meet all labels of a key, as many rows as arcs times runs
    keys = found.select("key")
    e = (aggregate(edges) if directed else undirected(edges, "max")).crossJoin(F.broadcast(keys))
    lines = cut(partition_line(e if weighted else e.withColumn("weight", F.lit(1.0)), membership, directed, ["key"]).join(membership.groupBy("key").agg(F.countDistinct("community").alias("communities")), "key"))
    top = cut(dominant(lines, lo, hi).join(lines.select("key", "communities"), "key"))
    rows = sorted(top.filter("communities > 1").collect(), key=lambda r: r["low"])  # partitions on the upper hull: fewer than runs
    if not rows:
        rows = sorted(top.collect(), key=lambda r: r["low"])
    if not rows and lines.isEmpty():  # no arcs: every run leaves each node on its own
        alone = membership.join(F.broadcast(keys.agg(F.min("key").alias("key"))), "key").select("id", "community")  # one key
        return {"membership": alone, "lines": lines, "dominant": top, "gamma": lo, "communities": alone.count()}
    best = max(zip(rows, rows[1:]), key=lambda ab: abs(ab[0]["p"] - ab[1]["p"]), default=(rows[0], rows[0]))
    chosen = min(best, key=lambda r: r["p"])
    return {"membership": membership.filter(F.col("key") == chosen["key"]).select("id", "community"), "lines": lines, "dominant": top, "gamma": (chosen["low"] + chosen["high"]) / 2, "communities": chosen["communities"]}
