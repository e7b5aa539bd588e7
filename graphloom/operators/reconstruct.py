"""Plausible completions of an observed network under priors on missing nodes, missing weight and their correlation with centrality.

The setup (bins, tie probabilities, reciprocation, tendencies, weight floor) is a handful of aggregates over the observed
tables; what comes to the driver is a table of bins. Replicates are independent: one row of a range each, drawn in tasks
against the broadcast setup, stored as differences from the observed network.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.priors import solve_tilt, tau_b, tilt, weighted_draw
from ..functions.scalars import with_rank_bin
from ..model import aggregate, roster, undirected
from .degrade import MAX_ARCS, ei_scores

EI_EDGE = 0.33
SMOOTH = (1.0, 2.0)


def centrality(edges: DataFrame, nodes: DataFrame, directed: bool, by=()) -> DataFrame:
    """``[*by, id, score]``: times named, or for undirected graphs number of ties."""
    ends = edges.select(*by, F.col("dst").alias("id"))
    if not directed:
        ends = ends.union(edges.select(*by, F.col("src").alias("id")))
    c = ends.groupBy(*by, "id").agg(F.count("*").cast("double").alias("score"))
    return nodes.select(*by, "id").join(c, [*by, "id"], "left").select(*by, "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def binned(edges: DataFrame, nodes: DataFrame, labels: DataFrame | None, directed: bool, k: int, by=()) -> DataFrame:
    """``[*by, id, score, ei, bin, ei_bin]``: K bins by average rank; three E/I bins cut at a third on each side, nodes without ties in the middle."""
    c = centrality(edges, nodes, directed, by)
    c = c.join(ei_scores(edges, labels, nodes, by), [*by, "id"], "left") if labels is not None else c.withColumn("ei", F.lit(None).cast("double"))
    ei_bin = F.when(F.col("ei") < -EI_EDGE, 1).when(F.col("ei") > EI_EDGE, 3).otherwise(2) if labels is not None else F.lit(1)
    return with_rank_bin(c.withColumn("ei_bin", ei_bin), "score", k, "bin", by).select(*by, "id", "score", "ei", "bin", "ei_bin")


def _cells(k: int, j: int, spark) -> DataFrame:
    one = spark.createDataFrame([(b, e) for b in range(1, k + 1) for e in range(1, j + 1)], "b int, e int")
    return one.select(F.col("b").alias("ds"), F.col("e").alias("es")).crossJoin(F.broadcast(one.select(F.col("b").alias("dt"), F.col("e").alias("et"))))  # (k*j)^2 cells


def tie_probabilities(edges: DataFrame, bins: DataFrame, k: int, j: int, directed: bool, silent: DataFrame | None = None) -> DataFrame:
    """``[ds, es, dt, et, p, w]`` of every pair of cells: smoothed share of ordered pairs that are tied, and mean weight, over respondents."""
    b = bins if silent is None else bins.join(silent.select("id"), "id", "left_anti")
    b = b.select("id", F.col("bin").alias("d"), F.col("ei_bin").alias("e"))
    e = edges.join(b.toDF("src", "ds", "es"), "src").join(b.toDF("dst", "dt", "et"), "dst").select("ds", "es", "dt", "et", "weight")
    if not directed:
        e = e.unionByName(e.select(F.col("dt").alias("ds"), F.col("et").alias("es"), F.col("ds").alias("dt"), F.col("es").alias("et"), "weight"))
    ties = e.groupBy("ds", "es", "dt", "et").agg(F.count("*").alias("n"), F.avg("weight").alias("w"))
    size = b.groupBy("d", "e").agg(F.count("*").alias("m"))
    cells = _cells(k, j, edges.sparkSession).join(F.broadcast(size.toDF("ds", "es", "ms")), ["ds", "es"], "left").join(F.broadcast(size.toDF("dt", "et", "mt")), ["dt", "et"], "left").na.fill(0)
    same = (F.col("ds") == F.col("dt")) & (F.col("es") == F.col("et"))
    pairs = F.col("ms") * F.when(same, F.greatest(F.col("mt") - 1, F.lit(0))).otherwise(F.col("mt"))
    out = cells.withColumn("pairs", pairs).join(ties, ["ds", "es", "dt", "et"], "left").na.fill(0)
    return out.select("ds", "es", "dt", "et", ((F.col("n") + SMOOTH[0]) / (F.col("pairs") + SMOOTH[1])).alias("p"), F.coalesce("w", F.lit(0.0)).alias("w"))


def reciprocation(edges: DataFrame, bins: DataFrame, k: int, j: int, silent: DataFrame | None = None) -> DataFrame:
    """``[ds, es, dt, et, r]``: smoothed share of arcs between two cells that are returned."""
    b = bins if silent is None else bins.join(silent.select("id"), "id", "left_anti")
    b = b.select("id", F.col("bin").alias("d"), F.col("ei_bin").alias("e"))
    arcs = edges.select("src", "dst").distinct()
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    e = arcs.join(back, ["src", "dst"], "left").join(b.toDF("src", "ds", "es"), "src").join(b.toDF("dst", "dt", "et"), "dst")
    n = e.groupBy("ds", "es", "dt", "et").agg(F.count("*").alias("n"), F.count("m").alias("m"))
    out = _cells(k, j, edges.sparkSession).join(n, ["ds", "es", "dt", "et"], "left").na.fill(0)
    return out.select("ds", "es", "dt", "et", ((F.col("m") + SMOOTH[0]) / (F.col("n") + SMOOTH[1])).alias("r"))


def ei_conditional(bins: DataFrame, k: int, j: int) -> DataFrame:
    """``[bin, ei_bin, share]``: E/I bins within each degree bin; uniform where a bin is empty."""
    from pyspark.sql import Window

    cells = bins.sparkSession.createDataFrame([(b, e) for b in range(1, k + 1) for e in range(1, j + 1)], "bin int, ei_bin int")
    c = cells.join(bins.groupBy("bin", "ei_bin").agg(F.count("*").alias("n")), ["bin", "ei_bin"], "left").na.fill(0)
    total = F.sum("n").over(Window.partitionBy("bin"))
    return c.select("bin", "ei_bin", F.when(total > 0, F.col("n") / total).otherwise(1.0 / j).alias("share"))


def bin_tendencies(edges: DataFrame, bins: DataFrame, k: int, silent: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    """``[bin, degree, strength, out_share]``: mean in-plus-out degree and strength of respondents, and outgoing share; all nodes' means where a bin is empty, and ``empty`` for a share of no ties at all."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.col("weight").alias("s")).union(edges.select(F.col("dst").alias("id"), F.lit(0), "weight"))
    own = ends.groupBy("id").agg(F.count("*").alias("t"), F.sum("o").alias("o"), F.sum("s").alias("s"))
    b = bins if silent is None else bins.join(silent.select("id"), "id", "left_anti")
    b = b.join(own, "id", "left").na.fill(0, ["t", "o", "s"])
    means = (F.avg("t").alias("degree"), F.avg("s").alias("strength"), F.when(F.sum("t") > 0, F.sum("o") / F.sum("t")).alias("out_share"))
    whole = b.agg(*means).select(F.col("degree").alias("gd"), F.col("strength").alias("gs"), F.col("out_share").alias("go"))
    rows = edges.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("bin")).join(b.groupBy("bin").agg(*means), "bin", "left").crossJoin(F.broadcast(whole))  # one row
    return rows.select("bin", F.coalesce("degree", "gd", F.lit(0.0)).alias("degree"), F.coalesce("strength", "gs", F.lit(0.0)).alias("strength"), F.coalesce("out_share", "go", F.lit(empty)).alias("out_share"))


def n_added(pi_node: float, n: int, nominated: int = 0) -> int:
    """Nodes to add so that missing ones are a share ``pi_node`` of all; nominated ones count as known."""
    return max(round(pi_node * n / (1 - pi_node)) - nominated, 0)


def weight_floor(observed: float, q: np.ndarray, degree: np.ndarray, add: int, pi_edge: float, nominated_out: float = 0.0) -> dict:
    """The weight that new ties imply, what the prior asks beyond it, and the prior that can be met."""
    implied = add * float(q @ degree) + nominated_out
    floor = implied / (observed + implied) if observed + implied > 0 else 0.0
    used = max(pi_edge, floor)
    extra = max(observed * used / (1 - used) - implied, 0.0) if used < 1 else math.inf
    return {"implied": implied, "extra": extra, "floor": floor, "realized_pi_edge": used, "W_true": observed + implied + extra, "below_floor": pi_edge < floor}


@dataclass(frozen=True)
class Setup:
    """All that a replicate needs: the observed network as arrays, bins, and the tables over bins."""

    ids: np.ndarray
    bins: np.ndarray
    ei_bins: np.ndarray
    silent: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray
    directed: bool
    weighted: bool
    k: int
    j: int
    p: np.ndarray
    r: np.ndarray
    share: np.ndarray
    degree: np.ndarray
    out_share: np.ndarray
    q: np.ndarray
    beta: float
    status: str
    add: int
    floor: dict = field(default_factory=dict)
    allocation: str = "observed"
    mode: str = "two_way"


def _grid(df: DataFrame, value: str, k: int, j: int) -> np.ndarray:
    a = np.zeros((k, j, k, j))
    rows = df.toPandas()
    a[rows["ds"] - 1, rows["es"] - 1, rows["dt"] - 1, rows["et"] - 1] = rows[value]
    return a.reshape(k * j, k * j)


def compute_setup(edges: DataFrame, nodes: DataFrame, labels: DataFrame | None = None, directed: bool = True, weighted: bool = True, pi_node: float = 0.0, pi_edge: float = 0.0, rho: float = 0.0, silent: list[str] = (), k: int | str = "auto", allocation: str = "observed", min_per_ei: int = 3) -> Setup:
    """The setup of one network, which must fit ``MAX_ARCS`` arcs."""
    e = aggregate(edges, "sum") if directed else undirected(edges, "sum")
    if not weighted:
        e = e.withColumn("weight", F.lit(1.0))
    e = e.cache()
    if e.count() > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} arcs in one network")
    r = roster(e, nodes).cache()
    n = r.count()
    add = n_added(pi_node, n - len(silent) if directed else n, len(silent))
    if k == "auto":
        k = find_k(n, rho, add)
    spark = edges.sparkSession
    mute = spark.createDataFrame([(x,) for x in silent], "id string") if silent else None
    b = binned(e, r, labels, directed, k).cache()
    mode = "degree_only"
    if labels is not None and labels.select("community").distinct().limit(2).count() > 1 and n >= 3 * k * min_per_ei and b.select("ei_bin").distinct().count() > 1:
        mode = "two_way"
    j = 3 if mode == "two_way" else 1
    if mode == "degree_only":
        b = b.withColumn("ei_bin", F.lit(1))
    p = _grid(tie_probabilities(e, b, k, j, directed, mute), "p", k, j)
    rec = _grid(reciprocation(e, b, k, j, mute), "r", k, j) if directed else np.zeros_like(p)
    share = ei_conditional(b, k, j).orderBy("bin", "ei_bin").toPandas()["share"].to_numpy().reshape(k, j)
    t = bin_tendencies(e, b, k, mute).orderBy("bin").toPandas()
    beta, status = solve_tilt(rho, k, n, add)
    q = tilt(beta, k)
    own, arcs = b.orderBy("id").toPandas(), e.orderBy("src", "dst").toPandas()
    ids = own["id"].to_numpy().astype(str)
    mutes = np.isin(ids, list(silent))
    bins = own["bin"].to_numpy() - 1
    named = float((t["degree"] * t["out_share"]).to_numpy()[bins[mutes]].sum()) if directed else 0.0
    w = arcs["weight"].to_numpy(float)
    floor = weight_floor(float(w.sum()), q, t["degree"].to_numpy(), add, pi_edge, named)
    return Setup(ids, bins, own["ei_bin"].to_numpy() - 1, mutes, np.searchsorted(ids, arcs["src"].to_numpy().astype(str)), np.searchsorted(ids, arcs["dst"].to_numpy().astype(str)), w, directed, weighted, k, j, p, rec, share, t["degree"].to_numpy(), t["out_share"].to_numpy(), q, beta, status, add, floor, allocation, mode)


def find_k(n: int, rho: float, add: int, least: int = 4, most: int = 20, per_bin: int = 5) -> int:
    """The largest number of bins that leaves each enough nodes and reaches the correlation."""
    for k in range(min(most, n // 5), least, -1):
        if n / k >= per_bin and (add == 0 or solve_tilt(rho, k, n, add)[1] == "converged"):
            return k
    return max(2, min(least, n))


def new_ids(ids: np.ndarray, add: int) -> list[str]:
    """Numbers after the largest where all ids are numbers, else ``syn_1``..."""
    try:
        top = max(map(int, ids), default=0)
        return [str(top + 1 + i) for i in range(add)]
    except ValueError:
        return [f"syn_{i + 1}" for i in range(add)]


def replicate(s: Setup, seed: int) -> dict:
    """One completed network as arrays: new nodes with bins, ties of silent and of new nodes, and weight added to ties."""
    rng = np.random.default_rng(seed)
    n = len(s.ids)
    new_bin = rng.choice(s.k, size=s.add, p=s.q)
    new_ei = (rng.random(s.add)[:, None] > np.cumsum(s.share[new_bin], axis=1)).sum(axis=1).clip(0, s.j - 1)
    cell = np.concatenate([s.bins * s.j + s.ei_bins, new_bin * s.j + new_ei]).astype(int)
    src, dst = [s.src], [s.dst]
    if s.directed and s.silent.any():
        mute, heard = np.flatnonzero(s.silent), np.flatnonzero(~s.silent)
        names = np.zeros((n, n), bool) if n <= 5000 else None
        pairs = set(zip(s.src.tolist(), s.dst.tolist()))
        if names is not None:
            names[s.src, s.dst] = True
        for m in mute.tolist():
            named_by = names[heard, m] if names is not None else np.array([(h, m) in pairs for h in heard.tolist()])
            chance = np.where(named_by, s.r[cell[heard], cell[m]], s.p[cell[m], cell[heard]])
            to = heard[rng.random(len(heard)) < chance]
            others = mute[mute != m]
            to = np.concatenate([to, others[rng.random(len(others)) < s.p[cell[m], cell[others]]]])
            src.append(np.full(len(to), m))
            dst.append(to)
    for v in range(n, n + s.add):
        others = np.arange(n + s.add)
        others = others[others != v]
        mean, out = s.degree[new_bin[v - n]], s.out_share[new_bin[v - n]]
        if s.directed:
            to = others[weighted_draw(s.p[cell[v], cell[others]], rng.poisson(mean * out), rng)]
            by = weighted_draw(s.p[cell[:n], cell[v]], rng.poisson(mean * (1 - out)), rng)
            src += [np.full(len(to), v), by]
            dst += [to, np.full(len(by), v)]
        else:
            to = others[weighted_draw(s.p[cell[v], cell[others]], rng.poisson(mean), rng)]
            src.append(np.minimum(v, to))
            dst.append(np.maximum(v, to))
    a, b = np.concatenate(src), np.concatenate(dst)
    w = np.concatenate([s.weight, np.ones(len(a) - len(s.weight))])
    if not s.directed:  # two new nodes may have drawn each other
        keys, first = np.unique(a * (n + s.add) + b, return_index=True)
        keep = np.sort(np.concatenate([np.arange(len(s.src)), first[first >= len(s.src)]]))
        a, b, w = a[keep], b[keep], w[keep]
    added = np.zeros(len(a), np.int64)
    budget = round(s.floor["extra"]) if math.isfinite(s.floor["extra"]) else 0
    if s.weighted and budget > 0 and len(a):
        d = s.k * s.q[cell // s.j]
        h = d / (2 * d.max())
        arc = 1 - (1 - h[a]) * (1 - h[b])
        chance = w * arc
        if s.allocation == "deficit":
            lo, hi = 0.0, 1.0
            gain = lambda x: float((w * np.expm1(x * arc)).sum())
            while gain(hi) < budget and hi < 64:
                hi *= 2
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if gain(mid) < budget else (lo, mid)
            chance = w * np.expm1(hi * arc)
        if chance.sum() > 0:
            added = rng.multinomial(budget, chance / chance.sum())
    missing = np.concatenate([np.zeros(n, bool), np.ones(s.add, bool)])
    rho = tau_b((cell // s.j).astype(float), missing) if s.add else 0.0
    total = float(w.sum() + added.sum())
    observed = float(s.weight.sum())
    return {"ids": np.concatenate([s.ids, np.array(new_ids(s.ids, s.add), dtype=object)]), "src": a, "dst": b, "weight": w, "added": added, "n_observed_ties": len(s.src), "rho": rho, "pi_node": s.add / (n + s.add) if n + s.add else 0.0, "pi_edge": (total - observed) / total if total else 0.0}


CORPUS = "sample_id long, seed long, added_node_ids array<string>, struct_src array<string>, struct_dst array<string>, wd_src array<string>, wd_dst array<string>, wd_add array<double>, realized_rho double, realized_pi_node double, realized_pi_edge double, gate_passed boolean, n_attempts int, stage_2_weight_added long, n_added int"


def reconstruction_corpus(spark, setup: Setup, n_replicates: int = 1000, rho: float = 0.0, seed: int = 1, metrics: dict | None = None, rho_tol: float = 0.05, pi_edge_tol: float = 0.02, max_attempts: int = 50) -> DataFrame:
    """One row a replicate: what it adds to the observed network, how it meets the priors, and each metric (edges, nodes) -> number."""
    held = spark.sparkContext.broadcast(setup)
    metrics = metrics or {}

    def run(frames):
        s = held.value
        for pdf in frames:
            rows = []
            for i in pdf["id"].tolist():
                best = None
                for attempt in range(max_attempts):
                    own = int(np.random.SeedSequence([seed, i, attempt]).generate_state(1, np.uint64)[0] >> np.uint64(1))
                    rep = replicate(s, own)
                    gap = abs(rep["rho"] - rho) if s.add else 0.0
                    ok = gap <= rho_tol and (not s.weighted or abs(rep["pi_edge"] - s.floor["realized_pi_edge"]) <= pi_edge_tol)
                    if best is None or gap < best[0]:
                        best = (gap, own, rep)
                    if ok:
                        best = (gap, own, rep)
                        break
                _, own, rep = best
                ids, k = rep["ids"], rep["n_observed_ties"]
                more = np.flatnonzero(rep["added"])
                edges = pd.DataFrame({"src": ids[rep["src"]], "dst": ids[rep["dst"]], "weight": rep["weight"] + rep["added"]})
                rows.append(
                    [i, own, list(ids[len(s.ids) :]), list(ids[rep["src"][k:]]), list(ids[rep["dst"][k:]]), list(ids[rep["src"][more]]), list(ids[rep["dst"][more]]), rep["added"][more].astype(float).tolist(), rep["rho"], rep["pi_node"], rep["pi_edge"], ok, attempt + 1, int(rep["added"].sum()), s.add]
                    + [float(f(edges, list(ids))) for f in metrics.values()]
                )
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join([CORPUS, *(f"{m} double" for m in metrics)])
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.range(n_replicates).repartition(max(1, min(n_replicates, spark.sparkContext.defaultParallelism))).mapInPandas(run, schema)


def materialize(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """``[sample_id, src, dst, weight]``: the observed edges with every row's differences; edges times samples, by its nature."""
    keys = corpus.select("sample_id")
    same = edges.select("src", "dst", "weight").crossJoin(F.broadcast(keys)).select("sample_id", "src", "dst", "weight")
    new = corpus.select("sample_id", F.explode(F.arrays_zip("struct_src", "struct_dst")).alias("x")).select("sample_id", "x.struct_src", "x.struct_dst", F.lit(1.0))
    more = corpus.select("sample_id", F.explode(F.arrays_zip("wd_src", "wd_dst", "wd_add")).alias("x")).select("sample_id", "x.wd_src", "x.wd_dst", "x.wd_add")
    return same.union(new).union(more).groupBy("sample_id", "src", "dst").agg(F.sum("weight").alias("weight"))
