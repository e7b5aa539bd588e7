"""Controlled loss: weight taken from arcs and nodes taken out at a target correlation with centrality.

The steps on tables (bins, weight removal, materialising missing nodes, profiles) are joins and aggregates with ``by``; a whole
grid of cells runs as one job in which each task works off cells against the broadcast, size-checked networks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.priors import solve_tilt, tau_b, tilt, weighted_draw
from ..functions.scalars import with_position_bin
from ..model import By, aggregate, roster

MAX_ARCS = 5_000_000


def propensity(centrality: DataFrame, rho: float, pi_node: float, k: int, score: str = "score", by: By = ()) -> DataFrame:
    """The nodes with their bin of k by position and their relative propensity to be missing, of mean about 1."""
    sizes = centrality.groupBy(*by).agg(F.count("*").alias("_n"))
    shares = {}
    for (n,) in sizes.select("_n").distinct().collect():  # the groups' sizes
        missing = min(max(round(pi_node * n), 1), n - 1)
        shares[n] = [float(x) * k for x in tilt(solve_tilt(rho, k, n - missing, missing)[0], k)]
    table = centrality.sparkSession.createDataFrame(list(shares.items()) or [(0, [0.0] * k)], "_n long, _q array<double>")
    sizes = sizes.join(F.broadcast(table), "_n")
    binned = with_position_bin(centrality, score, k, "bin", by)
    binned = binned.join(sizes, list(by)) if by else binned.crossJoin(F.broadcast(sizes))  # one row
    return binned.withColumn("propensity", F.element_at("_q", F.col("bin"))).drop("_n", "_q")


def apply_weight_removal(edges: DataFrame, removed: DataFrame, by: By = ()) -> DataFrame:
    """Weights less the ``removed`` units (src, dst, units), never below 0; arcs of weight 0 stay. Parallel arcs are summed first."""
    r = removed.groupBy(*by, "src", "dst").agg(F.sum("units").alias("_u"))
    return aggregate(edges, "sum", by).join(r, [*by, "src", "dst"], "left").select(*by, "src", "dst", F.greatest(F.col("weight") - F.coalesce("_u", F.lit(0)), F.lit(0.0)).alias("weight"))


def materialize_missing(edges: DataFrame, nodes: DataFrame, missing: DataFrame, directed: bool = True, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) after ``missing`` (id) nodes fall silent: their outgoing arcs go; in a directed graph those that others still name stay as nominated nodes."""
    m = missing.select(*by, "id")
    left = edges.join(m.withColumnRenamed("id", "src"), [*by, "src"], "left_anti")
    if not directed:
        left = left.join(m.withColumnRenamed("id", "dst"), [*by, "dst"], "left_anti")
        return left.select(edges.columns), nodes.join(m, [*by, "id"], "left_anti")
    named = left.select(*by, F.col("dst").alias("id")).distinct()
    gone = m.join(named, [*by, "id"], "left_anti")
    return left.select(edges.columns), nodes.join(gone, [*by, "id"], "left_anti")


def topup(candidates: DataFrame, k: int, seed: int, weight: str = "propensity", by: By = ()) -> DataFrame:
    """k nodes for each group, without replacement, in proportion to a column: the smallest exponential keys."""
    from pyspark.sql import Window

    from ..functions.rand import exponential_key

    keyed = candidates.withColumn("_key", exponential_key(F.col(weight), seed, *by, "id")).filter("_key is not null")
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "id"))).filter(F.col("_n") <= k).drop("_key", "_n")


def ei_scores(edges: DataFrame, labels: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, id, ei]``: (external - internal) / all ties of each node; null without ties."""
    c = labels.select(*by, "id", F.col("community").alias("_c"))
    e = edges.select(*by, "src", "dst").join(c.withColumnRenamed("id", "src").withColumnRenamed("_c", "cs"), [*by, "src"]).join(c.withColumnRenamed("id", "dst").withColumnRenamed("_c", "cd"), [*by, "dst"])
    x = F.when(F.col("cs") == F.col("cd"), -1).otherwise(1)
    ends = e.select(*by, F.col("src").alias("id"), x.alias("x")).union(e.select(*by, F.col("dst").alias("id"), x.alias("x")))
    s = ends.groupBy(*by, "id").agg(F.avg("x").alias("ei"))
    return (labels if nodes is None else nodes).select(*by, "id").join(s, [*by, "id"], "left")


def ei_profile(nodes: DataFrame, n_rank: int = 4, n_ei: int = 3, by: By = ()) -> DataFrame:
    """``[*by, rank_bin, ei_bin, share, n]`` of nodes (id, degree, ei): how each degree bin spreads over equal E/I bins."""
    from pyspark.sql import Window

    b = with_position_bin(nodes.filter("ei is not null"), "degree", n_rank, "rank_bin", by).withColumn("ei_bin", F.least(F.floor((F.col("ei") + 1) / 2 * n_ei) + 1, F.lit(n_ei)).cast("int"))
    c = b.groupBy(*by, "rank_bin", "ei_bin").agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy(*by, "rank_bin"))
    return c.select(*by, "rank_bin", "ei_bin", (F.col("c") / n).alias("share"), n.alias("n"))


def profile_distortion(before: DataFrame, after: DataFrame, min_count: int = 5, by: By = ()) -> DataFrame:
    """``[*by, tvd]``: the largest total variation distance between two profiles over rank bins that both fill."""
    keys = [*by, "rank_bin", "ei_bin"]
    j = before.select(*keys, F.col("share").alias("a")).join(after.select(*keys, F.col("share").alias("b")), keys, "full")
    full = lambda p: p.filter(F.col("n") >= min_count).select(*by, "rank_bin").distinct()
    j = j.join(full(before), [*by, "rank_bin"], "left_semi").join(full(after), [*by, "rank_bin"], "left_semi")
    d = j.groupBy(*by, "rank_bin").agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2).alias("d"))
    return d.groupBy(*by).agg(F.max("d").alias("tvd"))


class Arrays:
    """A network as arrays in roster order, for kernels."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, directed: bool, weighted: bool):
        self.ids, self.src, self.dst, self.weight, self.directed, self.weighted = ids, src, dst, weight, directed, weighted
        n = len(ids)
        real = src != dst
        self.degree = (np.bincount(dst[real], minlength=n) + (0 if directed else np.bincount(src[real], minlength=n))).astype(float)
        self.community = self.parts(np.ones(n, bool), np.ones(len(src), bool))

    def parts(self, keep: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Weak component labels over the kept nodes and arcs, by repeated least labels with shortcuts."""
        label = np.arange(len(self.ids))
        use = arcs & keep[self.src] & keep[self.dst]
        s, d = self.src[use], self.dst[use]
        while True:
            new = label.copy()
            np.minimum.at(new, s, label[d])
            np.minimum.at(new, d, label[s])
            new = new[new]
            if (new == label).all():
                return label
            label = new


def collect_networks(edges: DataFrame, nodes: DataFrame | None, meta: dict[str, tuple[bool, bool]]) -> dict[str, Arrays]:
    """The networks (column ``network``) as arrays; meta: (directed, weighted) by name. Refuses more than ``MAX_ARCS`` arcs in all."""
    e = aggregate(edges, "sum", ["network"])
    if e.count() > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} arcs: degrade the networks in several jobs")
    arcs, ids = e.toPandas().sort_values(["network", "src", "dst"]), roster(edges, nodes, ["network"]).toPandas()
    out = {}
    for name, own in ids.groupby("network"):
        names = np.sort(own["id"].to_numpy().astype(str))
        a = arcs[arcs["network"] == name]
        out[name] = Arrays(names, np.searchsorted(names, a["src"].to_numpy().astype(str)), np.searchsorted(names, a["dst"].to_numpy().astype(str)), a["weight"].to_numpy(), *meta.get(name, (True, True)))
    return out


def field(score: np.ndarray, rho: float, pi_node: float, k: int) -> tuple[np.ndarray, float, str]:
    """Propensities by node, beta and its status."""
    n = len(score)
    missing = min(max(round(pi_node * n), 1), n - 1)
    beta, status = solve_tilt(rho, k, n - missing, missing)
    bins = np.empty(n, int)
    bins[np.argsort(score, kind="stable")] = -(-np.arange(1, n + 1) * k // n) - 1
    return k * tilt(beta, k)[bins], beta, status


def remove_weight(net: Arrays, d: np.ndarray, pi_edge: float, rng: np.random.Generator) -> np.ndarray:
    """Units taken from each arc: round(pi_edge * total) in all, drawn in proportion to what is left times the arc's tilt."""
    hazard = d / (2 * max(d.max(), 1e-300))
    arc = 1 - (1 - hazard[net.src]) * (1 - hazard[net.dst])
    units = np.rint(net.weight).astype(np.int64)
    budget = min(round(pi_edge * float(net.weight.sum())), int(units.sum()))
    taken = np.zeros(len(units), np.int64)
    while (rest := budget - int(taken.sum())) > 0:
        p = (units - taken) * arc
        if p.sum() <= 0:
            break
        step = np.minimum(rng.multinomial(rest, p / p.sum()), units - taken)
        if not step.any():
            step[np.argmax(units - taken)] = 1
        taken += step
    return taken


def profile(net: Arrays, keep: np.ndarray, n_rank: int, n_ei: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares [rank bin, E/I bin] among the kept nodes, and the nodes of each rank bin."""
    use = keep[net.src] & keep[net.dst] & (net.src != net.dst)
    ext = np.where(net.community[net.src] != net.community[net.dst], 1.0, -1.0)[use]
    n = len(net.ids)
    ties = np.bincount(net.src[use], minlength=n) + np.bincount(net.dst[use], minlength=n)
    score = np.bincount(net.src[use], ext, n) + np.bincount(net.dst[use], ext, n)
    own = np.flatnonzero(keep & (ties > 0))
    table = np.zeros((n_rank, n_ei))
    if len(own):
        order = own[np.argsort(net.degree[own], kind="stable")]
        rank = -(-np.arange(1, len(order) + 1) * n_rank // len(order)) - 1
        ei = np.minimum(((score[order] / ties[order] + 1) / 2 * n_ei).astype(int), n_ei - 1)
        np.add.at(table, (rank, ei), 1)
    count = table.sum(axis=1)
    return table / np.maximum(count, 1)[:, None], count


def mask(net: Arrays, rho: float, pi_node: float, pi_edge: float, seed: int, node_loss: str = "emergent", k: int = 4, gc_threshold: float = 0.30, min_n: int = 25, min_edges: int = 1, rho_tol: float = 0.02, tvd_tol: float = 0.25, n_rank: int = 4, n_ei: int = 3, min_count: int = 5, max_retries: int = 10) -> dict:
    """One degraded state: the propensity field, weight removal, for ``targeted`` loss a top-up to the node share, and its measures.

    Emergent loss accepts the first try; targeted loss tries again until all three priors hold or tries run out.
    """
    n = len(net.ids)
    d, beta, status = field(net.degree, rho, pi_node, k)
    before = profile(net, np.ones(n, bool), n_rank, n_ei)
    for attempt in range(max_retries):
        rng = np.random.default_rng([seed, attempt])
        taken = remove_weight(net, d, pi_edge, rng) if net.weighted else np.zeros(len(net.src), np.int64)
        left = net.weight - taken
        incident = np.bincount(net.src, net.weight, n) + np.bincount(net.dst, net.weight, n)
        remaining = np.bincount(net.src, left, n) + np.bincount(net.dst, left, n)
        missing = (incident > 0) & (remaining <= 1e-9)
        organic = int(missing.sum())
        if node_loss == "targeted":
            short = round(pi_node * n) - organic
            missing[weighted_draw(np.where(missing, 0.0, d), max(short, 0), rng)] = True
        arcs = ~missing[net.src] if net.directed else ~missing[net.src] & ~missing[net.dst]
        named = np.zeros(n, bool)
        named[net.dst[arcs]] = True
        nominated = missing & named if net.directed else np.zeros(n, bool)
        keep = ~missing
        got_rho = tau_b(net.degree, missing) if missing.any() else 0.0
        after = profile(net, keep, n_rank, n_ei)
        full = (before[1] >= min_count) & (after[1] >= min_count)
        tvd = float((np.abs(before[0] - after[0]).sum(axis=1) / 2)[full].max()) if full.any() else 0.0
        ok = node_loss == "emergent" or (abs(missing.mean() - pi_node) <= 1 / n and abs(got_rho - rho) <= rho_tol and tvd <= tvd_tol)
        if ok:
            break
    inner = keep[net.src] & keep[net.dst] & (left > 0)
    sizes = np.bincount(net.parts(keep, left > 0)[keep], minlength=1)
    n_obs, gc = int(keep.sum()), float(sizes.max() / max(keep.sum(), 1))
    flags = {"gc_collapse": gc < gc_threshold, "too_small": n_obs < min_n, "no_edges": int(inner.sum()) < min_edges}
    total = float(net.weight.sum())
    return {
        "seed": seed, "missing_nodes": np.flatnonzero(missing).tolist(), "n_full_removal": int((missing & ~nominated).sum()), "n_nominations": int(nominated.sum()), "realized_pi_node": float(missing.mean()), "realized_rho": got_rho, "realized_ei_score": tvd,
        "realized_pi_edge": float(taken.sum() / total) if total else 0.0, "W_true": int(round(total)), "W_removed": int(taken.sum()), "n_edges_zeroed": int(((left <= 1e-9) & (net.weight > 0)).sum()), "n_organic_losses": organic, "beta": beta, "field_status": status,
        "gate_status": "passed" if ok else "failed", "contract_passed": bool(ok), "retry_count": attempt, "gc_fraction_of_remaining": gc, "n_observed": n_obs, "n_edges_observed": int(inner.sum()), **flags, "any_topo_degenerate": any(flags.values()), "_removed": taken,
    }


def feasible_rho(net: Arrays, pi_node: float, k: int = 4, draws: int = 20, seed: int = 1) -> tuple[float, float]:
    """The least and largest mean correlation that weighted draws reach at the ends of the tilt."""
    ends = []
    for sign in (-1, 1):
        d, _, _ = field(net.degree, sign * 0.9999, pi_node, k)
        got = []
        for r in range(draws):
            m = np.zeros(len(net.ids), bool)
            m[weighted_draw(d, round(pi_node * len(net.ids)), np.random.default_rng([seed, r, sign + 1]))] = True
            got.append(tau_b(net.degree, m))
        ends.append(float(np.mean(got)))
    return ends[0], ends[1]


CORPUS = (
    "network_name string, nominal_rho double, nominal_pi_node double, nominal_pi_edge double, replicate_idx int, seed long, substituted_rho double, rho_was_substituted boolean, missing_nodes array<long>, n_full_removal long, n_nominations long, realized_pi_node double, realized_rho double, "
    "realized_ei_score double, realized_pi_edge double, W_true long, W_removed long, n_edges_zeroed long, n_organic_losses long, beta double, field_status string, gate_status string, contract_passed boolean, retry_count int, gc_fraction_of_remaining double, n_observed long, n_edges_observed long, "
    "gc_collapse boolean, too_small boolean, no_edges boolean, any_topo_degenerate boolean"
)
_COLUMNS = [c.split(" ")[0] for c in CORPUS.split(", ")]


def cell_seed(master: int, *key) -> int:
    return int.from_bytes(hashlib.sha256(repr((master, *key)).encode()).digest()[:7], "little")


def grid(spark, networks: list[str], rhos, pi_nodes, pi_edges, replicates: int | dict[str, int]) -> DataFrame:
    """Every network, correlation, node share, edge share and replicate, in this order."""
    n = spark.createDataFrame([(x, (replicates.get(x, 100) if isinstance(replicates, dict) else replicates)) for x in sorted(networks)], "network_name string, n int")
    lists = n.select("network_name", "n", F.explode(F.array(*[F.lit(float(x)) for x in rhos])).alias("nominal_rho"))
    lists = lists.select("*", F.explode(F.array(*[F.lit(float(x)) for x in pi_nodes])).alias("nominal_pi_node")).select("*", F.explode(F.array(*[F.lit(float(x)) for x in pi_edges])).alias("nominal_pi_edge"))
    return lists.select("network_name", "nominal_rho", "nominal_pi_node", "nominal_pi_edge", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("replicate_idx"))


def degeneration_corpus(edges: DataFrame, nodes: DataFrame | None, meta: dict[str, tuple[bool, bool]], rhos=(-0.75, -0.25, 0.0, 0.25, 0.75), pi_nodes=(0.05, 0.10, 0.15, 0.25, 0.40, 0.50), pi_edges=(0.0, 0.10, 0.25), replicates: int | dict[str, int] = 100, node_loss: str = "emergent", master_seed: int = 42, k: int = 4, **options) -> DataFrame:
    """One row of ``CORPUS`` for each cell of the grid; targets out of reach are moved to the nearest reachable one."""
    nets = collect_networks(edges, nodes, meta)
    spark = edges.sparkSession
    held = spark.sparkContext.broadcast(nets)

    def run(frames):
        reach: dict = {}
        for pdf in frames:
            rows = []
            for c in pdf.to_dict("records"):
                name, rho, pi_node = c["network_name"], c["nominal_rho"], c["nominal_pi_node"]
                net = held.value[name]
                if (name, pi_node) not in reach:
                    reach[name, pi_node] = feasible_rho(net, pi_node, k)
                lo, hi = reach[name, pi_node]
                used = min(max(rho, lo), hi)
                seed = cell_seed(master_seed, name, rho, pi_node, c["nominal_pi_edge"], c["replicate_idx"])
                rows.append({**c, "substituted_rho": used, "rho_was_substituted": used != rho, **mask(net, used, pi_node, c["nominal_pi_edge"], seed, node_loss, k, **options)})
            yield pd.DataFrame(rows, columns=_COLUMNS)

    cells = grid(spark, list(nets), rhos, pi_nodes, pi_edges, replicates)
    return cells.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, CORPUS)


def recover(net: Arrays, row: dict, node_loss: str = "emergent", **options) -> tuple[pd.DataFrame, list[str]]:
    """Edges and missing ids of a corpus row, replayed from its seed; raises where the replay differs from the row."""
    again = mask(net, row["substituted_rho"], row["nominal_pi_node"], row["nominal_pi_edge"], row["seed"], node_loss, **options)
    if again["missing_nodes"] != list(row["missing_nodes"]):
        raise ValueError("the replay gives other missing nodes than the row")
    missing = np.zeros(len(net.ids), bool)
    missing[again["missing_nodes"]] = True
    keep = ~missing[net.src] if net.directed else ~missing[net.src] & ~missing[net.dst]
    left = net.weight - again["_removed"]
    return pd.DataFrame({"src": net.ids[net.src[keep]], "dst": net.ids[net.dst[keep]], "weight": left[keep]}), net.ids[missing].tolist()


