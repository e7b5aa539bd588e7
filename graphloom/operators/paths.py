"""Shortest paths: harmonic closeness, betweenness and mean inverse distance, for many graphs in one job.

Sources are the unit of work. A graph's arcs travel to the tasks as compressed rows after a check of their number; each task
runs the passes of its block of sources and gives partial sums, which one aggregate puts together. Beyond ``MAX_ARCS`` the
unweighted distances come from ``bfs_levels``, a frontier join that never gathers a graph.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, aggregate, cut, no_loops, roster, symmetrize

MAX_ARCS = 5_000_000
BLOCK = 64
TIE = 1e-12


def _costs(edges: DataFrame, interpretation: str) -> DataFrame:
    w = F.col("weight")
    if interpretation == "ignore":
        return edges.withColumn("cost", F.lit(1.0))
    if interpretation == "tie_strength":
        return edges.filter(w > 0).withColumn("cost", 1 / w)
    if interpretation == "distance":
        return edges.filter(w > 0).withColumn("cost", w)
    raise ValueError(f"unknown interpretation {interpretation!r}")


def _prepare(edges: DataFrame, directed: bool, interpretation: str, agg: str, by: By) -> DataFrame:
    e = no_loops(aggregate(edges, agg, by))
    if not directed:
        e = symmetrize(e, False, by)
    return _costs(e, interpretation)


def passes(n: int, start: np.ndarray, to: np.ndarray, cost: np.ndarray, sources, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of 1/d from each source, sums of 1/d to each node, and summed dependencies (betweenness) of each node."""
    out, into, between = np.zeros(len(sources)), np.zeros(n), np.zeros(n)
    adj = [to[a:b].tolist() for a, b in zip(start[:-1], start[1:])]
    far = [cost[a:b].tolist() for a, b in zip(start[:-1], start[1:])]
    for k, s in enumerate(sources):
        dist: dict[int, float] = {s: 0.0}
        sigma: dict[int, float] = {s: 1.0}
        back: dict[int, list[int]] = {s: []}
        order: list[int] = []
        if unit:
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                d = dist[v] + 1
                for w in adj[v]:
                    if w not in dist:
                        dist[w], sigma[w], back[w] = d, 0.0, []
                        queue.append(w)
                    if dist[w] == d:
                        sigma[w] += sigma[v]
                        back[w].append(v)
        else:
            heap, done = [(0.0, s)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for w, c in zip(adj[v], far[v]):
                    new, old = d + c, dist.get(w)
                    if old is None or new < old - TIE * max(1.0, abs(old)):
                        dist[w], sigma[w], back[w] = new, sigma[v], [v]
                        heapq.heappush(heap, (new, w))
                    elif w not in done and abs(new - old) <= TIE * max(1.0, abs(old)):
                        sigma[w] += sigma[v]
                        back[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in back[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
                out[k] += 1 / dist[w]
                into[w] += 1 / dist[w]
    return out, into, between


def all_pairs(edges: DataFrame, nodes=None, directed: bool = True, interpretation: str = "ignore", agg: str = "sum", by: By = ()) -> DataFrame:
    """``[*by, id, inv_out, inv_in, between]``, raw sums, of every node of the roster."""
    e = _prepare(edges, directed, interpretation, agg, by)
    r = roster(edges, nodes, by)
    graph = F.struct(*by) if by else F.lit("")
    e = e.select(F.to_json(graph).alias("g") if by else F.lit("").alias("g"), "src", "dst", "cost")
    keyed = r.select(*by, "id", F.to_json(graph).alias("g") if by else F.lit("").alias("g"))
    if e.count() > MAX_ARCS:
        raise ValueError(f"more than {MAX_ARCS} arcs: use bfs_levels for distances")
    arcs = e.toPandas()
    ids = keyed.select("g", "id").toPandas()
    held = {}
    for g, own in ids.groupby("g"):
        names = np.sort(own["id"].to_numpy().astype(str))
        a = arcs[arcs["g"] == g]
        s, t = np.searchsorted(names, a["src"].to_numpy().astype(str)), np.searchsorted(names, a["dst"].to_numpy().astype(str))
        o = np.lexsort((t, s))
        held[g] = (names, np.searchsorted(s[o], np.arange(len(names) + 1)), t[o], a["cost"].to_numpy()[o])
    table = edges.sparkSession.sparkContext.broadcast(held)
    unit = interpretation == "ignore"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, own in frame.groupby("g"):
                names, start, to, cost = table.value[g]
                sources = np.searchsorted(names, own["id"].to_numpy().astype(str))
                out, into, between = passes(len(names), start, to, cost, sources.tolist(), unit)
                full = np.zeros(len(names))
                full[sources] = out
                some = np.flatnonzero((full != 0) | (into != 0) | (between != 0))
                yield pd.DataFrame({"g": g, "id": names[some], "o": full[some], "i": into[some], "b": between[some]})

    parts = edges.sparkSession.sparkContext.defaultParallelism
    blocks = min(max(parts, 1), max(1, -(-len(ids) // BLOCK)))
    sums = keyed.select("g", "id").repartition(blocks).mapInPandas(run, "g string, id string, o double, i double, b double").groupBy("g", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("b").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return keyed.withColumn("id", F.col("id").cast("string")).join(sums, ["g", "id"], "left").select(*by, "id", zero(F.col("o")).alias("inv_out"), zero(F.col("i")).alias("inv_in"), zero(F.col("b")).alias("between"))


def _sized(df: DataFrame, by: By) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").cast("double").alias("_n"))
    return df.join(n, list(by)) if by else df.crossJoin(F.broadcast(n))  # one row


def closeness(edges: DataFrame, nodes=None, directed: bool = True, direction: str = "symmetric", interpretation: str = "ignore", normalize: bool = True, by: By = ()) -> DataFrame:
    """Harmonic closeness; ``symmetric``: over the graph in which each pair has the larger weight of its two directions."""
    d = _sized(all_pairs(edges, nodes, directed and direction != "symmetric", interpretation, by=by), by)
    c = F.col("inv_in" if direction == "in" else "inv_out")
    return d.select(*by, "id", (F.when(F.col("_n") > 1, c / (F.col("_n") - 1)).otherwise(0.0) if normalize else c).alias("closeness"))


def betweenness(edges: DataFrame, nodes=None, directed: bool = True, interpretation: str = "ignore", normalize: bool = False, by: By = ()) -> DataFrame:
    d = _sized(all_pairs(edges, nodes, directed, interpretation, by=by), by)
    b = F.col("between") / (1 if directed else 2)
    most = (F.col("_n") - 1) * (F.col("_n") - 2) / (1 if directed else 2)
    return d.select(*by, "id", (F.when(most > 0, b / most).otherwise(0.0) if normalize else b).alias("betweenness"))


def mean_inverse_distance(edges: DataFrame, nodes=None, directed: bool = True, interpretation: str = "ignore", direction: str = "symmetric", scale_by_log_n: bool = True, by: By = (), empty: float | None = 0.0) -> DataFrame:
    """``[*by, mid]``: mean 1/d over ordered pairs, over ln N if scaled, and ``empty`` where no path is; ``direction`` as for closeness."""
    d = _sized(all_pairs(edges, nodes, directed and direction != "symmetric", interpretation, by=by), by)
    c = F.col("inv_in" if direction == "in" else "inv_out")
    a = d.groupBy(*by).agg(F.sum(c).alias("s"), F.first("_n").alias("n"))
    v = F.col("s") / (F.col("n") * (F.col("n") - 1))
    return a.select(*by, F.when(F.col("s") > 0, v / F.log("n") if scale_by_log_n else v).otherwise(F.lit(empty).cast("double")).alias("mid"))


def bfs_levels(edges: DataFrame, sources: DataFrame, directed: bool = True, max_depth: int = 1000, by: By = ()) -> DataFrame:
    """``[*by, source, id, dist, sigma]`` by frontier joins: distances and numbers of shortest paths from the given sources."""
    e = no_loops(aggregate(edges, "sum", by))
    e = (e if directed else symmetrize(e, False, by)).select(*by, "src", "dst")
    seen = cut(sources.select(*by, F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, [*[F.col(b) for b in by], F.col("id") == F.col("src")] if not by else [frontier[b] == e[b] for b in by] + [frontier["id"] == e["src"]]).select(*[frontier[b] for b in by], "source", F.col("dst").alias("id"), "sigma")
        step = step.groupBy(*by, "source", "id").agg(F.sum("sigma").alias("sigma")).join(seen.select(*by, "source", "id"), [*by, "source", "id"], "left_anti")
        frontier = cut(step.select(*by, "source", "id", F.lit(depth).alias("dist"), "sigma"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
