"""Degrees, strengths, and Freeman's normalisation and centralization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, aggregate, roster, undirected, with_weight


def _on_roster(scores: DataFrame, edges: DataFrame, nodes, by: By, name: str) -> DataFrame:
    return roster(edges, nodes, by).join(scores, [*by, "id"], "left").select(*by, "id", F.coalesce(name, F.lit(0.0)).alias(name))


def _value(weighted: bool):
    return F.sum("weight") if weighted else F.count_if(F.col("weight") > 0).cast("double")


def in_degree(edges: DataFrame, nodes=None, weighted: bool = True, agg: str = "sum", by: By = ()) -> DataFrame:
    """``[*by, id, in_degree]``; loops count."""
    e = aggregate(edges, agg, by)
    return _on_roster(e.groupBy(*by, F.col("dst").alias("id")).agg(_value(weighted).alias("in_degree")), edges, nodes, by, "in_degree")


def out_degree(edges: DataFrame, nodes=None, weighted: bool = True, agg: str = "sum", by: By = ()) -> DataFrame:
    e = aggregate(edges, agg, by)
    return _on_roster(e.groupBy(*by, F.col("src").alias("id")).agg(_value(weighted).alias("out_degree")), edges, nodes, by, "out_degree")


def total_degree(edges: DataFrame, nodes=None, weighted: bool = True, directed: bool = True, drop_self_loops: bool = False, agg: str = "sum", by: By = (), compat: bool = False) -> DataFrame:
    """In plus out, a loop once. Undirected: the weight of a node's pairs; ``compat`` halves it, as golden tables of undirected networks do."""
    e = aggregate(edges, agg, by) if directed else undirected(edges, agg, by)
    if drop_self_loops:
        e = e.filter("src <> dst")
    ends = e.select(*by, F.col("src").alias("id"), "weight").union(e.filter("src <> dst").select(*by, F.col("dst").alias("id"), "weight"))
    s = ends.groupBy(*by, "id").agg(_value(weighted).alias("total_degree"))
    if compat and not directed:
        s = s.withColumn("total_degree", F.col("total_degree") / 2)
    return _on_roster(s, edges, nodes, by, "total_degree")


def degrees(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """All six in one pass over the arcs: in, out and total, weighted and binary."""
    e = aggregate(edges, "sum", by)
    ends = e.select(*by, F.col("src").alias("id"), F.col("weight").alias("o"), F.lit(0.0).alias("i"), F.col("weight").alias("t")).union(e.select(*by, F.col("dst").alias("id"), F.lit(0.0), "weight", F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0.0)))
    names = {"i": "in", "o": "out", "t": "total"}
    s = ends.groupBy(*by, "id").agg(*[F.sum(k).alias(f"{n}_strength") for k, n in names.items()], *[F.count_if(F.col(k) > 0).cast("double").alias(f"{n}_degree") for k, n in names.items()])
    cols = [f"{n}_{w}" for w in ("degree", "strength") for n in names.values()]
    return roster(edges, nodes, by).join(s, [*by, "id"], "left").select(*by, "id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


def freeman_normalized(edges: DataFrame, nodes=None, mode: str = "all", directed: bool = True, weighted: bool = True, drop_self_loops: bool = False, types: DataFrame | None = None, agg: str = "sum", by: By = ()) -> DataFrame:
    """``[*by, id, score]``: degree over the most that it can be: V(N-1), or 2V(N-1) for in plus out; V the largest weight, or 1.

    ``types`` (id, type boolean) makes the graph bipartite: the most is V times the other side's number.
    """
    e = aggregate(edges, agg, by)
    if not weighted:
        e = e.withColumn("weight", (F.col("weight") > 0).cast("double"))
    if mode in ("in", "out") or drop_self_loops:
        e = e.filter("src <> dst")
    fn = {"in": in_degree, "out": out_degree}.get(mode)
    d = fn(e, roster(edges, nodes, by), by=by) if fn else total_degree(e, roster(edges, nodes, by), directed=directed, by=by, agg="max" if not directed else "sum")
    name = {"in": "in_degree", "out": "out_degree"}.get(mode, "total_degree")
    top = e.groupBy(*by).agg(F.max("weight").alias("_v"))
    size = d.groupBy(*by).agg(F.count("*").alias("_n"))
    s = d.join(top, list(by), "left").join(size, list(by)) if by else d.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(size))  # one row each
    if types is not None:
        t = types.select(*by, "id", F.col("type").alias("_t"))
        n = t.groupBy(*by).agg(F.count_if(F.col("_t")).alias("_yes"), F.count_if(~F.col("_t")).alias("_no"))
        s = s.join(t, [*by, "id"])
        s = s.join(n, list(by)) if by else s.crossJoin(F.broadcast(n))
        most = F.col("_v") * F.when(F.col("_t"), F.col("_no")).otherwise(F.col("_yes"))
    else:
        most = F.col("_v") * (F.col("_n") - 1) * (2 if directed and mode == "all" else 1)
    return s.select(*by, "id", F.when(most > 0, F.col(name) / most).otherwise(0.0).alias("score"))


def freeman_centralization(edges: DataFrame, nodes=None, mode: str = "all", directed: bool = True, drop_self_loops: bool = True, by: By = ()) -> DataFrame:
    """``[*by, freeman]``: sum of the gaps to the largest binary degree over (N-1)(N-2); 0 for two nodes or fewer."""
    e = with_weight(edges)
    e = e.filter("src <> dst") if drop_self_loops else e
    r = roster(edges, nodes, by)
    fn = {"in": in_degree, "out": out_degree}.get(mode)
    d = fn(e, r, weighted=False, by=by) if fn else total_degree(e, r, weighted=False, directed=directed, by=by)
    c = d.columns[-1]
    a = d.groupBy(*by).agg((F.max(c) * F.count("*") - F.sum(c)).alias("gap"), F.count("*").alias("n"))
    return a.select(*by, F.when(F.col("n") > 2, F.col("gap") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("freeman"))
