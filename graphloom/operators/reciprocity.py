"""Reciprocity of arcs, dyads and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import By, aggregate, no_loops


def dyads(edges: DataFrame, by: By = ()) -> DataFrame:
    """``[*by, a, b, w_ab, w_ba]`` of each connected pair, a < b: one exchange, no self join."""
    e = no_loops(aggregate(edges, "sum", by)).filter("weight > 0")
    return e.groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(F.col("src") < F.col("dst"), F.col("weight")).otherwise(0.0)).alias("w_ab"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("weight")).otherwise(0.0)).alias("w_ba"))


def reciprocity(edges: DataFrame, by: By = ()) -> DataFrame:
    """All kinds at once: share of arcs, of weight and of dyads that are returned, Squartini's minimum share, and exactly equal dyads."""
    both = (F.col("w_ab") > 0) & (F.col("w_ba") > 0)
    total = F.col("w_ab") + F.col("w_ba")
    a = dyads(edges, by).groupBy(*by).agg(
        F.sum(F.when(both, 2).otherwise(0)).alias("mutual_arcs"), F.sum(F.when(both, 2).otherwise(1)).alias("arcs"), F.sum(F.when(both, total).otherwise(0.0)).alias("mutual_w"), F.sum(total).alias("w"), F.count_if(both).alias("mutual"), F.count("*").alias("connected"),
        F.sum(F.least("w_ab", "w_ba") * 2).alias("least"), F.count_if(both & (F.col("w_ab") == F.col("w_ba"))).alias("equal"),
    )
    share = lambda x, y: F.when(F.coalesce(F.col(y), F.lit(0)) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    return a.select(*by, share("mutual_arcs", "arcs").alias("arc"), share("mutual_w", "w").alias("arc_weighted"), share("mutual", "connected").alias("dyad"), share("least", "w").alias("squartini"), share("equal", "connected").alias("ora_mutual"))


def local_reciprocity(edges: DataFrame, nodes=None, normalize: str = "none", by: By = ()) -> DataFrame:
    """``[*by, id, reciprocity]``: the returned part of each node's outgoing weight; as z-scores or scaled dense ranks if asked for."""
    from ..model import roster

    least = F.least("w_ab", "w_ba")
    d = dyads(edges, by)
    ends = d.select(*by, F.col("a").alias("id"), least.alias("m"), F.col("w_ab").alias("o")).union(d.select(*by, F.col("b").alias("id"), least.alias("m"), F.col("w_ba").alias("o")))
    s = ends.groupBy(*by, "id").agg(F.when(F.sum("o") > 0, F.sum("m") / F.sum("o")).otherwise(0.0).alias("r"))
    out = roster(edges, nodes, by).join(s, [*by, "id"], "left").select(*by, "id", F.coalesce("r", F.lit(0.0)).alias("reciprocity"))
    if normalize == "zscore":
        st = out.groupBy(*by).agg(F.avg("reciprocity").alias("_m"), F.stddev_samp("reciprocity").alias("_s"))
        j = out.join(st, list(by)) if by else out.crossJoin(F.broadcast(st))  # one row
        return j.select(*by, "id", F.when(F.col("_s") > 0, (F.col("reciprocity") - F.col("_m")) / F.col("_s")).otherwise(0.0).alias("reciprocity"))
    if normalize == "rank":
        levels = out.select(*by, "reciprocity").distinct()
        w = Window.partitionBy(*by)
        levels = levels.withColumn("_k", F.dense_rank().over(w.orderBy("reciprocity"))).withColumn("_n", F.count("*").over(w))
        return out.join(levels, [*by, "reciprocity"]).select(*by, "id", F.when(F.col("_n") > 1, (F.col("_k") - 1) / (F.col("_n") - 1)).otherwise(0.0).alias("reciprocity"))
    return out
