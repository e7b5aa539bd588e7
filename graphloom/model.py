"""Graphs as DataFrames: construction, aggregation, symmetry, projection."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


@dataclass
class Network:
    """Edges, nodes and what is known of the whole (``directed``, ``weighted``, names, counts)."""

    edges: DataFrame
    nodes: DataFrame | None = None
    meta: dict = field(default_factory=dict)


def checkpoint_folder(spark) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode, where one machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="graphloom-")


def cut(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder; for loops whose plans would grow with their rounds."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def with_weight(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


def aggregate(edges: DataFrame, agg: str = "sum", by: By = ()) -> DataFrame:
    """Parallel arcs collapsed into one. Without weights: ``sum`` counts them, ``max`` gives 1."""
    f = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg, "first": F.first}[agg]
    return with_weight(edges).groupBy(*by, "src", "dst").agg(f("weight").cast("double").alias("weight"))


def roster(edges: DataFrame, nodes: DataFrame | Sequence[str] | None = None, by: By = ()) -> DataFrame:
    """``[*by, id]``: the given nodes, or every end of an arc."""
    if nodes is None:
        return edges.select(*by, F.col("src").alias("id")).union(edges.select(*by, F.col("dst").alias("id"))).distinct()
    if isinstance(nodes, DataFrame):
        return nodes.select(*by, F.col("id"))
    return edges.sparkSession.createDataFrame([(str(x),) for x in nodes], "id string")


def check_ends(edges: DataFrame, nodes: DataFrame, by: By = ()) -> None:
    """Raises if an arc names a node that the roster lacks."""
    missing = roster(edges, None, by).join(nodes.select(*by, "id"), [*by, "id"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"arcs name unknown nodes: {[r['id'] for r in missing]}")


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def binarize(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def simple(edges: DataFrame, by: By = ()) -> DataFrame:
    """Distinct arcs of positive weight without loops."""
    return with_weight(edges).filter("src <> dst and weight > 0").select(*by, "src", "dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])


def symmetrize(edges: DataFrame, weighted: bool = True, by: By = ()) -> DataFrame:
    """Both directions of every arc: the mean of the two weights, or the larger; a one-way list keeps its weights under ``max``."""
    e = aggregate(edges, "sum", by)
    both = e.unionByName(reverse(e))
    f = (F.sum("weight") / 2) if weighted else F.max("weight")
    return both.groupBy(*by, "src", "dst").agg(f.alias("weight"))


def undirected(edges: DataFrame, agg: str = "max", by: By = ()) -> DataFrame:
    """One row for each pair, smaller id first, loops kept; duplicates by ``agg``."""
    e = with_weight(edges)
    return aggregate(e.select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight"), agg, by)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(reverse(no_loops(pairs)))


def symmetry_gap(edges: DataFrame, by: By = ()) -> DataFrame:
    """``[*by, gap]``: the summed absolute difference between weights and reversed weights."""
    e = aggregate(edges, "sum", by)
    signed = e.unionByName(reverse(e).withColumn("weight", -F.col("weight")).select(e.columns))
    return signed.groupBy(*by, "src", "dst").agg(F.sum("weight").alias("d")).groupBy(*by).agg(F.sum(F.abs("d")).alias("gap"))


def is_symmetric(edges: DataFrame, atol: float = 1e-12) -> bool:
    row = symmetry_gap(edges).first()
    return row is None or (row["gap"] or 0.0) <= atol


def is_binary(edges: DataFrame, directed: bool = True, atol: float = 1e-12) -> bool:
    e = aggregate(edges)
    loop = 1.0 if directed else 2.0
    bad = F.when(F.col("src") == F.col("dst"), ~((F.abs("weight") <= atol) | (F.abs(F.col("weight") - loop) <= atol))).otherwise(~((F.abs("weight") <= atol) | (F.abs(F.col("weight") - 1) <= atol)))
    return e.filter(bad).isEmpty()


def threshold(edges: DataFrame, tau: Column | float) -> DataFrame:
    """Arcs of at least ``tau`` (a number or a column), as 1, without loops."""
    return edges.filter((F.col("src") != F.col("dst")) & (F.col("weight") >= tau)).withColumn("weight", F.lit(1.0))


def mutual_only(edges: DataFrame, by: By = ()) -> DataFrame:
    """Arcs whose reverse is there as well."""
    back = reverse(edges).select(*by, "src", "dst")
    return edges.join(back, [*by, "src", "dst"], "left_semi")


def bipartite_counts(types: DataFrame, column: str = "type", by: By = ()) -> DataFrame:
    return types.groupBy(*by).agg(F.count_if(F.col(column)).alias("n_true"), F.count_if(~F.col(column)).alias("n_false"))


def relabel(membership: DataFrame, column: str = "community", by: By = ()) -> DataFrame:
    """Labels 1..C in the order of the old ones, by a join with the (few) distinct labels instead of a window over all nodes."""
    w = Window.partitionBy(*by).orderBy(column) if by else Window.orderBy(column)
    labels = membership.select(*by, column).distinct().withColumn("_new", F.dense_rank().over(w))
    return membership.join(labels, [*by, column]).withColumn(column, F.col("_new")).drop("_new")


def contract(edges: DataFrame, membership: DataFrame, column: str = "community", directed: bool = True, by: By = ()) -> DataFrame:
    """The quotient graph: weights summed between communities; undirected pairs are put together."""
    m = membership.select(*by, "id", column)
    e = with_weight(edges).join(m.withColumnRenamed("id", "src").withColumnRenamed(column, "_s"), [*by, "src"]).join(m.withColumnRenamed("id", "dst").withColumnRenamed(column, "_d"), [*by, "dst"])
    e = e.select(*by, F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight")
    return aggregate(e, "sum", by) if directed else undirected(e, "sum", by)


def distance_to_counts(edges: DataFrame, method: str = "scaled_reciprocal", tau: float | None = None, target_median: float = 10.0, by: By = (), underflow: float | None = None) -> DataFrame:
    """Distances turned into whole counts of ties; rows of count 0 go. Ties are rounded half to even.

    ``underflow``: the factor of ``exp_decay`` where the median decay is 0, as for distances of many hundred ``tau``; ``target_median``
    if not given. Infinity gives what floating point division by 0 does: counts that are infinite, or NaN for a decay of 0.
    """
    key = list(by)
    stats = edges.groupBy(*key).agg(F.max("weight").alias("_max"), F.percentile("weight", F.lit(0.5)).alias("_median"))
    e = edges.join(stats, key) if key else edges.crossJoin(F.broadcast(stats))  # one row
    w = F.col("weight")
    if method == "scaled_reciprocal":
        positive = F.bround(F.col("_max") / w)
        e = e.withColumn("_n", F.when(w > 0, positive))
        top = e.groupBy(*key).agg(F.max("_n").alias("_top"))
        e = e.join(top, key) if key else e.crossJoin(F.broadcast(top))
        n = F.coalesce("_n", "_top")
    elif method == "max_minus":
        n = F.bround(F.col("_max") - w)
    elif method == "exp_decay":
        if tau is None or tau <= 0:
            raise ValueError("exp_decay needs a positive tau")
        raw = F.exp(-w / tau)
        mid = e.withColumn("_raw", raw).groupBy(*key).agg(F.percentile("_raw", F.lit(0.5)).alias("_mid"))
        e = e.join(mid, key) if key else e.crossJoin(F.broadcast(mid))
        factor = F.when(F.col("_mid") > 0, F.lit(float(target_median)) / F.col("_mid")).otherwise(float(target_median if underflow is None else underflow))
        n = F.bround(factor * raw)
    else:
        raise ValueError(f"unknown method {method!r}")
    return e.withColumn("weight", n.cast("double")).filter("weight > 0").select(edges.columns)


def project(links: DataFrame, left: str = "left", right: str = "right", min_weight: float = 0.0, by: By = ()) -> DataFrame:
    """One-mode projection of a bipartite graph: pairs of left nodes, smaller first, by the summed products of shared weights.

    A right node of n neighbours gives n(n-1)/2 pairs, which is the result's own size; products are summed before they are shuffled.
    """
    w = with_weight(links).groupBy(*by, left, right).agg(F.sum("weight").alias("weight"))
    other = w.select(*by, F.col(left).alias("_l"), right, F.col("weight").alias("_w"))
    pairs = w.join(other, [*by, right]).filter(F.col(left) < F.col("_l"))
    out = pairs.groupBy(*by, F.col(left).alias("src"), F.col("_l").alias("dst")).agg(F.sum(F.col("weight") * F.col("_w")).alias("weight"))
    return out.filter((F.col("weight") > 0) & (F.col("weight") >= min_weight))
