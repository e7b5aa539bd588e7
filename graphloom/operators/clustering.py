"""Triangles and clustering, from triangle enumeration along degree order; open wedges are counted, never listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, aggregate, no_loops, roster, simple


def triangles(pairs: DataFrame, by: By = ()) -> DataFrame:
    """``[*by, a, b, c]`` of each triangle once. Pairs point from the node of smaller degree to the larger, so a hub has few wedges to check."""
    p = pairs.select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    ends = p.select(*by, F.col("a").alias("v")).union(p.select(*by, F.col("b").alias("v"))).groupBy(*by, "v").agg(F.count("*").alias("d"))
    d = p.join(ends.select(*by, F.col("v").alias("a"), F.col("d").alias("da")), [*by, "a"]).join(ends.select(*by, F.col("v").alias("b"), F.col("d").alias("db")), [*by, "b"])
    low = F.struct("da", "a") < F.struct("db", "b")
    o = d.select(*by, F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    other = o.select(*by, "u", F.col("v").alias("w"))
    wedges = o.join(other, [*by, "u"]).filter("v < w")
    closing = p.select(*by, F.col("a").alias("v"), F.col("b").alias("w"))
    found = wedges.join(closing, [*by, "v", "w"])
    s = F.array_sort(F.array("u", "v", "w"))
    return found.select(*by, s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def local_clustering(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, id, degree, triangles, clustering]`` of the undirected simple graph: closed share of each node's pairs of neighbours."""
    pairs = simple(edges, by).select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    deg = pairs.select(*by, F.col("src").alias("id")).union(pairs.select(*by, F.col("dst").alias("id"))).groupBy(*by, "id").agg(F.count("*").alias("degree"))
    tri = triangles(pairs, by).select(*by, F.explode(F.array("a", "b", "c")).alias("id")).groupBy(*by, "id").agg(F.count("*").alias("triangles"))
    j = roster(edges, nodes, by).join(deg, [*by, "id"], "left").join(tri, [*by, "id"], "left")
    k, t = F.coalesce("degree", F.lit(0)), F.coalesce("triangles", F.lit(0))
    return j.select(*by, "id", k.alias("degree"), t.alias("triangles"), F.when(k >= 2, 2.0 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def local_density(edges: DataFrame, nodes=None, directed: bool = True, loops: bool = False, by: By = ()) -> DataFrame:
    """``[*by, id, ego_density, local_clustering]``: arcs among a node's neighbours over the most there can be; with ``loops`` those count too."""
    arcs = simple(edges, by)
    if not directed:
        arcs = arcs.union(arcs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    pairs = arcs.select(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    dyad = arcs.groupBy(*by, F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.count("*").alias("arcs"))
    deg = pairs.select(*by, F.col("src").alias("id")).union(pairs.select(*by, F.col("dst").alias("id"))).groupBy(*by, "id").agg(F.count("*").alias("k"))
    t = triangles(pairs, by)
    corner = t.select(*by, F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("x"), F.col("c").alias("y")), F.struct(F.col("b").alias("id"), F.col("a").alias("x"), F.col("c").alias("y")), F.struct(F.col("c").alias("id"), F.col("a").alias("x"), F.col("b").alias("y")))).alias("t")).select(*by, "t.id", "t.x", "t.y")
    closed = corner.join(dyad, [*by, "x", "y"]).groupBy(*by, "id").agg(F.sum("arcs").alias("m"))
    extra = None
    if loops:
        own = aggregate(edges, "sum", by).filter("src = dst and weight > 0").select(*by, F.col("src").alias("y"))
        ends = pairs.select(*by, F.col("src").alias("id"), F.col("dst").alias("y")).union(pairs.select(*by, F.col("dst").alias("id"), F.col("src").alias("y")))
        extra = ends.join(own, [*by, "y"]).groupBy(*by, "id").agg(F.count("*").alias("l"))
    j = roster(edges, nodes, by).join(deg, [*by, "id"], "left").join(closed, [*by, "id"], "left")
    j = j.join(extra, [*by, "id"], "left") if extra is not None else j.withColumn("l", F.lit(0))
    k, m, l_ = (F.coalesce(c, F.lit(0)) for c in ("k", "m", "l"))
    most = k * (k - 1)
    ego = (k + 1) * k
    own_arcs = roster(edges, nodes, by).join(arcs.select(*by, F.col("src").alias("id")).union(arcs.select(*by, F.col("dst").alias("id"))).groupBy(*by, "id").agg(F.count("*").alias("own")), [*by, "id"], "left")
    j = j.join(own_arcs, [*by, "id"])
    own_ = F.coalesce("own", F.lit(0)) if directed else F.coalesce("own", F.lit(0))
    return j.select(*by, "id", F.when(ego > 0, (m + own_) / ego).otherwise(0.0).alias("ego_density"), F.when(most > 0, (m + l_) / (most + (k if loops else 0))).otherwise(0.0).alias("local_clustering"))


def directed_transitivity(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, id, triplets, closed, transitivity]`` of each middle node: in-middle-out paths j->i->k, j <> k, and those with j->k.

    Paths are counted from degrees (in times out, less mutual); only closed ones are listed, from triangles.
    """
    arcs = simple(edges, by)
    back = arcs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = arcs.join(back, [*by, "src", "dst"], "left_semi").groupBy(*by, F.col("src").alias("id")).agg(F.count("*").alias("mu"))
    ends = arcs.select(*by, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(arcs.select(*by, F.col("dst").alias("id"), F.lit(0), F.lit(1))).groupBy(*by, "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    t = triangles(arcs, by)
    orders = [(x, y, z) for x in "abc" for y in "abc" for z in "abc" if len({x, y, z}) == 3]
    paths = t.select(*by, F.explode(F.array(*[F.struct(F.col(x).alias("j"), F.col(y).alias("i"), F.col(z).alias("k")) for x, y, z in orders])).alias("p")).select(*by, "p.j", "p.i", "p.k")
    for s, d in (("j", "i"), ("i", "k"), ("j", "k")):
        paths = paths.join(arcs.select(*by, F.col("src").alias(s), F.col("dst").alias(d)), [*by, s, d], "left_semi")
    closed = paths.groupBy(*by, F.col("i").alias("id")).agg(F.count("*").alias("closed"))
    j = roster(edges, nodes, by).join(ends, [*by, "id"], "left").join(mutual, [*by, "id"], "left").join(closed, [*by, "id"], "left").na.fill(0, ["o", "i", "mu", "closed"])
    n = F.col("o") * F.col("i") - F.col("mu")
    return j.select(*by, "id", n.alias("triplets"), "closed", F.when(n > 0, F.col("closed") / n).otherwise(0.0).alias("transitivity"))


def global_clustering(edges: DataFrame, nodes=None, directed: bool = True, method: str = "average", by: By = (), empty: float | None = 0.0) -> DataFrame:
    """``[*by, clustering]``: the mean local coefficient over nodes of two neighbours or more, or transitivity; ``empty`` where there are none."""
    none = F.lit(empty).cast("double")
    if method == "average":
        c = local_density(edges, nodes, directed, by=by).join(local_clustering(edges, nodes, by).filter("degree >= 2").select(*by, "id"), [*by, "id"], "left_semi")
        return c.groupBy(*by).agg(F.coalesce(F.avg("local_clustering"), none).alias("clustering"))
    if directed:
        a = directed_transitivity(edges, nodes, by).groupBy(*by).agg(F.sum("closed").alias("c"), F.sum("triplets").alias("t"))
    else:
        a = local_clustering(edges, nodes, by).groupBy(*by).agg((2 * F.sum("triangles")).alias("c"), F.sum(F.col("degree") * (F.col("degree") - 1)).alias("t"))
    return a.select(*by, F.when(F.col("t") > 0, F.col("c") / F.col("t")).otherwise(none).alias("clustering"))
