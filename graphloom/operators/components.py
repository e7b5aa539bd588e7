"""Weak, strong and biconnected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, cut, no_loops, roster, simple


def weak_components(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, id, component]`` (the smallest id), by min-label joins with pointer jumping; rounds grow with the diameter's logarithm."""
    e = no_loops(edges).select(*by, F.col("src").alias("u"), F.col("dst").alias("v"))
    both = cut(e.union(e.select(*by, "v", "u")).distinct())
    labels = cut(roster(edges, nodes, by).select(*by, "id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), [*by, "v"]).groupBy(*by, F.col("u").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, [*by, "id"], "left").select(*by, "id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = hooked.select(*by, F.col("id").alias("to"), F.col("to").alias("next"))
        new = cut(hooked.join(jump, [*by, "to"], "left").select(*by, "id", "was", F.least("to", F.coalesce("next", "to")).alias("component")))
        labels = new.drop("was")
        if new.filter("was <> component").isEmpty():
            return labels


def strong_components(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, id, component]``: forward colouring by the smallest id that reaches a node, then what reaches its colour's root back within the colour."""
    arcs = cut(simple(edges, by))
    left = cut(roster(edges, nodes, by))
    done = None
    while not left.isEmpty():
        own = arcs.join(left.withColumnRenamed("id", "src"), [*by, "src"], "left_semi").join(left.withColumnRenamed("id", "dst"), [*by, "dst"], "left_semi")
        own = cut(own)
        colour = cut(left.withColumn("c", F.col("id")))
        while True:
            into = own.join(colour.withColumnRenamed("id", "src"), [*by, "src"]).groupBy(*by, F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(into, [*by, "id"], "left").select(*by, "id", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c")))
            colour = new.drop("was")
            if new.filter("was <> c").isEmpty():
                break
        inside = own.join(colour.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), [*by, "src"]).join(colour.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), [*by, "dst"]).filter("cs = cd").select(*by, "src", "dst")
        inside = cut(inside)
        found = cut(colour.filter("id = c"))
        front = found
        while True:
            front = cut(inside.join(front.select(*by, F.col("id").alias("dst"), "c"), [*by, "dst"]).select(*by, F.col("src").alias("id"), "c").distinct().join(found.select(*by, "id"), [*by, "id"], "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        part = found.withColumnRenamed("c", "component")
        done = part if done is None else cut(done.unionByName(part))
        left = cut(left.join(part.select(*by, "id"), [*by, "id"], "left_anti"))
    return done


def largest_share(labels: DataFrame, by: By = ()) -> DataFrame:
    sizes = labels.groupBy(*by, "component").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg((F.max("n") / F.sum("n")).alias("largest_component"))


def largest_component(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, largest_component]``: the largest weak component's share of the roster, also for directed graphs."""
    return largest_share(weak_components(edges, nodes, by), by)


def bicomponents_of(pairs: list[tuple]) -> list[set]:
    """Node sets of the biconnected components of an undirected graph, by one depth-first walk with an edge stack."""
    adj: dict = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    depth, low, out, edges = {}, {}, [], []
    for root in adj:
        if root in depth:
            continue
        depth[root] = low[root] = 0
        walk = [(root, None, iter(adj[root]))]
        while walk:
            v, parent, rest = walk[-1]
            for w in rest:
                if w not in depth:
                    edges.append((v, w))
                    depth[w] = low[w] = depth[v] + 1
                    walk.append((w, v, iter(adj[w])))
                    break
                if w != parent and depth[w] < depth[v]:
                    edges.append((v, w))
                    low[v] = min(low[v], depth[w])
            else:
                walk.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= depth[parent]:
                        own: set = set()
                        while edges:
                            e = edges.pop()
                            own |= set(e)
                            if e == (parent, v):
                                break
                        out.append(own)
    return out


def largest_bicomponent(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, largest_bicomponent]``: share of the roster in the largest biconnected component; a bridge has two nodes, an isolate one.

    Each weak component is one group: the walk is sequential, so its size bounds what fits.
    """
    r = roster(edges, nodes, by)
    labels = weak_components(edges, r, by)
    pairs = simple(edges, by).select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    keyed = pairs.join(labels.select(*by, F.col("id").alias("a"), "component"), [*by, "a"])

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = bicomponents_of(list(zip(pdf["a"], pdf["b"])))
        return pdf[[*by]].head(1).assign(m=max(map(len, sets), default=1))

    schema = ", ".join([*(f"{b} {keyed.schema[b].dataType.simpleString()}" for b in by), "m long"])
    top = keyed.groupBy(*by, "component").applyInPandas(most, schema).groupBy(*by).agg(F.max("m").alias("m"))
    n = r.groupBy(*by).agg(F.count("*").alias("n"))
    j = n.join(top, list(by), "left") if by else n.join(top, F.lit(True), "left")  # one row each
    return j.select(*by, F.when(F.col("n") > 0, F.coalesce("m", F.lit(1)) / F.col("n")).otherwise(0.0).alias("largest_bicomponent"))
