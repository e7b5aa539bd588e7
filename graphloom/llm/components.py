"""Connected components of an edge table by contraction: each round replaces edges by edges between what their ends merged into,
so the table shrinks from round to round, until what is left fits one task. Nothing is collected on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Edges that one task joins up.
LAST = 1_000_000


def join_up(batches):
    """(u, to) of every node of the edges (u, v) in one task, by union-find; to: its component's least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"u": list(parent), "to": [root(x) for x in list(parent)]}, dtype="int64")


def components(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """(node, label) of every node that has an edge; label: one node of its component, the same for all of it.

    First each node merges into the least ``a`` of its edges as ``b``: only edges among those stay, so a node of very many edges
    (as ``a``) is met by no join. Each ``b`` should have few edges. Then each node merges into that of its neighbours and
    itself whose hash, drawn anew for each round, is least: a constant share of the nodes goes in a round, whatever the graph's
    shape. When ``last`` edges are left, one task joins them up.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    ends = F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("a")), F.struct(F.col("a").alias("node"), F.lit(None).cast("long").alias("a")))
    own = e.select(F.explode(ends).alias("_e")).select("_e.node", "_e.a")
    first = own.groupBy("node").agg(F.collect_set("a").alias("all"), F.max(F.col("a").isNull()).alias("hub"))
    first = cut(first.select("node", F.array_min("all").alias("to"), "all", "hub"))
    among = F.transform(F.array_remove("all", F.col("to")), lambda x: F.struct(F.col("to").alias("u"), x.alias("v")))
    own = F.when(F.col("hub"), F.array(F.struct(F.col("node").alias("u"), F.col("to").alias("v")))).otherwise(F.array().cast("array<struct<u:bigint,v:bigint>>"))
    rest = first.filter("to is not null").select(F.explode(F.concat(among, own)).alias("_e")).select("_e.u", "_e.v").filter("u <> v")
    known = first.select("node", F.coalesce("to", "node").alias("to"))
    steps: list[DataFrame] = []
    if (left := rest.count()) > last:
        rest = cut(rest.union(rest.select("v", "u")).distinct())
        left = rest.count()
    while left > last:
        rank = lambda c, k=len(steps): F.xxhash64(c, F.lit(k))
        best = rest.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"), F.min(rank("v")).alias("least"))
        steps.append(cut(best.select("u", F.when(rank("u") <= F.col("least"), F.col("u")).otherwise(F.col("v")).alias("to"))))
        half = cut(rest.join(steps[-1], "u").select(F.col("to").alias("u"), "v"))
        rest = cut(half.join(steps[-1].select(F.col("u").alias("v"), "to"), "v").select("u", F.col("to").alias("v")).filter("u <> v").distinct())
        left = rest.count()
    if left:
        steps.append(cut(rest.coalesce(1).mapInPandas(join_up, "u long, to long")))
    if not steps:
        return known.withColumnRenamed("to", "label")
    end = steps[-1]
    for step in reversed(steps[:-1]):
        end = cut(step.join(end.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to")))
    return known.join(end.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("label"))
