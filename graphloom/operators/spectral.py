"""Bonacich power centrality by its series, with the largest eigenvalue from power iteration; only joins and sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..model import By, aggregate, binarize, cut, roster, symmetrize

TOLERANCE = 1e-10
#: Nodes of all graphs together up to which each graph is solved densely in one group.
DENSE_NODES = 3000


def _times(matrix: DataFrame, x: DataFrame, by: By) -> DataFrame:
    """A x for x as ``[*by, id, x]``; rows of zero sum drop out."""
    v = x.withColumnRenamed("id", "dst")
    return matrix.join(v, [*by, "dst"]).groupBy(*by, F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def lambda_max(matrix: DataFrame, ids: DataFrame, by: By = (), rounds: int = 200, seed: int = 20260101) -> DataFrame:
    """``[*by, lambda]``: growth of the norm under repeated multiplication of a fixed random vector."""
    x = ids.withColumn("x", uniform(seed, "id"))
    held, last = None, None
    for k in range(rounds):
        y = cut(_times(matrix, x, by))
        norms = cut(y.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
        # the norm is that of A times a vector of length 1 from the second round on
        if last is not None:
            gap = (norms.join(last.withColumnRenamed("norm", "was"), list(by)) if by else norms.crossJoin(last.withColumnRenamed("norm", "was"))).filter(F.abs(F.col("norm") - F.col("was")) > TOLERANCE * F.greatest(F.lit(1.0), F.col("norm")))
            if gap.isEmpty():
                return norms.withColumnRenamed("norm", "lambda")
        j = y.join(norms, list(by)) if by else y.crossJoin(F.broadcast(norms))
        x = j.filter("norm > 0").select(*by, "id", (F.col("x") / F.col("norm")).alias("x"))
        last = held = norms
    return held.withColumnRenamed("norm", "lambda")


def bonacich(edges: DataFrame, nodes=None, directed: bool = True, direction: str = "out", beta: float | None = None, normalize: str = "none", by: By = ()) -> DataFrame:
    """``[*by, id, bonacich, beta_used]`` of the binary graph: the sum of beta^k A^(k+1) 1, with beta half the inverse of the largest eigenvalue if not given.

    ``direction``: out (rows), in (columns) or symmetric (a tie in either direction). At half the inverse eigenvalue
    each term is about half of the one before, so some forty joins give double precision, whatever the graph's size.
    """
    e = binarize(aggregate(edges, "sum", by))
    if not directed or direction == "symmetric":
        e = symmetrize(e, False, by)
    elif direction == "in":
        e = e.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    matrix = cut(e)
    ids = cut(roster(edges, nodes, by))
    if ids.count() <= DENSE_NODES:
        return _dense(matrix, ids, beta, normalize, by)
    if beta is None:
        lam = lambda_max(matrix, ids, by)
        b = lam.select(*by, F.when(F.col("lambda") > 0, 0.5 / F.col("lambda")).otherwise(0.0).alias("beta_used"))
    else:
        b = ids.select(*by).distinct().withColumn("beta_used", F.lit(float(beta))) if by else ids.sparkSession.createDataFrame([(float(beta),)], "beta_used double")
    b = cut(b)
    with_beta = lambda df: df.join(b, list(by)) if by else df.crossJoin(F.broadcast(b))
    term = cut(_times(matrix, ids.withColumn("x", F.lit(1.0)), by))
    total = term
    for k in range(1, 200):
        term = cut(with_beta(_times(matrix, term, by)).select(*by, "id", (F.col("x") * F.col("beta_used")).alias("x")))
        total = cut(total.unionByName(term).groupBy(*by, "id").agg(F.sum("x").alias("x")))
        size = term.agg(F.max(F.abs("x")).alias("m")).first()["m"]
        if not size or size < 1e-14:
            break
    out = with_beta(ids.join(total, [*by, "id"], "left").select(*by, "id", F.coalesce("x", F.lit(0.0)).alias("bonacich")))
    if normalize != "none":
        norm = out.groupBy(*by).agg((F.sqrt(F.avg(F.col("bonacich") ** 2)) if normalize == "l2" else F.max("bonacich")).alias("_s"))
        out = out.join(norm, list(by)) if by else out.crossJoin(F.broadcast(norm))
        out = out.withColumn("bonacich", F.when(F.col("_s") > 0, F.col("bonacich") / F.col("_s")).otherwise(0.0))
    return out.select(*by, "id", "bonacich", "beta_used")


def solve(a: np.ndarray, beta: float | None, normalize: str) -> tuple[np.ndarray, float]:
    """(I - beta A) x = A 1, for one small graph."""
    if beta is None:
        top = float(np.abs(np.linalg.eigvals(a)).max()) if a.size else 0.0
        beta = 0.5 / top if top > 1e-12 else 0.0
    x = np.linalg.solve(np.eye(len(a)) - beta * a, a.sum(axis=1))
    scale = {"none": 1.0, "l2": float(np.sqrt((x * x).mean())), "max": float(x.max())}[normalize] if len(x) else 1.0
    return (x / scale if scale > 0 else np.zeros_like(x)), beta


def _dense(matrix: DataFrame, ids: DataFrame, beta: float | None, normalize: str, by: By) -> DataFrame:
    rows = ids.select(*by, "id", F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")).union(matrix.select(*by, "src", "dst", "weight"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(pdf.loc[pdf["dst"].isna(), "id"]))
        arcs = pdf[pdf["dst"].notna()]
        a = np.zeros((len(names), len(names)))
        np.add.at(a, (np.searchsorted(names, arcs["id"].to_numpy().astype(str)), np.searchsorted(names, arcs["dst"].to_numpy().astype(str))), arcs["weight"].to_numpy())
        x, used = solve(a, beta, normalize)
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "id": names, "bonacich": x, "beta_used": used})

    schema = ", ".join([*(f"{b} {ids.schema[b].dataType.simpleString()}" for b in by), "id string, bonacich double, beta_used double"])
    return rows.groupBy(*by).applyInPandas(kernel, schema)
