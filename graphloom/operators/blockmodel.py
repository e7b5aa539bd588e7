"""Structural equivalence: Ward clusters of nodes with correlated profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import By, aggregate, no_loops, roster, symmetrize

#: Nodes with ties that a dense clustering of one graph takes.
MAX_NODES = 5000


def profile_distance(a: np.ndarray, directed: bool) -> np.ndarray:
    """One minus the correlation of the nodes' rows (and columns); 2 where a profile has no variance."""
    p = np.hstack([a, a.T]) if directed else a
    p = p - p.mean(axis=1, keepdims=True)
    norm = np.sqrt((p * p).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 1 - (p @ p.T) / np.outer(norm, norm)
    d[~np.isfinite(d)] = 2.0
    d = np.clip(d, 0, 2)
    np.fill_diagonal(d, 0)
    return d


def ward(d: np.ndarray, k: int) -> np.ndarray:
    """Labels 1..k, by first appearance, after merging the closest clusters under Ward's update of squared distances."""
    n = len(d)
    sq = d.astype(float) ** 2
    np.fill_diagonal(sq, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(max(0, n - k)):
        i, j = sorted(divmod(int(np.argmin(sq)), n))
        others = alive.copy()
        others[[i, j]] = False
        s = size[i] + size[j] + size[others]
        new = ((size[i] + size[others]) * sq[i, others] + (size[j] + size[others]) * sq[j, others] - size[others] * sq[i, j]) / s
        sq[i, others] = sq[others, i] = new
        sq[j, :] = sq[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    _, first = np.unique(label, return_index=True)
    order = {label[f]: r + 1 for r, f in enumerate(sorted(first))}
    return np.array([order[x] for x in label])


def blockmodel(edges: DataFrame, nodes=None, n_blocks: int = 8, directed: bool = True, by: By = ()) -> DataFrame:
    """``[*by, id, block]``: isolates are block 0, the others 1..n_blocks; each graph is one dense group of at most ``MAX_NODES``."""
    e = no_loops(aggregate(edges, "sum", by))
    if not directed:
        e = symmetrize(e, False, by)
    rows = roster(edges, nodes, by).select(*by, "id", F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")).union(e.select(*by, "src", "dst", "weight"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(pdf.loc[pdf["dst"].isna(), "id"]))
        arcs = pdf[pdf["dst"].notna()]
        s, t = (np.searchsorted(names, arcs[c].to_numpy().astype(str)) for c in ("id", "dst"))
        active = np.unique(np.concatenate([s, t])) if len(s) else np.zeros(0, int)
        if len(active) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes with ties")
        block = np.zeros(len(names), int)
        if len(active):
            a = np.zeros((len(active), len(active)))
            np.add.at(a, (np.searchsorted(active, s), np.searchsorted(active, t)), arcs["weight"].to_numpy())
            block[active] = ward(profile_distance(a, directed), min(n_blocks, len(active)))
        return pd.DataFrame({**{b: pdf[b].iloc[0] for b in by}, "id": names, "block": block})

    schema = ", ".join([*(f"{b} {edges.schema[b].dataType.simpleString()}" for b in by), "id string, block int"])
    return rows.groupBy(*by).applyInPandas(kernel, schema)
