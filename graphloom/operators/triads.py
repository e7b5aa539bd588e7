"""The census of the sixteen triad classes, alone, by weight threshold, and against random graphs of the same dyads.

Only triangles are listed. Triads of two connected dyads are counted from each node's mutual, out and in neighbours, less those
that triangles close; triads of one connected dyad and the empty ones follow by subtraction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import By, cut, mutual_only, no_loops, roster, simple, with_weight
from .clustering import triangles

# The classes in their usual order, and the weights of the ranked-clusters and the transitivity statistics.
CLASSES = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def _pair(n):
    return n * (n - 1) / 2


def triad_census(edges: DataFrame, nodes=None, directed: bool = True, by: By = ()) -> DataFrame:
    """``[*by, triad, count]`` of all classes; undirected graphs have mutual dyads only."""
    arcs = simple(edges, by)
    if not directed:
        arcs = arcs.union(arcs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    n = roster(edges, nodes, by).groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    # code: 1 a->b, 2 b->a, 3 both
    dyads = arcs.groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("code"))
    flip = F.when(F.col("code") == 3, 3).otherwise(3 - F.col("code"))
    sides = dyads.select(*by, F.col("a").alias("v"), "code").union(dyads.select(*by, F.col("b").alias("v"), flip))
    per = sides.groupBy(*by, "v").agg(*[F.count_if(F.col("code") == c).cast("double").alias(k) for c, k in ((1, "o"), (2, "i"), (3, "m"))])
    o, i, m = F.col("o"), F.col("i"), F.col("m")
    wedge = per.groupBy(*by).agg(F.sum(_pair(o)).alias("021D"), F.sum(_pair(i)).alias("021U"), F.sum(o * i).alias("021C"), F.sum(i * m).alias("111D"), F.sum(o * m).alias("111U"), F.sum(_pair(m)).alias("201"))
    counts = dyads.groupBy(*by).agg(F.count_if(F.col("code") == 3).cast("double").alias("M"), F.count_if(F.col("code") != 3).cast("double").alias("A"))
    t = triangles(arcs, by)
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(dyads.select(*by, F.col("a").alias(x), F.col("b").alias(y), F.col("code").alias(x + y)), [*by, x, y])
    # the dyads at each corner, as seen from it
    seen = lambda c, first: c if first else F.when(c == 3, 3).otherwise(3 - c)
    corners = {"a": (seen(F.col("ab"), True), seen(F.col("ac"), True)), "b": (seen(F.col("ab"), False), seen(F.col("bc"), True)), "c": (seen(F.col("ac"), False), seen(F.col("bc"), False))}
    mutuals = sum((F.when(F.col(x) == 3, 1).otherwise(0) for x in ("ab", "ac", "bc")), F.lit(0))
    both = lambda p, x, y: ((p[0] == x) & (p[1] == y)) | ((p[0] == y) & (p[1] == x))
    kinds = {"021D": (1, 1), "021U": (2, 2), "021C": (1, 2), "111D": (2, 3), "111U": (1, 3), "201": (3, 3)}
    at = {k: sum((F.when(both(p, *v), 1).otherwise(0) for p in corners.values()), F.lit(0)) for k, v in kinds.items()}
    cls = F.when(mutuals == 3, "300").when(mutuals == 2, "210").when((mutuals == 1) & (at["021D"] == 1), "120D").when((mutuals == 1) & (at["021U"] == 1), "120U").when(mutuals == 1, "120C").when(at["021C"] == 3, "030C").otherwise("030T")
    t = t.select(*by, cls.alias("triad"), mutuals.alias("_m"), *[v.alias(f"_{k}") for k, v in at.items()])
    full = ("030T", "030C", "120D", "120U", "120C", "210", "300")
    tri = t.groupBy(*by).agg(*[F.count_if(F.col("triad") == c).cast("double").alias(c) for c in full], *[F.sum(f"_{k}").cast("double").alias(f"_{k}") for k in kinds], F.sum("_m").cast("double").alias("_tm"), F.sum(3 - F.col("_m")).cast("double").alias("_ta"))
    row = n
    for other in (wedge, counts, tri):
        row = row.join(other, list(by), "left") if by else row.join(F.broadcast(other), F.lit(True), "left")  # one row each
    row = row.na.fill(0.0)
    open_ = {k: F.col(k) - F.col(f"_{k}") for k in kinds}
    asym = 2 * (open_["021D"] + open_["021U"] + open_["021C"]) + open_["111D"] + open_["111U"] + F.col("_ta")
    mut = open_["111D"] + open_["111U"] + 2 * open_["201"] + F.col("_tm")
    one = {"012": F.col("A") * (F.col("n") - 2) - asym, "102": F.col("M") * (F.col("n") - 2) - mut}
    value = {**one, **open_, **{c: F.col(c) for c in full}}
    value["003"] = F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6 - sum(value.values(), F.lit(0.0))
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("triad"), F.round(value[c]).cast("long").alias("count")) for c in CLASSES])).alias("t")
    return row.select(*by, stacked).select(*by, "t.triad", "t.count")


def densities(census: DataFrame, by: By = ()) -> DataFrame:
    w = Window.partitionBy(*by)
    total = F.sum("count").over(w)
    return census.withColumn("density", F.when(total > 0, F.col("count") / total).otherwise(0.0))


def tau_grid(edges: DataFrame, layers: int = 40, lo: float | None = None, hi: float | None = None) -> list[float]:
    """Log-spaced thresholds within the weights, the lowest at their half-percent quantile by default; a handful of numbers."""
    q = edges.filter("weight > 0").agg(F.percentile("weight", F.lit(0.005)).alias("q"), F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    if q["lo"] is None:
        return []
    a, b = max(lo if lo is not None else q["q"], q["lo"]), min(hi if hi is not None else q["hi"], q["hi"])
    if layers < 2 or a >= b:
        return [a]
    step = (math.log10(b) - math.log10(a)) / (layers - 1)
    return [10 ** (math.log10(a) + k * step) for k in range(layers)]


def layered_census(edges: DataFrame, nodes=None, taus: list[float] | None = None, directed: bool = True, reciprocity_collapse: bool = False) -> DataFrame:
    """``[tau, triad, count, density]``: the census of the arcs of at least each threshold, all thresholds in one job."""
    e = no_loops(with_weight(edges))
    if not directed:
        e = e.unionByName(e.select(*[F.col(c).alias({"src": "dst", "dst": "src"}.get(c, c)) for c in e.columns]).select(e.columns)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    taus = taus if taus is not None else tau_grid(e)
    spark = edges.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in taus], "tau double")
    layers = e.join(F.broadcast(grid), F.col("weight") >= F.col("tau"))  # as many rows as thresholds for each arc
    if reciprocity_collapse and directed:
        layers = mutual_only(layers, ["tau"])
    ids = roster(edges, nodes).crossJoin(F.broadcast(grid))
    return densities(triad_census(layers, ids, directed, ["tau"]), ["tau"])


def layer_summary(layers: DataFrame) -> DataFrame:
    """``[triad, aumc, tau_peak, peak]``: area under each class's density over log10 tau by trapezoids, and its first peak."""
    w = Window.partitionBy("triad").orderBy("tau")
    x = F.log10("tau")
    area = (F.lead(x).over(w) - x) * (F.lead("density").over(w) + F.col("density")) / 2
    a = layers.withColumn("_area", area)
    return a.groupBy("triad").agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("aumc"), F.max_by("tau", F.struct("density", -F.col("tau"))).alias("tau_peak"), F.max("density").alias("peak"))


def triangle_profile(edges: DataFrame, taus: list[float], directed: bool = True, reciprocity_collapse: bool = False) -> DataFrame:
    """``[tau, triangles]`` of the undirected graph at each threshold."""
    e = no_loops(with_weight(edges))
    grid = edges.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    layers = e.join(F.broadcast(grid), F.col("weight") >= F.col("tau"))
    if reciprocity_collapse and directed:
        layers = mutual_only(layers, ["tau"])
    t = triangles(layers, ["tau"]).groupBy("tau").agg(F.count("*").alias("triangles"))
    return grid.join(t, "tau", "left").select("tau", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def tau_bounds(edges: DataFrame, lo: float = 0.01, hi: float = 0.99) -> tuple[float, float]:
    r = edges.filter("weight > 0 and not isnan(weight)").agg(F.percentile("weight", F.array(F.lit(lo), F.lit(hi))).alias("q")).first()["q"]
    return (float(r[0]), float(r[1])) if r else (1.0, 1.0)


def suggested_layers(lo: float, hi: float, per_decade: int = 8, least: int = 8, most: int = 64) -> int:
    decades = math.log10(hi / lo) if hi > lo > 0 else 0.0
    return min(max(math.ceil(per_decade * decades), least), most)


def recommend_layers(edges: DataFrame, nodes=None, directed: bool = True, method: str = "auto", n_exploratory: int = 16, frac_keep: float = 1 / math.e, t_floor: int = 9, per_decade: int = 8, least: int = 8, most: int = 64, tol: float = 1e-3, t_analytic: int = 10_000, t_empirical: int = 100, grid=(8, 12, 16, 24, 32, 48, 64)) -> dict:
    """How many thresholds a layered census needs, and between which: from the triangle profile's decay, or by trying until areas settle."""
    lo, hi = tau_bounds(edges)
    taus = tau_grid(edges, n_exploratory, lo, hi)
    profile = sorted((r["tau"], r["triangles"]) for r in triangle_profile(edges, taus, directed).collect())  # n_exploratory rows
    top = max((t for _, t in profile), default=0)
    decades = math.log10(hi / lo) if hi > lo > 0 else 0.0
    falling = sum(t_floor <= t <= frac_keep * top for _, t in profile)
    if method == "auto":
        method = "analytic" if top >= t_analytic else "empirical" if top < t_empirical else "analytic" if decades >= 1 and falling >= 3 else "empirical"
    if method == "analytic":
        first = [x for x, t in profile if t <= frac_keep * top]
        last = [x for x, t in profile if t >= t_floor]
        a, b = (first[0] if first else lo), (last[-1] if last else hi)
        if a >= b:
            a, b = lo, hi
        return {"L": suggested_layers(a, b, per_decade, least, most), "tau_min": a, "tau_max": b, "method": method, "T_max": top, "decades": decades, "converged": True}
    before = None
    for n in grid:
        s = {r["triad"]: r["aumc"] for r in layer_summary(layered_census(edges, nodes, tau_grid(edges, n, lo, hi), directed)).collect()}  # 16 rows
        if before is not None and max(abs(s[k] - before[k]) for k in s) < tol:
            return {"L": n, "tau_min": lo, "tau_max": hi, "method": method, "T_max": top, "decades": decades, "converged": True}
        before = s
    return {"L": grid[-1], "tau_min": lo, "tau_max": hi, "method": method, "T_max": top, "decades": decades, "converged": False}


def dyad_census(edges: DataFrame, nodes=None, by: By = ()) -> DataFrame:
    """``[*by, M, A, N]``: mutual, one-way and empty dyads."""
    arcs = simple(edges, by)
    d = arcs.groupBy(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("k")).groupBy(*by).agg(F.count_if(F.col("k") == 2).alias("M"), F.count_if(F.col("k") == 1).alias("A"))
    n = roster(edges, nodes, by).groupBy(*by).agg(F.count("*").alias("n"))
    j = n.join(d, list(by), "left") if by else n.join(d, F.lit(True), "left")  # one row each
    m, a = F.coalesce("M", F.lit(0)), F.coalesce("A", F.lit(0))
    return j.select(*by, m.alias("M"), a.alias("A"), (F.col("n") * (F.col("n") - 1) / 2 - m - a).cast("long").alias("N"))


def weighting(name: str | list[float]) -> list[float]:
    """Sixteen weights by class: ``RC`` (ranked clusters) or ``transitivity``, or the given ones."""
    if not isinstance(name, str):
        if len(name) != 16:
            raise ValueError("a weighting has sixteen numbers")
        return list(name)
    own = {"RC": {"003", "102", "021D", "021U", "030T", "120D", "120U", "300"}, "transitivity": {"003", "012", "102", "021D", "021U", "030T", "120D", "120U", "210", "300"}}[name]
    return [1.0 if c in own else 0.0 for c in CLASSES]


def weighted_census(census: DataFrame, weights: str | list[float] = "RC", by: By = ()) -> DataFrame:
    """``[*by, total]``: the counts, each times its class's weight, summed up."""
    w = dict(zip(CLASSES, weighting(weights)))
    own = F.element_at(F.create_map(*(F.lit(x) for pair in w.items() for x in pair)), F.col("triad"))
    return census.groupBy(*by).agg(F.sum(F.col("count") * own).alias("total"))


def tau_statistic(edges: DataFrame, nodes=None, weights: str | list[float] = "RC", n_samples: int = 500, seed: int = 20260101) -> DataFrame:
    """One row: the weighted census against ``n_samples`` random graphs of the same mutual and one-way dyads, all in one job.

    Each sample draws its connected dyads from the numbers of all pairs, without replacement, by its own seed.
    """
    spark = edges.sparkSession
    r = cut(roster(edges, nodes))
    d = dyad_census(edges, r).first()
    n, m, a = r.count(), d["M"], d["A"]
    score = lambda c, by=(): weighted_census(c, weights, by).withColumnRenamed("total", "t")
    seen = score(triad_census(edges, r)).first()["t"]

    def draw(frames):
        for pdf in frames:
            for k in pdf["id"].tolist():
                rng = np.random.default_rng([seed, k])
                pair = rng.choice(n * (n - 1) // 2, m + a, replace=False) if m + a else np.zeros(0, np.int64)
                j = ((1 + np.sqrt(1 + 8 * pair.astype(float))) / 2).astype(np.int64)  # pair number to (i, j), i < j
                j -= j * (j - 1) // 2 > pair
                j += j * (j + 1) // 2 <= pair
                i = pair - j * (j - 1) // 2
                up = rng.random(m + a) < 0.5
                both = np.arange(m + a) < m
                src, dst = np.concatenate([i[both | up], j[both | ~up]]), np.concatenate([j[both | up], i[both | ~up]])
                yield pd.DataFrame({"sample": k, "src": src.astype(str), "dst": dst.astype(str)})

    drawn = cut(spark.range(n_samples).repartition(max(1, min(n_samples, spark.sparkContext.defaultParallelism))).mapInPandas(draw, "sample long, src string, dst string"))
    ids = spark.range(n_samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("node")).select("sample", F.col("node").cast("string").alias("id"))
    t = score(triad_census(drawn, ids, by=["sample"]), ["sample"])
    s = t.agg(F.avg("t").alias("mean"), F.coalesce(F.stddev_samp("t"), F.lit(0.0)).alias("sd"))
    return s.select(F.lit(float(seen)).alias("observed"), "mean", "sd", F.when(F.col("sd") > 0, (F.lit(float(seen)) - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("tau"), F.lit(n_samples).alias("n_samples"), F.lit(m).alias("M"), F.lit(a).alias("A"), F.lit(d["N"]).alias("N"))
