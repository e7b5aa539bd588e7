"""Summary tables over many networks: one row each, all networks in one job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..model import aggregate, roster
from ..operators import clustering, components, degree, paths, reciprocity, spectral, triads

BY = ["network"]


def _together(first: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        first = first.join(o, BY, "left")
    return first


def network_summary(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, weighted: bool = False) -> DataFrame:
    """``[network, ...]``: size, degrees, centralizations, paths, components, reciprocity and clustering of each network."""
    e = aggregate(edges, "sum", BY)
    r = roster(edges, nodes, BY)
    how = "tie_strength" if weighted else "ignore"
    size = r.groupBy(*BY).agg(F.count("*").alias("n_nodes"))
    m = e.groupBy(*BY).agg(F.count("*").alias("n_edges"))
    d = degree.total_degree(e, r, weighted, directed, by=BY)
    row = [d.groupBy(*BY).agg(F.avg("total_degree").alias("mean_degree"), F.coalesce(F.stddev_samp("total_degree"), F.lit(0.0)).alias("sd_degree")), scalars.gini(d, "total_degree", BY).withColumnRenamed("gini", "gini_degree"), degree.freeman_centralization(e, r, directed=directed, by=BY)]
    p = paths.all_pairs(e, r, directed, how, by=BY)
    n = F.count("*")
    near = paths.all_pairs(e, r, False, how, by=BY)
    row += [near.groupBy(*BY).agg((F.avg("inv_out") / (n - 1)).alias("mean_closeness"), (F.sum("inv_out") / (n * (n - 1)) / F.log(n)).alias("mean_inverse_distance"))]
    row += [p.groupBy(*BY).agg((F.avg("between") / (1 if directed else 2)).alias("mean_betweenness"), (F.coalesce(F.stddev_samp("between"), F.lit(0.0)) / (1 if directed else 2)).alias("sd_betweenness"))]
    row += [spectral.bonacich(e, r, directed, "symmetric", normalize="max", by=BY).groupBy(*BY).agg(F.avg("bonacich").alias("mean_bonacich"), F.coalesce(F.stddev_samp("bonacich"), F.lit(0.0)).alias("sd_bonacich"))]
    row += [components.largest_component(e, r, BY), components.largest_bicomponent(e, r, BY), clustering.global_clustering(e, r, directed, "average", BY), clustering.global_clustering(e, r, directed, "transitivity", BY).withColumnRenamed("clustering", "transitivity")]
    if directed:
        row.append(reciprocity.reciprocity(e, BY).select(*BY, "arc", "dyad", "squartini"))
    if weighted:
        row.append(scalars.weight_summary(e, BY).select(*BY, F.col("min").alias("w_min"), F.col("max").alias("w_max"), F.col("median").alias("w_median"), F.col("iqr").alias("w_iqr"), F.col("gini").alias("w_gini")))
    return _together(size, m, *row)


def triad_table(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True) -> DataFrame:
    """``[network, 003, 012, ...]``: the census, one column a class."""
    return triads.triad_census(edges, roster(edges, nodes, BY), directed, BY).groupBy(*BY).pivot("triad", list(triads.CLASSES)).agg(F.first("count"))


def path_measures(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, direction: str = "symmetric", by: list[str] = ()) -> DataFrame:
    """``[*by, node, closeness_harmonic_sym, betweenness_directed, betweenness_undirected]`` of every node, weights ignored."""
    r = roster(edges, nodes, by)
    near = paths.closeness(edges, r, directed, direction, by=by).withColumnRenamed("closeness", "closeness_harmonic_sym")
    one = paths.betweenness(edges, r, directed, by=by).withColumnRenamed("betweenness", "betweenness_directed")
    both = paths.betweenness(edges, r, False, by=by).withColumnRenamed("betweenness", "betweenness_undirected")
    return near.join(one, [*by, "id"]).join(both, [*by, "id"]).withColumnRenamed("id", "node")


def path_summary(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, direction: str = "symmetric", empty: float | None = 0.0) -> DataFrame:
    """``[measure, value]``: mean inverse distance, as it is and over ln N (``empty`` where no path is), and mean closeness and betweenness."""
    r = roster(edges, nodes)
    mid = lambda scaled: paths.mean_inverse_distance(edges, r, directed, direction=direction, scale_by_log_n=scaled, empty=empty)
    means = path_measures(edges, r, directed, direction).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("closeness_harmonic_sym", "betweenness_directed", "betweenness_undirected")))
    out = mid(True).select(F.lit("mean_inverse_distance_scaled").alias("measure"), F.col("mid").alias("value")).union(mid(False).select(F.lit("mean_inverse_distance"), "mid"))
    return out.union(means.unpivot([], means.columns, "measure", "value"))


def bonacich_table(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = True, beta: float | None = None, normalize: str = "none") -> DataFrame:
    """``[node, bonacich, beta_used]`` of every node."""
    return spectral.bonacich(edges, roster(edges, nodes), directed, beta=beta, normalize=normalize).withColumnRenamed("id", "node")


def weighted_triad_row(edges: DataFrame, nodes: DataFrame | None = None, network: str = "(unnamed)", directed: bool = True, method: str = "auto") -> DataFrame:
    """One row: sizes, the recommended grid, and area and peak threshold of each class over that grid."""
    r = roster(edges, nodes)
    began = time.time()
    plan = triads.recommend_layers(edges, r, directed, method)
    layers = triads.layered_census(edges, r, triads.tau_grid(edges, plan["L"], plan["tau_min"], plan["tau_max"]), directed)
    found = {x["triad"]: x for x in triads.layer_summary(layers).collect()}  # 16 rows
    row = {"network": network, "n_nodes": r.count(), "n_edges": edges.count(), "graph_type": "directed" if directed else "undirected", "T_max": plan["T_max"], "L": plan["L"], "tau_min": plan["tau_min"], "tau_max": plan["tau_max"], "method": plan["method"]}
    row["wall_clock_s"] = round(time.time() - began, 2)
    row |= {f"aumc_{c}": float(found[c]["aumc"]) for c in triads.CLASSES} | {f"peaktau_{c}": float(found[c]["tau_peak"]) for c in triads.CLASSES}
    kinds = {str: "string", int: "long", float: "double"}
    return edges.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in row.items()))


def write_csv(df: DataFrame, path: str) -> str:
    """A CSV folder with a header in each part."""
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_node_tables(edges: DataFrame, nodes: DataFrame | None, out: str, name: str, directed: bool = True, beta: float | None = None) -> dict[str, str]:
    """Path measures, their summary, and Bonacich centralities of one network as CSV folders, by kind."""
    jobs = {"path_measures": path_measures(edges, nodes, directed), "summary": path_summary(edges, nodes, directed), "bonacich": bonacich_table(edges, nodes, directed, beta)}
    return {kind: write_csv(df, f"{out}/{name}_{kind}") for kind, df in jobs.items()}


def point_conditions(pool: DataFrame, rho_targets: list[float], levels: str = "nominal_pi_node", tol: float = 0.03, n_per_cell: int = 500, seed: int = 20260605) -> tuple[DataFrame, DataFrame]:
    """(chosen rows, fill report): for each network, level and target, up to ``n_per_cell`` rows of realized rho within ``tol``, by seeded hashes."""
    from pyspark.sql import Window

    from ..functions.rand import uniform

    targets = pool.sparkSession.createDataFrame([(float(t),) for t in rho_targets], "target_rho double")
    near = pool.filter("not gc_collapse").crossJoin(F.broadcast(targets)).filter(F.abs(F.col("realized_rho") - F.col("target_rho")) <= tol)  # rows times a handful of targets
    w = Window.partitionBy("network_name", levels, "target_rho").orderBy(uniform(seed, "network_name", levels, "target_rho", "replicate_idx", "seed"), "seed")
    chosen = near.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n_per_cell).drop("_k")
    cells = pool.select("network_name", levels).distinct().crossJoin(F.broadcast(targets))
    have = near.groupBy("network_name", levels, "target_rho").agg(F.count("*").alias("n_available"))
    got = chosen.groupBy("network_name", levels, "target_rho").agg(F.count("*").alias("n_selected"), F.avg("realized_rho").alias("achieved_rho"))
    keys = ["network_name", levels, "target_rho"]
    report = cells.join(have, keys, "left").join(got, keys, "left").na.fill(0, ["n_available", "n_selected"])
    return chosen, report.withColumn("status", F.when(F.col("n_selected") == 0, "EMPTY").when(F.col("n_selected") < n_per_cell, "UNDER").otherwise("ok"))


def sign_bins(corpus: DataFrame, edge: float = 0.05) -> DataFrame:
    """Rows classed by what they lost and the sign of their realized correlation."""
    none = (F.col("n_full_removal") + F.col("n_nominations")) == 0
    return corpus.withColumn("sign_bin", F.when(none & (F.col("W_removed") == 0), "baseline").when(none, "no_loss").when(F.col("realized_rho") < -edge, "negative").when(F.col("realized_rho") > edge, "positive").otherwise("core"))


def write_tables(networks: DataFrame, nodes: DataFrame | None, out: str, directed: bool = True) -> None:
    """The binary, weighted and triad tables of all networks as CSV folders."""
    for name, df in (("binary", network_summary(networks, nodes, directed)), ("weighted", network_summary(networks, nodes, directed, True)), ("triads", triad_table(networks, nodes, directed))):
        write_csv(df, f"{out}/{name}")
