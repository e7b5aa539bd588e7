"""Jobs over whole networks: corpora and their checks, tables as files, labels, node metrics, recommended grids."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import Network
from graphloom.operators import degrade, intervals, triads
from graphloom.plans import summary
from graphloom.sources import graphml, synthetic

TWO = [(f"{b}{i}", f"{b}{j}", 1.0) for b in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0)]


@pytest.fixture(scope="module")
def cliques(spark):
    return spark.createDataFrame(TWO, "src string, dst string, weight double")


@pytest.fixture(scope="module")
def roster(spark):
    return spark.createDataFrame([(f"{b}{i}",) for b in "ab" for i in range(6)] + [("alone",)], "id string")


def test_synthetic_corpus(spark, tmp_path):
    files = synthetic.write_corpus(spark, str(tmp_path))
    assert len(files) == 8
    for name in ("block_model_undirected_weighted", "preferential_attachment_directed_unweighted"):
        net = graphml.read_graphml(spark, files[name])
        net = Network(net.edges.cache(), net.nodes.cache(), net.meta)
        checks = {r["check"]: r["passed"] for r in synthetic.check_network(net, 600 if "block" in name else 250, None, name.split("_")[-2] == "directed", name.endswith("_weighted")).collect()}
        assert all(checks.values()), checks
    hubs = synthetic.degree_distribution(graphml.read_graphml(spark, files["preferential_attachment_undirected_unweighted"]).edges).agg(F.max("degree"), F.sum("n")).first()
    assert hubs[0] >= 15 and hubs[1] == 250


def test_network_checks_find_faults(spark, cliques, roster):
    bad = cliques.union(spark.createDataFrame([("a0", "a0", 1.0), ("a1", "a0", 1.0), ("x", "a1", 0.5)], cliques.schema))
    got = {r["check"] for r in synthetic.check_network(Network(bad, roster, {"directed": False, "weighted": True}), 12, 99, True, True).filter("not passed").collect()}
    assert got == {"ends_known", "no_loops", "no_repeats", "n_nodes", "n_edges", "directed_flag", "weights_least_1"}


def test_node_tables_as_files(spark, tmp_path, cliques, roster):
    files = summary.write_node_tables(cliques, roster, str(tmp_path), "two", directed=False, beta=0.05)
    rows = {r["node"]: r for r in spark.read.csv(files["path_measures"], header=True, inferSchema=True).collect()}
    assert len(rows) == 13 and rows["a0"]["betweenness_undirected"] == 30 and rows["alone"]["closeness_harmonic_sym"] == 0
    assert spark.read.csv(files["summary"], header=True).count() == 5 and spark.read.csv(files["bonacich"], header=True).columns == ["node", "bonacich", "beta_used"]


@pytest.mark.parametrize("method", ["champ", "leiden"])
def test_community_labels(cliques, roster, method):
    label = {r["id"]: r["community"] for r in intervals.community_labels(cliques, roster, directed=False, method=method).collect()}
    assert len(label) == 13 and len({label[f"a{i}"] for i in range(6)}) == 1 and label["a1"] != label["b1"]


def test_node_metrics(cliques):
    arcs = cliques.toPandas()
    ids = sorted({*arcs["src"], *arcs["dst"]})
    assert intervals.node_metric("strength", "a0")(arcs, ids) == 6 and intervals.node_metric("strength", "a1")(arcs, ids) == 5
    both = arcs.rename(columns={"src": "dst", "dst": "src"})[["src", "dst", "weight"]]
    import pandas as pd

    assert intervals.node_metric("betweenness", "a0")(pd.concat([arcs, both]), ids) == 60


def test_only_passing_replicates_count(spark):
    corpus = spark.createDataFrame([(1, 1.0, True), (2, 2.0, True), (3, 99.0, False)], "sample_id long, m double, gate_passed boolean")
    r = intervals.summarize(corpus, ["m"]).first()
    assert r["n_valid"] == 2 and r["mean"] == 1.5


def test_propensity_by_group(spark):
    rows = [(g, str(i), float(i)) for g, n in (("small", 8), ("large", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id string, score double")
    together = {(r["g"], r["id"]): r["propensity"] for r in degrade.propensity(df, 0.4, 0.25, 4, by=["g"]).collect()}
    for g in ("small", "large"):
        alone = degrade.propensity(df.filter(F.col("g") == g).drop("g"), 0.4, 0.25, 4).collect()
        assert all(together[g, r["id"]] == pytest.approx(r["propensity"]) for r in alone)


def test_recommended_layers(spark):
    """A dense weighted graph is decided analytically; a graph without triangles tries grids until areas settle."""
    n = 40
    dense = spark.createDataFrame([(str(i), str(j), float(1 + (i * j * 7) % 100)) for i in range(n) for j in range(n) if i != j], "src string, dst string, weight double").cache()
    plan = triads.recommend_layers(dense, t_analytic=1000)
    assert plan["method"] == "analytic" and 8 <= plan["L"] <= 64 and plan["tau_min"] < plan["tau_max"] and plan["T_max"] > 1000
    assert triads.recommend_layers(dense, t_analytic=10**9, t_empirical=10**9, grid=(4, 6), tol=1.0)["L"] == 6
    path = spark.createDataFrame([(str(i), str(i + 1), float(1 + i % 7)) for i in range(30)], "src string, dst string, weight double")
    short = triads.recommend_layers(path, grid=(4, 6), tol=0.0)
    assert short["method"] == "empirical" and not short["converged"] and short["L"] == 6 and short["T_max"] == 0


def test_weightings():
    assert sum(triads.weighting("RC")) == 8 and sum(triads.weighting("transitivity")) == 10
    with pytest.raises(ValueError):
        triads.weighting([1.0])


def test_tau_statistic_tells_clusters_from_chance(spark, cliques):
    import numpy as np

    both = cliques.filter("src <> 'a0' or dst <> 'b0'").unionByName(cliques.filter("src <> 'a0' or dst <> 'b0'").selectExpr("dst src", "src dst", "weight"))
    clustered = triads.tau_statistic(both, n_samples=40).first()
    assert (clustered["M"], clustered["A"], clustered["N"]) == (30, 0, 36) and clustered["tau"] > 5 and clustered["sd"] > 0
    rng = np.random.default_rng(4)
    arcs = {(int(a), int(b)) for a, b in rng.integers(0, 20, (120, 2)) if a != b}
    chance = triads.tau_statistic(spark.createDataFrame([(str(a), str(b), 1.0) for a, b in arcs], "src string, dst string, weight double"), weights="transitivity", n_samples=60).first()
    assert abs(chance["tau"]) < 4
    none = triads.tau_statistic(cliques.limit(0), spark.createDataFrame([("x",), ("y",), ("z",)], "id string"), n_samples=3).first()
    assert none["M"] == none["A"] == 0 and none["N"] == 3 and none["tau"] == 0


def test_draws_by_gaps():
    import numpy as np

    rng = np.random.default_rng(0)
    for p, lo, hi in ((0.3, 5, 20_005), (0.001, 0, 100_000), (1.0, 3, 50), (0.0, 0, 9), (0.5, 7, 7)):
        got = synthetic.chosen(rng, p, lo, hi)
        n = hi - lo
        assert len(set(got.tolist())) == len(got) and all(lo <= x < hi for x in got) and abs(len(got) - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1e-9
