"""Small graphs with known values."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import priors, scalars
from graphloom.operators import blockmodel, clustering, community, components, degree, intervals, paths, reciprocity, spectral, triads

FOUNDATION = [("1", "2", 1), ("1", "3", 2), ("2", "3", 3), ("3", "2", 3), ("4", "5", 4), ("5", "6", 1), ("6", "4", 2)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w[0]) if w else 1.0) for a, b, *w in rows], "src string, dst string, weight double")


def ids(spark, n):
    return spark.createDataFrame([(str(i),) for i in range(1, n + 1)], "id string")


def col(df, name, key="id"):
    return {r[key]: r[name] for r in df.collect()}


def test_degrees_of_the_foundation_graph(spark):
    e, n = edges(spark, FOUNDATION), ids(spark, 8)
    rows = {r["id"]: r for r in degree.degrees(e, n).collect()}
    get = lambda c: [rows[str(i)][c] for i in range(1, 9)]
    assert get("in_degree") == [0, 2, 2, 1, 1, 1, 0, 0]
    assert get("out_degree") == [2, 1, 1, 1, 1, 1, 0, 0]
    assert get("total_degree") == [2, 3, 3, 2, 2, 2, 0, 0]
    assert get("in_strength") == [0, 4, 5, 2, 4, 1, 0, 0]
    assert get("total_strength") == [3, 7, 8, 6, 5, 3, 0, 0]
    d = degree.total_degree(e, n, weighted=False)
    assert scalars.gini(d, "total_degree").first()["gini"] == pytest.approx(0.321429, abs=1e-6)
    assert scalars.centralization(d, "total_degree").first()["centralization"] == pytest.approx(1.164965, abs=1e-6)
    assert degree.freeman_centralization(e, n).first()["freeman"] == pytest.approx(10 / 42)


def test_paths_of_the_foundation_graph(spark):
    e, n = edges(spark, FOUNDATION), ids(spark, 8)
    c = col(paths.closeness(e, n), "closeness")
    assert [c[str(i)] for i in range(1, 9)] == pytest.approx([2 / 7] * 6 + [0, 0])
    o = col(paths.closeness(e, n, direction="out"), "closeness")
    assert [o[str(i)] for i in range(1, 7)] == pytest.approx([2 / 7, 1 / 7, 1 / 7] + [1.5 / 7] * 3)
    b = col(paths.betweenness(e, n), "betweenness")
    assert [b[str(i)] for i in range(1, 9)] == [0, 0, 0, 1, 1, 1, 0, 0]
    assert paths.mean_inverse_distance(e, n, direction="out").first()["mid"] == pytest.approx(8.5 / 56 / math.log(8))
    assert paths.mean_inverse_distance(e, n).first()["mid"] == pytest.approx(12 / 56 / math.log(8))
    x = col(spectral.bonacich(e, n, direction="symmetric", beta=0.25), "bonacich")
    assert [x[str(i)] for i in range(1, 9)] == pytest.approx([4] * 6 + [0, 0])
    assert components.largest_component(e, n).first()["largest_component"] == 3 / 8


def test_diamond_costs(spark):
    e = edges(spark, [("1", "2", 4), ("1", "3", 1), ("2", "4", 4), ("3", "4", 1)])
    get = lambda how, g=e: [col(paths.betweenness(g, interpretation=how), "betweenness")[k] for k in "1234"]
    assert get("tie_strength") == [0, 1, 0, 0]
    assert get("distance") == [0, 0, 1, 0]
    assert get("distance", model.binarize(e)) == [0, 0.5, 0.5, 0]


def test_series_and_dense_bonacich_agree(spark, monkeypatch):
    e = edges(spark, [("1", "2"), ("1", "3"), ("1", "4")])
    dense = spectral.bonacich(e, direction="symmetric").orderBy("id").collect()
    assert dense[0]["beta_used"] == pytest.approx(0.5 / math.sqrt(3))
    monkeypatch.setattr(spectral, "DENSE_NODES", 0)
    series = spectral.bonacich(e, direction="symmetric", beta=dense[0]["beta_used"]).orderBy("id").collect()
    assert [r["bonacich"] for r in series] == pytest.approx([r["bonacich"] for r in dense])


def test_triangle_with_isolate(spark):
    e, n = edges(spark, [("1", "2"), ("2", "3"), ("3", "1")]), ids(spark, 4)
    assert col(triads.triad_census(e, n), "count", "triad") == {**dict.fromkeys(triads.CLASSES, 0), "030C": 1, "012": 3}
    assert col(triads.triad_census(e, n, directed=False), "count", "triad") == {**dict.fromkeys(triads.CLASSES, 0), "300": 1, "102": 3}
    assert components.largest_component(e, n).first()["largest_component"] == 3 / 4
    assert reciprocity.reciprocity(e).first()["arc"] == 0
    assert triads.dyad_census(e, n).first().asDict() == {"M": 0, "A": 3, "N": 3}


@pytest.mark.parametrize(("rows", "share"), [([(1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 5)], 3 / 5), ([(1, 2), (2, 3), (3, 4), (4, 5)], 2 / 5)])
def test_bicomponents(spark, rows, share):
    e = edges(spark, [(str(a), str(b)) for a, b in rows])
    assert components.largest_bicomponent(e).first()["largest_bicomponent"] == share


def test_local_reciprocity(spark):
    assert col(reciprocity.local_reciprocity(edges(spark, [("1", "2", 3), ("2", "1", 1)])), "reciprocity") == {"1": pytest.approx(1 / 3), "2": 1.0}


def test_two_cliques(spark):
    k10 = lambda at: [(str(at + i), str(at + j)) for i in range(10) for j in range(i)]
    e = edges(spark, [*k10(0), *k10(10), ("0", "10")])
    got = community.leiden(e, directed=False, n_runs=2).collect()
    assert len({r["community"] for r in got}) == 2
    assert got[0]["quality"] == pytest.approx(0.489, abs=1e-3)
    labels = community.leiden(e, directed=False, n_runs=2).select("id", "community")
    assert community.modularity(e, labels).first()["modularity"] == pytest.approx(got[0]["quality"])
    c = community.champ(e, directed=False, n_resolutions=6, n_runs=1)
    assert c["membership"].select("community").distinct().count() == 2


def test_blocks_separate_cliques(spark):
    k4 = lambda at: [(str(at + i), str(at + j)) for i in range(4) for j in range(4) if i != j]
    b = col(blockmodel.blockmodel(edges(spark, [*k4(1), *k4(5)]), ids(spark, 10), n_blocks=2), "block")
    assert len({b[str(i)] for i in range(1, 5)}) == len({b[str(i)] for i in range(5, 9)}) == 1 and b["1"] != b["5"] and b["9"] == b["10"] == 0


def test_distances_become_counts(spark):
    e = edges(spark, [("1", "2", 2), ("1", "3", 8), ("2", "3", 4)])
    get = lambda *a, **k: {(r["src"], r["dst"]): r["weight"] for r in model.distance_to_counts(e, *a, **k).collect()}
    assert get() == {("1", "2"): 4, ("1", "3"): 1, ("2", "3"): 2}
    assert get("max_minus") == {("1", "2"): 6, ("2", "3"): 4}
    assert get("exp_decay", tau=3.0) == {("1", "2"): 19, ("1", "3"): 3, ("2", "3"): 10}
    with pytest.raises(ValueError):
        get("exp_decay")


@pytest.mark.parametrize(("values", "want"), [([1, 1, 1, 1], 0), ([0, 0, 0, 4], 0.75), ([1, 2, 3, 4, 5], 0.26667), ([5], 0)])
def test_gini_literals(spark, values, want):
    assert scalars.gini(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()["gini"] == pytest.approx(want, abs=1e-5)


def test_unknown_nodes_and_constant_clustering(spark):
    e = edges(spark, FOUNDATION)
    with pytest.raises(ValueError):
        model.check_ends(e, ids(spark, 3))
    assert model.is_symmetric(model.symmetrize(e)) and not model.is_symmetric(e)
    assert clustering.global_clustering(edges(spark, [("1", "2"), ("2", "3"), ("3", "1")]), directed=False).first()["clustering"] == 1


def test_tilt_reaches_its_target():
    for rho in (-0.3, 0.1, 0.4):
        beta, status = priors.solve_tilt(rho, 8, 400, 100)
        assert status == "converged" and priors.expected_rho(beta, 8, 400, 100) == pytest.approx(rho, abs=2e-4)
    assert priors.solve_tilt(0.99, 4, 400, 100)[1] == "ceiling_hit"


def test_bootstrap_keeps_its_budget(spark):
    e = edges(spark, FOUNDATION)
    rows = intervals.weight_bootstrap(e, 0.2, b=5).collect()
    assert {r["total_weight"] for r in rows} == {20.0}
    assert intervals.weight_bootstrap(e, 0.0, b=2).first()["total_weight"] == 16.0
    with pytest.raises(ValueError):
        intervals.weight_bootstrap(e, 1.0)


def test_groups_do_not_mix(spark):
    e = edges(spark, FOUNDATION)
    both = e.withColumn("network", F.lit("a")).unionByName(e.filter("src <> '4'").withColumn("network", F.lit("b")))
    got = {r["network"]: r["largest_component"] for r in components.largest_component(both, by=["network"]).collect()}
    assert got == {"a": 0.5, "b": 0.5}
    assert {r["network"]: r["count"] for r in triads.triad_census(both, by=["network"]).filter("triad = '030C'").collect()} == {"a": 1, "b": 0}


def test_champ_without_arcs(spark):
    none = edges(spark, FOUNDATION).filter("src is null")
    c = community.champ(none, directed=False, n_resolutions=2, n_runs=1)
    assert c["membership"].columns == ["id", "community"] and c["membership"].count() == c["communities"] == 0
    c = community.champ(none, ids(spark, 3), directed=False, n_resolutions=2, n_runs=1)
    assert sorted(r["id"] for r in c["membership"].collect()) == ["1", "2", "3"] and c["communities"] == 3
    assert c["membership"].select("community").distinct().count() == 3


def test_decay_of_far_distances(spark):
    far = edges(spark, [("1", "2", 60000), ("1", "3", 60001), ("2", "3", 30000)])
    assert model.distance_to_counts(far, "exp_decay", tau=50.0).count() == 0
    got = {r["dst"] + r["src"]: r["weight"] for r in model.distance_to_counts(far, "exp_decay", tau=50.0, underflow=math.inf).collect()}
    assert math.isnan(got["21"]) and math.isnan(got["31"]) and got["32"] == math.inf
