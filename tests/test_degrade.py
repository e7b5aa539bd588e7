"""Loss and reconstruction: contracts that hold for every draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.fixtures import busy_trade, nations
from graphloom.operators import degrade, reconstruct


@pytest.fixture(scope="module")
def trade(spark, sf_dir):
    return busy_trade(spark, sf_dir).cache(), nations(spark, sf_dir).cache()


def test_corpus_is_reproducible_and_takes_its_budget(trade):
    e, n = trade
    net = lambda df: df.withColumn("network", F.lit("t"))
    make = lambda: degrade.degeneration_corpus(net(e), net(n), {"t": (True, True)}, rhos=(0.25,), pi_nodes=(0.2,), pi_edges=(0.0, 0.25), replicates=3, node_loss="targeted", max_retries=3)
    rows = sorted(make().collect(), key=lambda r: r["seed"])
    assert [r.asDict() for r in rows] == [r.asDict() for r in sorted(make().collect(), key=lambda r: r["seed"])]
    total = e.agg(F.sum("weight")).first()[0]
    for r in rows:
        assert r["W_removed"] == round(r["nominal_pi_edge"] * total)
        assert len(r["missing_nodes"]) == 5 and r["n_full_removal"] + r["n_nominations"] == 5
    nets = degrade.collect_networks(net(e), net(n), {"t": (True, True)})
    left, missing = degrade.recover(nets["t"], rows[0].asDict(), "targeted", max_retries=3)
    assert len(missing) == 5 and not set(missing) & set(left["src"])


def test_nominated_nodes_stay(spark):
    e = spark.createDataFrame([("1", "2", 1.0), ("2", "3", 1.0), ("3", "1", 1.0), ("4", "1", 1.0)], "src string, dst string, weight double")
    n = spark.createDataFrame([(str(i),) for i in range(1, 5)], "id string")
    m = spark.createDataFrame([("2",), ("4",)], "id string")
    left, nodes = degrade.materialize_missing(e, n, m)
    assert {(r["src"], r["dst"]) for r in left.collect()} == {("1", "2"), ("3", "1")}
    assert {r["id"] for r in nodes.collect()} == {"1", "2", "3"}
    left, nodes = degrade.materialize_missing(e, n, m, directed=False)
    assert {(r["src"], r["dst"]) for r in left.collect()} == {("3", "1")}


def test_weight_never_goes_below_zero(spark):
    e = spark.createDataFrame([("1", "2", 3.0), ("1", "2", 1.0), ("2", "1", 2.0)], "src string, dst string, weight double")
    u = spark.createDataFrame([("1", "2", 3), ("2", "1", 5)], "src string, dst string, units int")
    assert {(r["src"], r["weight"]) for r in degrade.apply_weight_removal(e, u).collect()} == {("1", 1.0), ("2", 0.0)}


@pytest.mark.parametrize("allocation", ["observed", "deficit"])
def test_replicates_meet_their_priors(spark, trade, allocation):
    e, n = trade
    s = reconstruct.compute_setup(e, n, None, pi_node=0.2, pi_edge=0.5, rho=0.0, allocation=allocation)
    assert s.add == reconstruct.n_added(0.2, 25) == 6
    c = reconstruct.reconstruction_corpus(spark, s, 4, 0.0)
    for r in c.collect():
        assert len(r["added_node_ids"]) == 6 and r["realized_pi_node"] == pytest.approx(6 / 31)
        assert r["realized_pi_edge"] == pytest.approx(s.floor["realized_pi_edge"], abs=0.03)
    whole = reconstruct.materialize(e, c).groupBy("sample_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    want = {r["sample_id"]: (float(e.agg(F.sum("weight")).first()[0]) + len(r["struct_src"]) + sum(r["wd_add"]), e.count() + len(r["struct_src"])) for r in c.collect()}
    assert {r["sample_id"]: (r["w"], r["n"]) for r in whole.collect()} == want


def test_silent_nodes_get_ties(spark, trade):
    e, n = trade
    s = reconstruct.compute_setup(e.filter("src <> '3'"), n, None, pi_node=0.0, silent=["3"])
    rep = reconstruct.replicate(s, 1)
    at = int(np.flatnonzero(s.ids == "3")[0])
    assert (rep["src"][rep["n_observed_ties"] :] == at).all()
