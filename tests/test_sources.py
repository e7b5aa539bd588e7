"""Files written by hand or by the writer, and read back."""

import pytest

from graphloom.model import Network
from graphloom.sources import graphml, synthetic, text


def test_graphml_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("1", "2", 1.5, True), ("2", "x&<", None, False)], "src string, dst string, weight double, ok boolean")
    n = spark.createDataFrame([("1", "a\"b", 3), ("2", None, None), ("x&<", "c", 5)], "id string, label string, size int")
    graphml.write_graphml(Network(e, n, {"directed": True, "network_name": "small"}), str(tmp_path / "small.graphml"))
    back = graphml.read_graphml(spark, str(tmp_path / "small.graphml"))
    assert back.meta["directed"] is True and back.meta["network_name"] == "small"
    assert {tuple(r) for r in back.edges.select("src", "dst", "weight", "ok").collect()} == {tuple(r) for r in e.collect()}
    assert {tuple(r) for r in back.nodes.select("id", "label", "size").collect()} == {tuple(r) for r in n.collect()}
    with pytest.raises(ValueError):
        graphml.write_graphml(Network(e.drop("dst"), n), str(tmp_path / "bad.graphml"))


def test_pajek_two_mode(spark, tmp_path):
    p = tmp_path / "firms.net"
    p.write_bytes('*Vertices 4 2\n1 "Acme Caf\xe9"\n2 Bolt\n3 "d1"\n4 "d2"\n% comment\n*Edges\n1 3\n2 3 2\n1 4\n2 4\nbad line\n'.encode("latin-1"))
    net = text.read_pajek(spark, str(p))
    assert net.meta["n_total"] == 4 and net.meta["n_first"] == 2
    assert {r["id"]: r["label"] for r in net.nodes.collect()} == {"1": "Acme Café", "2": "Bolt", "3": "d1", "4": "d2"}
    assert [tuple(r) for r in text.two_mode_projection(net).collect()] == [("1", "2", 3.0)]
    assert text.two_mode_projection(net, 4.0).count() == 0


def test_konect(spark, tmp_path):
    p = tmp_path / "out.x"
    p.write_text("% asym posweighted\n% 3 5 5\n1 2 2\n2 3\n3 1 4\n")
    net = text.read_konect(spark, str(p))
    assert net.meta == {"directed": True, "weighted": True} and net.nodes.count() == 5
    assert {tuple(r) for r in net.edges.collect()} == {("1", "2", 2.0), ("2", "3", 1.0), ("3", "1", 4.0)}


def test_csv_layers_and_ora(spark, tmp_path):
    (tmp_path / "edges_a.csv").write_text("﻿source;target\nx;y\ny;x\nz;z\n", encoding="utf-8")
    (tmp_path / "edges_b.csv").write_text("source;target\nx;y\ny;z\n")
    net = text.read_layers(spark, str(tmp_path), ("a", "b"))
    assert {tuple(r) for r in net.edges.collect()} == {("x", "y", 2.0), ("y", "z", 1.0)}
    (tmp_path / "n.csv").write_text("Node ID,Node Title,Is Leader\nA,Ann,1\n")
    (tmp_path / "e.csv").write_text("Source Node ID,Target Node ID,Link Value\nA,B,2\n")
    ora = text.read_ora(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert ora.edges.columns == ["src", "dst", "weight"] and ora.nodes.columns == ["id", "label", "is_leader"]


def test_synthetic_networks(spark):
    net = synthetic.block_model(spark, 60, 4, 0.5, 0.02)
    assert [r["count"] for r in net.nodes.groupBy("block").count().collect()] == [15] * 4
    assert net.edges.count() == synthetic.block_model(spark, 60, 4, 0.5, 0.02).edges.count()
    pa = synthetic.preferential_attachment(spark, 50, 2, seeds=[1, 2]).edges
    assert {r["count"] for r in pa.groupBy("network").count().collect()} == {3 + 47 * 2}
