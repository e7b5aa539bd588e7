"""Pajek, KONECT and CSV network files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Network, project

#: The layers whose ties make the crime network.
CRIME_LAYERS = ("homicide", "kidnapping", "theft", "drug_trafficking", "arms_trafficking", "weapon_carrying", "ideological_falsehood")


def _lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``[n, line]``: a file's lines in order."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.posexplode(F.split(F.decode("content", encoding), "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))


def _section(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    head = F.when(F.col("line").startswith("*"), F.lower(F.regexp_extract("line", r"^\*(\w+)", 1)))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.orderBy("n"))).filter("line <> '' and not startswith(line, '*') and not startswith(line, '%')")


def read_pajek(spark: SparkSession, path: str) -> Network:
    """Vertices (id, label), arcs and edges of a Pajek file; ``meta`` holds both counts of a two-mode header. Bad lines are left out."""
    lines = _lines(spark, path).cache()
    head = lines.filter(F.lower("line").startswith("*vertices")).first()
    counts = [int(x) for x in head["line"].split()[1:]] if head else []
    rows = _section(lines)
    label = F.regexp_extract("line", r'^\d+\s+"([^"]*)"', 1)
    v = rows.filter("section = 'vertices'").select(F.regexp_extract("line", r"^(\d+)", 1).alias("id"), F.when(label != "", label).otherwise(F.regexp_replace(F.regexp_extract("line", r"^\d+\s+(\S+)", 1), '^"(.*)"$', "$1")).alias("label")).filter("id <> ''")
    parts = F.split("line", r"\s+")
    e = rows.filter("section in ('edges', 'arcs')").select(F.try_element_at(parts, F.lit(1)).try_cast("bigint").alias("src"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("dst"), F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight"))
    e = e.filter("src is not null and dst is not null").select(F.col("src").cast("string"), F.col("dst").cast("string"), "weight")
    return Network(e, v, {"directed": not rows.filter("section = 'arcs'").isEmpty(), "n_total": counts[0] if counts else None, "n_first": counts[1] if len(counts) > 1 else None})


def two_mode_projection(net: Network, min_weight: float = 0.0) -> DataFrame:
    """Pairs of first-mode nodes of a Pajek two-mode network, by shared second-mode nodes."""
    n = net.meta["n_first"]
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    links = net.edges.filter((F.least(a, b) <= n) & (F.greatest(a, b) > n)).select(F.least(a, b).cast("string").alias("left"), F.greatest(a, b).cast("string").alias("right"), "weight")
    return project(links, min_weight=min_weight)


def read_konect(spark: SparkSession, path: str) -> Network:
    """A KONECT edge list; its first line says whether arcs have a direction, its second the sizes, so that silent nodes are there too."""
    lines = _lines(spark, path, "UTF-8").cache()
    head = [r["line"].lstrip("% ").split() for r in lines.filter("startswith(line, '%')").orderBy("n").limit(2).collect()]
    parts = F.split("line", r"\s+")
    e = lines.filter("line <> '' and not startswith(line, '%')").select(parts[0].try_cast("bigint").alias("a"), F.try_element_at(parts, F.lit(2)).try_cast("bigint").alias("b"), F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(1.0)).alias("weight")).filter("a is not null and b is not null")
    top = e.agg(F.greatest(F.max("a"), F.max("b")).alias("n")).first()["n"] or 0
    declared = max((int(x) for x in head[1][1:] if x.isdigit()), default=0) if len(head) > 1 else 0
    nodes = spark.range(1, max(top, declared) + 1).select(F.col("id").cast("string"), F.col("id").cast("string").alias("label"))
    kind = head[0] if head else []
    return Network(e.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), "weight"), nodes, {"directed": "asym" in kind, "weighted": "unweighted" not in kind})


def snake(name: str) -> str:
    import re

    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower())).strip("_")


def read_ora(spark: SparkSession, nodes_path: str, edges_path: str) -> Network:
    """Node and edge CSVs of an ORA export: source, target and link value become src, dst and weight, other names snake case."""
    fixed = {"Source Node ID": "src", "Target Node ID": "dst", "Link Value": "weight"}
    e = spark.read.csv(edges_path, header=True, inferSchema=True)
    e = e.toDF(*[fixed.get(c.strip(), snake(c)) for c in e.columns])
    v = spark.read.csv(nodes_path, header=True, inferSchema=True)
    v = v.toDF(*[{"node_id": "id", "node_title": "label", "name": "id"}.get(snake(c), snake(c)) for c in v.columns])
    if "label" not in v.columns:
        v = v.withColumn("label", F.col("id"))
    first = [c for c in ("id", "label") if c in v.columns]
    return Network(e.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string")).withColumn("weight", F.col("weight").cast("double")), v.select(*first, *[c for c in v.columns if c not in first]), {"directed": True, "weighted": True})


def read_layers(spark: SparkSession, folder: str, layers=CRIME_LAYERS, pattern: str = "edges_{}.csv") -> Network:
    """Semicolon lists, one a layer; a pair's weight is the number of layers that have it. Loops and bad rows are left out."""
    out = None
    for name in layers:
        raw = spark.read.csv(f"{folder}/{pattern.format(name)}", sep=";", header=True, encoding="UTF-8")
        a, b = (F.trim(F.regexp_replace(F.col(f"`{c}`"), "﻿", "")) for c in raw.columns[:2])
        own = raw.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.lit(name).alias("layer")).filter("src <> dst and src <> '' and dst is not null").distinct()
        out = own if out is None else out.unionByName(own)
    e = out.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("label", F.col("id"))
    return Network(e, nodes, {"directed": False, "weighted": True, "layers_included": ",".join(layers)})
