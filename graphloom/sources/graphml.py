"""GraphML files as edges and nodes, and back. Files are read by Spark, each parsed in one task; attributes get their declared types."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from contextlib import contextmanager
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Network

_TYPES = {"int": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}
_RAW = "path string, kind string, id string, src string, dst string, attrs map<string,string>"


def strip_prefix(name: str) -> str:
    """An id without the leading "n" that writers put before it."""
    return name[1:] if name.startswith("n") else name


def parse(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of ``_RAW``: key declarations, the graph's data, nodes and edges of the file's first graph."""
    keys: dict[str, tuple[str, str]] = {}
    data: dict[str, str] = {}
    graphs, inside = 0, None
    for event, el in ET.iterparse(io.BytesIO(content), ("start", "end")):
        tag = el.tag.rpartition("}")[2]
        if event == "start":
            if tag == "graph":
                graphs += 1
                if graphs > 1:
                    return
                yield path, "graph", None, None, None, {"edgedefault": el.get("edgedefault", "directed")}
            elif tag in ("node", "edge"):
                inside, data = tag, {}
            continue
        if tag == "key":
            keys[el.get("id")] = (el.get("for", "all"), el.get("attr.name", el.get("id")))
            yield path, "key", el.get("for", "all"), el.get("attr.name", el.get("id")), _TYPES.get(el.get("attr.type", "string"), "string"), {}
        elif tag == "data":
            name = keys.get(el.get("key"), ("", el.get("key")))[1]
            if inside:
                data[name] = el.text or ""
            else:
                yield path, "meta", name, None, None, {"value": el.text or ""}
        elif tag == "node":
            yield path, "node", strip_prefix(el.get("id")), None, None, data
            inside = None
        elif tag == "edge":
            yield path, "edge", None, strip_prefix(el.get("source")), strip_prefix(el.get("target")), data
            inside = None
            el.clear()


def read_graphml(spark: SparkSession, path: str) -> Network:
    """One or many files (a folder or a pattern); with several, ``network`` is the file's name without its ending."""

    def run(frames):
        for pdf in frames:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in parse(p, c)]
            yield pd.DataFrame(rows, columns=["path", "kind", "id", "src", "dst", "attrs"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _RAW).cache()
    keys = raw.filter("kind = 'key'").select("id", "src", "dst").distinct().collect()  # declarations
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("network")

    def typed(kind: str, ends: list[str]) -> DataFrame:
        own = sorted({(r["src"], r["dst"]) for r in keys if r["id"] in (kind, "all")})
        cols = []
        for attr, t in own:
            v = F.col("attrs")[attr]
            cols.append((v if t == "string" else F.when(v != "", v.isin("true", "1") if t == "boolean" else v.try_cast(t))).alias(attr))
        return raw.filter(F.col("kind") == kind).select(name, *ends, *[c for c, (a, _) in zip(cols, own) if a not in ends])

    meta = {r["id"]: r["attrs"]["value"] for r in raw.filter("kind = 'meta'").collect()}
    direction = raw.filter("kind = 'graph'").select(F.col("attrs")["edgedefault"].alias("d")).first()
    meta.setdefault("directed", str(direction is None or direction["d"] == "directed").lower())
    return Network(typed("edge", ["src", "dst"]), typed("node", ["id"]), {k: v in ("true", "1") if k in ("directed", "weighted", "is_binary") else v for k, v in meta.items()})


@contextmanager
def _writer(spark: SparkSession, path: str):
    """A text file at a path of the cluster's storage, written through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)

    class Sink:
        held: list[str] = []
        size = 0

        def write(self, text: str) -> None:
            self.held.append(text)
            self.size += len(text)
            if self.size > 1 << 20:
                self.flush()

        def flush(self) -> None:
            out.write(bytearray("".join(self.held).encode()))
            self.held, self.size = [], 0

    sink = Sink()
    sink.held = []
    try:
        yield sink
        sink.flush()
    finally:
        out.close()


def _kind(dtype: str) -> str:
    return {"bigint": "int", "int": "int", "double": "double", "float": "double", "boolean": "boolean"}.get(dtype, "string")


def _shown(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def write_graphml(net: Network, path: str) -> None:
    """One network to one file on any storage that Spark reaches, row by row; nulls are left out. Parquet is the sink for many or large ones."""
    for df, need in ((net.edges, ("src", "dst")), (net.nodes, ("id",))):
        if missing := [c for c in need if c not in df.columns]:
            raise ValueError(f"columns {missing} are missing")
    with _writer(net.edges.sparkSession, path) as f:
        put = f.write
        put('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for k, v in net.meta.items():
            put(f'<key id="g_{k}" for="graph" attr.name={quoteattr(k)} attr.type="{"boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "double" if isinstance(v, float) else "string"}"/>\n')
        extra = {}
        for kind, df, skip in (("node", net.nodes, {"id", "network"}), ("edge", net.edges, {"src", "dst", "network"})):
            extra[kind] = [c for c in df.columns if c not in skip]
            for c, t in df.dtypes:
                if c in extra[kind]:
                    put(f'<key id="{kind[0]}_{c}" for="{kind}" attr.name={quoteattr(c)} attr.type="{_kind(t)}"/>\n')
        put(f'<graph id="G" edgedefault="{"directed" if net.meta.get("directed", True) else "undirected"}">\n')
        for k, v in net.meta.items():
            put(f'<data key="g_{k}">{escape(_shown(v))}</data>\n')
        data = lambda kind, row: "".join(f'<data key="{kind[0]}_{c}">{escape(_shown(row[c]))}</data>' for c in extra[kind] if row[c] is not None)
        for row in net.nodes.toLocalIterator():
            put(f"<node id={quoteattr('n' + str(row['id']))}>{data('node', row)}</node>\n")
        for i, row in enumerate(net.edges.toLocalIterator()):
            put(f'<edge id="e{i}" source={quoteattr("n" + str(row["src"]))} target={quoteattr("n" + str(row["dst"]))}>{data("edge", row)}</edge>\n')
        put("</graph>\n</graphml>\n")
