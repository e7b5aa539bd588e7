"""Session helpers of the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import slices


#: Spark's own switch: a query that is planned while it is on removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the cluster's shared checkpoint folder, so that a lost executor costs no recomputation.

    The shuffles that it took go at once: nothing reads them any more, and else they stay until the driver happens to collect
    its garbage, beside those of the next step. The folder is ``spark.checkpoint.dir``; only where that is unset in local mode
    (tests) a temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        planned = df.select("*")  # a query takes the switch as it stands when it is made
    finally:
        spark.conf.set(CLEANUP, was)
    return planned.checkpoint(eager=True)


def by_slice(df: DataFrame, kernel: Callable[[pa.RecordBatch], "pa.RecordBatch | dict | None"], schema: str, column: str = "text") -> DataFrame:
    """``kernel`` over the frame's rows in slices of bounded text bytes; it gives the columns of ``schema`` or None."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for part in slices(batches, column):
            out = kernel(part)
            if out is None:
                continue
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[c] for c in names)], names=names)

    return df.mapInArrow(run, schema)


def slim(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator reads; other columns may have any names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
