"""Distribution statistics, ranks, partition agreement and rank correlation, each as one or two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = Sequence[str]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def gini(df: DataFrame, value: str, by: By = ()) -> DataFrame:
    """``[*by, gini]`` of non-negative values; 0 where there is one value or none, or they sum up to 0.

    Equal values are counted first, so the ordered pass runs over distinct values and not over rows.
    """
    if not df.filter(F.col(value) < 0).isEmpty():
        raise ValueError("the Gini coefficient needs non-negative values")
    counts = df.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("c"))
    order = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    # the ranks of a value are k+1 .. k+c where k values are smaller: their sum is c*k + c(c+1)/2
    ranked = counts.withColumn("k", F.coalesce(F.sum("c").over(order), F.lit(0.0))).withColumn("r", F.col("c") * F.col("k") + F.col("c") * (F.col("c") + 1) / 2)
    a = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.col("v") * F.col("r")).alias("vr"))
    g = (2 * F.col("vr") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))
    return a.select(*by, F.when((F.col("n") <= 1) | (F.col("s") == 0), 0.0).otherwise(g).alias("gini"))


def centralization(df: DataFrame, value: str, by: By = ()) -> DataFrame:
    """``[*by, centralization]``: sample standard deviation; 0 for one value or none."""
    return df.groupBy(*by).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("centralization"))


def rand_index(df: DataFrame, a: str, b: str, by: By = ()) -> DataFrame:
    """Share of pairs on which two partitions agree, from their contingency table; 1 for fewer than two nodes."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("c"))
    both = cells.groupBy(*by).agg(pairs(F.col("c")).alias("both"), F.sum("c").alias("n"))
    in_a = cells.groupBy(*by, a).agg(F.sum("c").alias("c")).groupBy(*by).agg(pairs(F.col("c")).alias("in_a"))
    in_b = cells.groupBy(*by, b).agg(F.sum("c").alias("c")).groupBy(*by).agg(pairs(F.col("c")).alias("in_b"))
    j = both.join(in_a, list(by)).join(in_b, list(by)) if by else both.crossJoin(in_a).crossJoin(in_b)  # one row each
    all_ = F.col("n") * (F.col("n") - 1) / 2
    return j.select(*by, F.when(all_ == 0, 1.0).otherwise((all_ + 2 * F.col("both") - F.col("in_a") - F.col("in_b")) / all_).alias("rand_index"))


def ranked(df: DataFrame, value: str, by: By = ()) -> DataFrame:
    """The rows with ``_below`` (rows of a smaller value), ``_same`` (rows of the same value, itself included) and ``_n`` (all rows).

    Rows are counted by value first: the ordered pass runs over distinct values, and no task sees all rows.
    """
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_same"))
    w = Window.partitionBy(*by)
    below = F.sum("_same").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_below", F.coalesce(below, F.lit(0))).withColumn("_n", F.sum("_same").over(w))
    counts = counts.select(*[F.col(b).alias(f"_by_{b}") for b in by], "_v", "_same", "_below", "_n")
    on = F.col(value).eqNullSafe(F.col("_v"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return df.join(counts, on).drop("_v", *[f"_by_{b}" for b in by])


def _finished(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value).drop("_below", "_same", "_n")


def with_tied_rank(df: DataFrame, value: str, name: str, by: By = ()) -> DataFrame:
    """Average rank of ties, from 1, as column ``name``."""
    return _finished(ranked(df, value, by), name, F.col("_below") + (F.col("_same") + 1) / 2)


def with_position_bin(df: DataFrame, value: str, k: int, name: str = "bin", by: By = (), tie: str = "id") -> DataFrame:
    """Bin ceil(position * k / n) of rows ordered by value and then ``tie``; only rows of one value are ordered together."""
    within = F.row_number().over(Window.partitionBy(*by, value).orderBy(tie))
    return _finished(ranked(df, value, by), name, F.ceil((F.col("_below") + within) * k / F.col("_n")).cast("int"))


def with_rank_bin(df: DataFrame, value: str, k: int, name: str = "bin", by: By = ()) -> DataFrame:
    """Bin ceil(average rank / n * k), at least 1."""
    return _finished(ranked(df, value, by), name, F.greatest(F.lit(1), F.ceil((F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_n") * k)).cast("int"))


def tau_b(df: DataFrame, score: str, missing: str, by: By = ()) -> DataFrame:
    """Kendall's tau-b between a score and a yes/no column, from counts by score: one aggregate and one running sum."""
    c = df.groupBy(*by, F.col(score).alias("y")).agg(F.count_if(F.col(missing)).cast("double").alias("m"), F.count_if(~F.col(missing)).cast("double").alias("o"))
    below = Window.partitionBy(*by).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    c = c.withColumn("lo", F.coalesce(F.sum("o").over(below), F.lit(0.0))).withColumn("all_o", F.sum("o").over(whole))
    pairs = lambda n: n * (n - 1) / 2
    a = c.groupBy(*by).agg(F.sum(F.col("m") * (F.col("lo") - (F.col("all_o") - F.col("lo") - F.col("o")))).alias("cd"), F.sum("m").alias("M"), F.sum("o").alias("O"), F.sum(pairs(F.col("m") + F.col("o"))).alias("n2"))
    n0 = pairs(F.col("M") + F.col("O"))
    d = (n0 - pairs(F.col("M")) - pairs(F.col("O"))) * (n0 - F.col("n2"))
    return a.select(*by, F.when(d > 0, F.col("cd") / F.sqrt(d)).otherwise(0.0).alias("tau_b"))


def credible_interval(df: DataFrame, value: str, prob: float = 0.89, by: By = ()) -> DataFrame:
    """Equal-tailed interval of the finite values, with median, mean, deviation and their number."""
    if not 0 < prob < 1:
        raise ValueError("prob must lie between 0 and 1")
    v = df.filter(finite(F.col(value)))
    q = F.percentile(value, F.array(F.lit((1 - prob) / 2), F.lit(0.5), F.lit((1 + prob) / 2)))
    a = v.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n_valid"))
    return a.select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"), "mean", "sd", F.lit(prob).alias("prob"), "n_valid")


def weight_summary(edges: DataFrame, by: By = ()) -> DataFrame:
    """Least, largest and median weight, interquartile range and Gini coefficient."""
    q = F.percentile("weight", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = edges.groupBy(*by).agg(F.min("weight").alias("min"), F.max("weight").alias("max"), q.alias("q"))
    a = a.select(*by, "min", "max", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    g = gini(edges, "weight", by)
    return a.join(g, list(by)) if by else a.crossJoin(g)  # one row each
