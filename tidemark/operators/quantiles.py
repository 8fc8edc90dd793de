"""Exact quantiles of groups of any size, and what is made of them: buckets and clipping.

``percentile`` would hold all distinct values of a group in one task. Here a sketch
brackets every wanted rank first; one counting pass then keeps the identity of only those
values that lie inside a bracket (about four thousandths of the rows per quantile at most)
and counts the runs between; running counts give the exact order statistics.
Null and NaN values are left out. Interpolation is linear, as usual for quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BRACKET, ACCURACY = 0.002, 10_000
#: Groups of fewer values keep them all: one rank is more than a bracket there.
SMALL = 2_000


def quantiles(df: DataFrame, by: Sequence[str], value: str | Column, probs: Sequence[float], out: str = "q") -> DataFrame:
    """(by, n, out): the array of quantiles at ``probs`` of each group; without ``by`` one row."""
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    edges = [min(1.0, max(0.0, p + d)) for p in probs for d in (-BRACKET, BRACKET)]
    one = by or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    group = lambda d, *k: d.groupBy(*one, *k)
    sketch = group(rows).agg(F.percentile_approx("_v", edges, ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_m"))
    inside = F.col("_m") < SMALL
    for i in range(len(probs)):
        inside = inside | F.col("_v").between(F.col("_b")[2 * i], F.col("_b")[2 * i + 1])
    below = sum((F.when(F.col("_b")[i] <= F.col("_v"), 1).otherwise(0) for i in range(len(edges))), F.lit(0))
    same = F.lit(True)
    for c in one:
        same = same & F.col(c).eqNullSafe(F.col("__tm_k_" + c))
    keyed = sketch.select(*[F.col(c).alias("__tm_k_" + c) for c in one], "_b", "_m")
    counts = group(rows.join(keyed, same).select(*one, below.alias("_i"), F.when(inside, F.col("_v")).alias("_x")), "_i", "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*one)
    run = counts.withColumn("_cum", F.sum("_c").over(w.orderBy("_i", F.col("_x").asc_nulls_last()))).withColumn("n", F.sum("_c").over(w))
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_x")))
    rank = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    aggs = [a.alias(f"_{k}{i}") for i, r in enumerate(rank) for k, a in (("a", at(F.floor(r))), ("z", at(F.ceil(r))))]
    picked = group(run).agg(F.max("n").alias("n"), *aggs)
    q = F.array(*[F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (r - F.floor(r)) for i, r in enumerate(rank)])
    return picked.select(*by, "n", q.alias(out))


def _attach(df: DataFrame, side: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality of ``by``; the right keys are dropped."""
    if not by:
        return df.join(F.broadcast(side), F.lit(True), "left")  # one row
    renamed = side.select(*[F.col(c).alias("__tm_k_" + c) for c in by], *[c for c in side.columns if c not in by])
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col("__tm_k_" + c))
    return df.join(renamed, cond, "left").drop(*["__tm_k_" + c for c in by])


def bucket(df: DataFrame, by: Sequence[str], value: str, n_buckets: int = 10, out: str = "bucket") -> DataFrame:
    """``df`` with quantile buckets 1..n: right-closed, equal edges merged.

    Null where the value is null, the group has fewer values than buckets, or all are equal.
    """
    edges = quantiles(df, by, value, [i / n_buckets for i in range(n_buckets + 1)], "__tm_e").withColumn("__tm_e", F.array_distinct("__tm_e"))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()])
    joined = _attach(df, edges.withColumnRenamed("n", "__tm_n"), by)
    v = F.col(value).cast("double")
    inner = F.greatest(F.lit(1), F.size(F.filter("__tm_e", lambda e: e < v)))
    ok = v.isNotNull() & ~F.isnan(v) & (F.col("__tm_n") >= n_buckets) & (F.size("__tm_e") >= 2)
    return joined.withColumn(out, F.when(ok, inner)).drop("__tm_e", "__tm_n")


def winsorize(df: DataFrame, by: Sequence[str], value: str, lower: float = 0.01, upper: float = 0.99, out: str = "clipped", least: int = 5) -> DataFrame:
    """``df`` with values clipped to the quantiles of their group; unchanged in null or small groups."""
    bounds = quantiles(df, by, value, [lower, upper], "__tm_b").withColumnRenamed("n", "__tm_n")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower() or c.lower() == value.lower()])
    joined = _attach(df, bounds, by)
    v = F.col(value).cast("double")
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    clip = F.when(v.isNotNull(), F.least(F.greatest(v, F.col("__tm_b")[0]), F.col("__tm_b")[1]))
    return joined.withColumn(out, F.when(known & (F.col("__tm_n") >= least), clip).otherwise(v)).drop("__tm_b", "__tm_n")
