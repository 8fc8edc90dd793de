"""Average ranks, percentile ranks, composites and rank correlations of groups of any size.

A rank needs an order of its whole group. The group is cut into value bands by a sketch;
equal values share a band. Values are counted (combined on the map side), ranked within
their band only, and the counts of lower bands are added, so no task orders a whole group
and a value that many rows share is one row of the count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import ship

BANDS = 64


def value_ranks(df: DataFrame, by: Sequence[str], value: str, bands: int = BANDS) -> DataFrame:
    """(by, value, rank, n): the average rank from 1 of each distinct value, nulls and NaN left out.

    Null group keys form a group.
    """
    one = [*by] or ["_all"]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*one, value).agg(F.count(F.lit(1)).alias("_c"))
    edges = rows.groupBy(*one).agg(F.percentile_approx(F.col(value).cast("double"), [i / bands for i in range(1, bands)], 1000).alias("_e"), F.count(F.lit(1)).alias("n"))
    keyed = edges.select(*[F.col(c).alias("_k_" + c) for c in one], "_e", "n")
    same = F.lit(True)
    for c in one:
        same = same & F.col(c).eqNullSafe(F.col("_k_" + c))
    banded = counts.join(keyed, same).withColumn("_band", F.size(F.filter("_e", lambda e: e < F.col(value).cast("double")))).drop("_e", *["_k_" + c for c in one])
    totals = banded.groupBy(*one, "_band").agg(F.sum("_c").alias("_t"))
    lower = F.sum("_t").over(Window.partitionBy(*one).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(c).alias("_k_" + c) for c in one], F.col("_band").alias("_k_band"), F.coalesce(lower, F.lit(0)).alias("_low"))
    within = F.sum("_c").over(Window.partitionBy(*one, "_band").orderBy(value))
    ranked = banded.withColumn("_cum", within).join(totals, same & (F.col("_band") == F.col("_k_band")))
    rank = F.col("_low") + F.col("_cum") - (F.col("_c") - 1) / 2.0
    return ranked.select(*by, value, rank.alias("rank"), "n")


def with_rank(df: DataFrame, by: Sequence[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """``df`` with the average rank of ``value`` in its group; null for null."""
    return _attach(df, value_ranks(df, by, value), by, value, out, count)


def _attach(df: DataFrame, r: DataFrame, by: Sequence[str], value: str, out: str, count: str | None = None) -> DataFrame:
    keys = [*by, value]
    side = r.select(*[F.col(c).alias("__tm_r_" + c) for c in keys], F.col("rank").alias(out), *([F.col("n").alias(count)] if count else []))
    cond = F.col(value) == F.col("__tm_r_" + value)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col("__tm_r_" + c))
    return df.join(side, cond, "left").drop(*["__tm_r_" + c for c in keys])


def percentile_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), flip: bool = False) -> DataFrame:
    """Average rank over one more than the number of values, in (0, 1); 1 less that if flipped."""
    ranked = with_rank(df, by, value, "__tm_rank", "__tm_count")
    p = F.col("__tm_rank") / (F.col("__tm_count") + 1)
    return ranked.withColumn(out, 1 - p if flip else p).drop("__tm_rank", "__tm_count")


@dataclass(frozen=True)
class SignalSpec:
    """One part of a composite: a column, whether high values are good (``asc``) or bad (``desc``), and a positive weight."""

    column: str
    direction: str = "asc"
    weight: float = 1.0

    def __post_init__(self) -> None:
        if self.direction not in ("asc", "desc"):
            raise ValueError("direction is asc or desc")
        if not self.weight > 0:
            raise ValueError("a weight must be positive")


def blend(df: DataFrame, specs: Sequence[SignalSpec], out: str, by: Sequence[str] = (), partial: bool = False) -> DataFrame:
    """``df`` with the weighted mean of the percentile ranks of several columns within ``by``."""
    for i, s in enumerate(specs):
        df = percentile_rank(df, s.column, f"__tm_p{i}", by, s.direction == "desc")
    score = composite([(F.col(f"__tm_p{i}"), s.weight) for i, s in enumerate(specs)], partial)
    return df.withColumn(out, score).drop(*[f"__tm_p{i}" for i in range(len(specs))])


def composite(parts: Sequence[tuple[Column, float]], partial: bool = False) -> Column:
    """Weighted mean of parts; null if any is null, or over those present if ``partial``."""
    if not parts or any(w <= 0 for _, w in parts):
        raise ValueError("a composite needs parts of positive weight")
    total = sum(w for _, w in parts)
    if not partial:
        return sum((c * w for c, w in parts), F.lit(0.0)) / F.lit(total)
    have = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    got = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return got / F.when(have > 0, have)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, n, ic): rank correlation of the rows with both values; null under ``least`` rows or without variation."""
    pairs = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = pairs.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    # both rank tables come from the pairs alone, not one from the other's join
    ranked = _attach(_attach(pairs, value_ranks(pairs, by, "_x"), by, "_x", "_rx"), value_ranks(pairs, by, "_y"), by, "_y", "_ry")
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    ic = F.covar_pop("_rx", "_ry") / F.when(spread > 0, spread)
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n"), ic.alias("ic")).withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def p_value(ic: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t approximation, for small result tables.

    The regularised incomplete beta function of half the degrees of freedom, by its
    continued fraction.
    """
    ship()

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        f = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or tiny)
                c = 1 + num / c or tiny
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f / a

    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else beta((b - 2) / 2, 0.5, 1 - min(1.0, a * a)) for a, b in zip(r, k, strict=True)], dtype="float64")

    return p(ic, n)
