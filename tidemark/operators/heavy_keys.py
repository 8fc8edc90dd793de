"""A few keys holding most records: per-key results without imbalance.

Heavy keys are found with a frequent-items sketch in one pass (partial sketches per
task, a few kilobytes each) and their shares are made exact by a broadcast join of the
candidates. The sketch's error is at most ``3.5 / TRACKED`` of the rows, so no key above
twice that can be missed; a share too small for the sketch is refused. At most ``1 / share`` keys can be heavy, which bounds every broadcast.

Per-key results are then formed on two paths: heavy keys by broadcast join with a salt
of the row, aggregated by (key, salt) and then by key; the rest by an ordinary shuffle.
Both are combined on the map side and united at the end. Null keys are never named as
heavy; they form one group of an aggregation, and in a join, where they match nothing, they
are not shuffled at all.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 10_000
SALTS = 64


@dataclass(frozen=True)
class Agg:
    """One decomposable result: ``count``, ``sum``, ``min``, ``max`` or ``last``.

    ``last`` is the value of ``column`` in the row greatest by ``order``; equal rows are
    decided by the value itself, nulls of ``column`` are kept like any value.
    """

    name: str
    kind: str
    column: str | None = None
    order: Sequence[str] = ()

    def partial(self) -> Column:
        c = F.col(self.column) if self.column else None
        if self.kind == "count":
            return F.count(F.lit(1) if c is None else c).alias(self.name)
        if self.kind == "last":
            return F.max(F.struct(*[F.col(o) for o in self.order], c)).alias(self.name)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](c).alias(self.name)

    def combine(self) -> Column:
        return {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "last": F.max}[self.kind](F.col(self.name)).alias(self.name)

    def finish(self) -> Column:
        return F.col(self.name)[self.column].alias(self.name) if self.kind == "last" else F.col(self.name)


def candidates(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that may hold at least ``share`` of the rows, as a local table of at most 2 / share + 1 rows.

    The few values are fetched, because a sketch merged in another order may differ at its
    edge: both paths of an aggregation must split by one and the same list.
    """
    if not 2 * 3.5 / TRACKED <= share <= 1:
        raise ValueError(f"share must be between {7 / TRACKED} and 1")
    k = min(TRACKED, 2 * math.ceil(1 / share))
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {k}, {TRACKED})").alias("_top"))
    rows = top.select(F.explode("_top.item").alias(key)).collect()
    return df.sparkSession.createDataFrame(rows, df.select(key).schema)


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n, total): the keys that hold at least ``share`` of the rows whose key is not null or, if ``df`` has nulls, of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    few = F.broadcast(candidates(df, key, share))  # at most 2 / share rows
    counted = df.select(key).join(few, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = total.first()[0]
    least = math.ceil(Fraction(str(share)) * n)  # exact: a share of 0.05 has no exact double
    return counted.where(F.col("n") >= F.lit(least)).withColumn("total", F.lit(n).cast("long"))


def aggregate(df: DataFrame, key: str, aggs: Sequence[Agg], share: float = 0.01, salts: int = SALTS) -> DataFrame:
    """(key, results, is_heavy): one row per key, heavy keys salted, the others shuffled once."""
    need = list(dict.fromkeys([key, *[c for a in aggs for c in (a.column, *a.order) if c]]))
    rows = df.select(*need)
    few = candidates(df, key, share)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    first, second = [a.partial() for a in aggs], [a.combine() for a in aggs]
    heavy = rows.join(F.broadcast(few), key, "left_semi").withColumn("_salt", salt).groupBy(key, "_salt").agg(*first).groupBy(key).agg(*second)
    light = rows.join(F.broadcast(few), key, "left_anti").groupBy(key).agg(*first)
    united = heavy.withColumn("is_heavy", F.lit(True)).unionByName(light.withColumn("is_heavy", F.lit(False)))
    return united.select(key, *[a.finish() for a in aggs], "is_heavy")


def join(facts: DataFrame, per_key: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """``facts`` left-joined with ``per_key`` (one row per key): heavy keys and null by broadcast, the rest by shuffle.

    At most 2 / share rows are broadcast; no key on the shuffled path holds more than ``share`` of the rows.
    """
    few = candidates(facts, key, share)
    marked = facts.join(F.broadcast(few.withColumn("__tm_hot", F.lit(True))), key, "left")
    hot_side = F.broadcast(per_key.join(F.broadcast(few), key, "left_semi"))  # a row per heavy key
    hot = marked.where(F.col("__tm_hot") | F.col(key).isNull()).drop("__tm_hot").join(hot_side, key, "left")
    rest = marked.where(F.col("__tm_hot").isNull() & F.col(key).isNotNull()).drop("__tm_hot").join(per_key, key, "left")
    return hot.unionByName(rest)
