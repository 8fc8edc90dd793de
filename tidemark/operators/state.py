"""Keyed tables kept up by batches: upsert, insert-ignore, delete, coverage, backoff.

Each function returns the new state of a table; the caller stores it (``sources.tables``
swaps it in). One shuffle by key each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import latest


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], newest: Sequence[str] = ()) -> DataFrame:
    """``table`` with the rows of ``batch``; only columns that the batch has are replaced.

    Several batch rows of a key are reduced to the greatest by ``newest``, then by the other columns. A null key matches a null key.
    """
    unknown = [c for c in batch.columns if c not in table.columns]
    if unknown:
        raise ValueError(f"the table has no columns {unknown}")
    order = [*newest, *(c for c in batch.columns if c not in keys and c not in newest)]
    fresh = latest(batch, keys, order).select(*[F.col(c).alias("_n_" + c) for c in batch.columns], F.lit(True).alias("_new"))
    old = table.withColumn("_old", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_n_" + k))
    joined = old.join(fresh, cond, "full_outer")
    out = [F.when(F.col("_new"), F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in batch.columns else F.col(c) for c in table.columns]
    return joined.select(*out)


def insert_ignore(table: DataFrame, batch: DataFrame, keys: Sequence[str], first: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new state, rows really added): the first row of a key by ``first`` stays; existing keys are not touched."""
    rest = [c for c in batch.columns if c not in keys and c not in first]
    once = batch.groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("_v")).select(*[F.col(c) if c in keys else F.col("_v")[c].alias(c) for c in batch.columns])
    added = once.join(table.select(*keys), list(keys), "left_anti").select(*batch.columns)
    return table.unionByName(added), added


def delete_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one row of counts n_before, n_deleted, n_after); a null condition deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    counts = table.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(gone).alias("n_deleted"), F.count_if(~gone).alias("n_after"))
    return table.where(~gone), counts


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that are wanted, not null and not done."""
    some = wanted.select(*keys).dropna().distinct()
    return some.join(done.select(*keys), list(keys), "left_anti")


def settle(wanted: DataFrame, cache: DataFrame, answers: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """New cache rows for the wanted keys that ``cache`` doesn't know: the answer, or a row that says ``not_found``.

    Keys in the cache are never asked again, whatever their status. A key with several answers gets one of them.
    """
    need = pending(wanted, cache, keys)
    known = latest(answers, keys, [c for c in answers.columns if c not in keys])
    out = need.join(known.withColumn("_hit", F.lit(True)), list(keys), "left")
    return out.withColumn(status, F.when(F.col("_hit"), "success").otherwise("not_found")).drop("_hit")


def in_backoff(failures: DataFrame, now: Column, seconds: Sequence[int], attempts: str = "attempts", last: str = "last_attempt_at") -> DataFrame:
    """Failures that must still wait: the n-th attempt waits the n-th of ``seconds``, later ones the last."""
    steps = F.array(*[F.lit(int(s)) for s in seconds])
    wait = F.element_at(steps, F.greatest(F.lit(1), F.least(F.col(attempts), F.lit(len(seconds)))).cast("int"))
    return failures.where(F.timestamp_add("SECOND", wait, F.col(last)) > now)


def fetch_plan(wanted: DataFrame, have: DataFrame, key: str, day: str) -> DataFrame:
    """(key, start, end) of ranges in ``wanted`` (key, start, end) that the days in ``have`` don't span."""
    held = have.groupBy(key).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    need = wanted.join(held, key, "left")
    return need.where(F.col("_lo").isNull() | (F.col("_lo") > F.col("start")) | (F.col("_hi") < F.col("end"))).select(key, "start", "end")
