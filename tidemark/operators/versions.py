"""Attributes as known at event time: point-in-time joins over versioned attributes.

A version becomes usable on its effective day (the day it is both valid and known).
From then on it is in force until a version of higher precedence becomes usable. The
history is first reduced to the best version per entity and effective day (combined on
the map side, so a hot entity's window holds at most one row a day), then to the rows
that raise the running maximum of precedence; their effective days are the change times
of half-open validity intervals. Intervals are exploded into time buckets and events
join them by equality of entity and bucket with containment as the residual condition.
A hot entity is spread over its buckets; joins are left to adaptive execution, which
broadcasts the intervals only when their measured size is under the session's bound.

Null entities and null times match nothing; an empty history gives nulls; ties of
precedence are broken by the payload so that repeated rows and any arrival order give
one result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FROM, TO = "__tm_from", "__tm_to"


def validity_intervals(versions: DataFrame, entity: str, effective: Column, precedence: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(entity, FROM, TO, payload): dates, half-open, null end while in force."""
    best = (
        versions.select(F.col(entity), effective.cast("date").alias(FROM), F.struct(*precedence).alias("_p"), F.struct(*payload).alias("_v"))
        .where(F.col(entity).isNotNull() & F.col(FROM).isNotNull())
        .groupBy(entity, FROM)
        .agg(F.max(F.struct("_p", "_v")).alias("_best"))
    )
    by_time = Window.partitionBy(entity).orderBy(FROM)
    before = F.max("_best").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    changes = best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_best._p") > F.col("_before._p")))
    return changes.withColumn(TO, F.lead(FROM).over(by_time)).select(entity, FROM, TO, *[F.col("_best._v")[c].alias(c) for c in payload])


def as_known(events: DataFrame, intervals: DataFrame, entity: str, time: str, payload: Sequence[str], prefix: str = "known_", bucket_days: int = 64, span: tuple | None = None) -> DataFrame:
    """All rows of ``events`` with the payload in force on their day, each column prefixed.

    Buckets of intervals are built only over the span of the events' days, whose two
    ends are the only values fetched to the driver; a caller that knows two days between
    which all events lie gives them as ``span`` and saves that pass. Other event columns that are called
    like a prefixed payload column are replaced.
    """
    added = {(prefix + c).lower() for c in payload}
    if added & {entity.lower(), time.lower()}:
        raise ValueError("a payload column can't be called like the entity or the time")
    events = events.select(*[F.col(f"`{c}`") for c in events.columns if c.lower() not in added])
    day = F.col(time).cast("date")
    first, last = span or events.agg(F.min(day), F.max(day)).first()
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(bucket_days)).cast("int")
    if first is None:
        return events.select("*", *[F.lit(None).cast(intervals.schema[c].dataType).alias(prefix + c) for c in payload])
    lo, hi = F.lit(first), F.lit(last)
    reach = (
        intervals.where((F.col(FROM) <= hi) & (F.col(TO).isNull() | (F.col(TO) > lo)))
        .select(
            F.col(entity).alias("__tm_entity"), FROM, TO, *[F.col(c).alias(prefix + c) for c in payload],
            F.explode(F.sequence(bucket(F.greatest(FROM, lo)), bucket(F.least(F.coalesce(F.date_sub(TO, 1), hi), hi)))).alias("__tm_bucket"),
        )
    )
    left = events.withColumn("__tm_day", day).withColumn("__tm_at", bucket(F.col("__tm_day")))
    within = (F.col("__tm_day") >= F.col(FROM)) & (F.col(TO).isNull() | (F.col("__tm_day") < F.col(TO)))
    joined = left.join(reach, (F.col(entity) == F.col("__tm_entity")) & (F.col("__tm_at") == F.col("__tm_bucket")) & within, "left")
    return joined.drop("__tm_day", "__tm_at", "__tm_entity", "__tm_bucket", FROM, TO)
