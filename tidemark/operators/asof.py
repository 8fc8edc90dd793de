"""As-of joins without ordering whole entities in one task.

The right rows of an entity, one per day, are turned into half-open spans of days in which
each is the answer; spans are exploded into time buckets and joined by equality of entity
and bucket (``versions.as_known``). A left row without an answer keeps nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.versions import FROM, TO, as_known


def _one_per_day(right: DataFrame, by: str, on: str, payload: Sequence[str]) -> DataFrame:
    day = F.col(on).cast("date")
    best = right.where(F.col(by).isNotNull() & day.isNotNull()).groupBy(by, day.alias("_day")).agg(F.max(F.struct(F.col(on).alias("_on"), *payload)).alias("_v"))
    return best.select(by, "_day", *[F.col("_v")[c].alias(c) for c in payload])


def asof_join(
    left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, payload: Sequence[str], direction: str = "backward", tolerance_days: int | None = None, prefix: str = "", span: tuple | None = None
) -> DataFrame:
    """``left`` with ``payload`` of the nearest right row at or before (``backward``) or at or after (``forward``) its day.

    ``left_on`` and ``right_on`` are dates (or timestamps, taken by their day, the latest of
    a day winning). ``tolerance_days`` bounds the distance, both ends included. ``span``: see ``versions.as_known``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    days = _one_per_day(right, by, right_on, payload)
    w = Window.partitionBy(by).orderBy("_day")
    if direction == "backward":
        start, end = F.col("_day"), F.lead("_day").over(w)
        if tolerance_days is not None:
            end = F.least(end, F.date_add("_day", tolerance_days + 1))
    else:
        start, end = F.date_add(F.lag("_day").over(w), 1), F.date_add("_day", 1)
        reach = F.date_sub("_day", tolerance_days) if tolerance_days is not None else F.lit("0001-01-01").cast("date")
        start = F.greatest(start, reach)
    spans = days.select(by, start.alias(FROM), end.alias(TO), *payload)
    return as_known(left, spans, by, left_on, payload, prefix=prefix, span=span)
