"""Matching records by nearest time, for entities of any size.

Both tables are united as (entity, time, side, tie) and range-partitioned over the whole
of that key, so that one entity or one day may spread over many tasks; rows that repeat in
all of it are reduced to one before. The number of partitions follows from the number of
rows, so that each holds about ``PARTITION_ROWS`` and its scan fits in a task's memory.
The partitions are written once (their bounds come from a sample and must not change
between readings). Each partition yields its first and last right record; a two-level
prefix scan over these edges, in blocks of about the square root of their number, carries
to each partition the last right record before it and the first one after it. A scan of
each partition alone then finds the nearest right time of every left record.

Ties in distance go to the earlier time. Records with a null entity or time match
nothing and are left out, as are left records without a partner within the tolerance.
Left records that are equal in all columns come out once. Equal right times count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.materialize import checkpoint
from tidemark.session import ship

PARTITION_ROWS = 1_000_000


def _carry(edges: DataFrame, partitions: int) -> DataFrame:
    """(pid, prev, next): the nearest right edges outside of each partition.

    ``edges`` has one row per partition: pid, lo, hi (structs of entity and day, or null).
    """
    width = max(1, math.isqrt(partitions))
    e = edges.withColumn("block", F.floor(F.col("pid") / width).cast("int"))
    inner = Window.partitionBy("block").orderBy("pid")
    ahead, behind = (1, Window.unboundedFollowing), (Window.unboundedPreceding, -1)
    local = e.select(
        "pid", "block", F.last("hi", ignorenulls=True).over(inner.rowsBetween(*behind)).alias("prev"), F.first("lo", ignorenulls=True).over(inner.rowsBetween(*ahead)).alias("next")
    )
    total = e.groupBy("block").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    outer = Window.orderBy("block")  # about the square root of the number of partitions
    between = total.select(
        "block", F.last("hi", ignorenulls=True).over(outer.rowsBetween(*behind)).alias("_prev"), F.first("lo", ignorenulls=True).over(outer.rowsBetween(*ahead)).alias("_next")
    )
    return local.join(F.broadcast(between), "block").select("pid", F.coalesce("prev", "_prev").alias("prev"), F.coalesce("next", "_next").alias("next"))


def _scan(tolerance: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        entity, day = t.column("entity"), t.column("day").to_numpy()
        right = t.column("side").to_numpy() == 0
        # entities as numbers in order of appearance; the partition is sorted by entity
        codes = entity.combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        number, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
        known = {n: i for i, n in enumerate(names.to_pylist())}
        span = np.int64(1) << 33
        r_key = number[right] * span + day[right]
        first = t.slice(0, 1)
        for side, at_end in (("prev", False), ("next", True)):
            edge = first.column(side)[0].as_py()
            if edge is not None and edge["entity"] in known:
                k = np.array([known[edge["entity"]] * span + edge["day"]], dtype=np.int64)
                r_key = np.concatenate((r_key, k) if at_end else (k, r_key))
        left = ~right
        l_key = number[left] * span + day[left]
        none = np.iinfo(np.int64).max
        if len(r_key):
            i = np.searchsorted(r_key, l_key, side="right")
            back, ahead = r_key[np.maximum(i - 1, 0)], r_key[np.minimum(i, len(r_key) - 1)]
            d_back = np.where((i > 0) & (l_key - back <= tolerance), l_key - back, none)
            d_ahead = np.where((i < len(r_key)) & (ahead - l_key <= tolerance), ahead - l_key, none)
            found = np.where(d_back <= d_ahead, back, ahead)
            hit = np.minimum(d_back, d_ahead) != none
        else:
            found, hit = l_key, np.zeros(len(l_key), dtype=bool)
        rows = t.filter(pa.array(left)).filter(pa.array(hit))
        near = pa.array((found % span)[hit], pa.int64())
        out = pa.table({"entity": rows.column("entity"), "day": rows.column("day"), "tie": rows.column("tie"), "near": near})
        yield from out.to_batches()

    return scan


def nearest(left: DataFrame, right: DataFrame, entity: str, left_day: str, right_day: str, key: str, tolerance_days: int, partitions: int | None = None) -> DataFrame:
    """(key, entity, left_day, right_day): the nearest right day within the tolerance.

    ``entity`` is a column of both tables, ``key`` a column of ``left`` (compared as a
    string); days are dates. ``partitions`` is at least the session's number of shuffle partitions.
    """
    spark = left.sparkSession
    ship(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((left.count() + right.count()) / PARTITION_ROWS))
    use = lambda df, day, side, tie: df.select(
        F.col(entity).cast("string").alias("entity"), F.unix_date(F.col(day).cast("date")).cast("long").alias("day"), F.lit(side).alias("side"), tie.alias("tie")
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull()).distinct()
    rows = use(left, left_day, 1, F.col(key).cast("string")).unionByName(use(right, right_day, 0, F.lit(None).cast("string")))
    order = ["entity", "day", "side", "tie"]
    ranged = checkpoint(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    edge = F.struct("entity", "day")
    is_right = F.col("side") == 0
    edges = ranged.groupBy("pid").agg(F.min(F.when(is_right, edge)).alias("lo"), F.max(F.when(is_right, edge)).alias("hi"))
    carried = ranged.join(F.broadcast(_carry(edges, n)), "pid")  # one row per partition
    found = carried.mapInArrow(_scan(tolerance_days), "entity string, day long, tie string, near long")
    return found.select(
        F.col("tie").alias(key), F.col("entity").alias(entity), F.date_from_unix_date(F.col("day").cast("int")).alias(left_day), F.date_from_unix_date(F.col("near").cast("int")).alias(right_day)
    )
