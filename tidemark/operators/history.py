"""The value before each row in the history of its key, for keys of any size.

An ordinary window orders the whole history of a key in one task. Here every history is cut
into time buckets that are ordered apart, and the first row of a bucket takes the last value
of the nearest bucket before it, from a table of one row per key and bucket. All keys take
this path, the null key as well, so there is no share below which a key is ordered whole;
with buckets of a day that table has at most one row per key and day, in one task per key.
The window, the table and the join back all go by (key, bucket), one shuffle of the rows.

Null days come last, as one bucket. Rows that tie in day and ``tie`` follow each other in
any order. A null key has a history of its own like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_DAYS = 1


def value_before(df: DataFrame, key: str, day: str, tie: str, value: str, out: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before by (day, tie) among the rows of its key."""
    order = [F.col(day).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    cols = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    rows = df.select(*cols).withColumn("__tm_b", F.floor(F.unix_date(day) / F.lit(bucket_days)).cast("int"))
    by_bucket = Window.partitionBy(key, "__tm_b").orderBy(*order)
    inner = rows.withColumns({"__tm_in": F.lag(value).over(by_bucket), "__tm_n": F.row_number().over(by_bucket)})
    # the row that a later bucket looks back to: null days and null ties come last
    last = rows.groupBy(key, "__tm_b").agg(F.max(F.struct(F.col(day), F.col(tie).isNull(), F.col(tie), F.col(value).alias("v"))).alias("__tm_last"))
    edge = F.lag(F.col("__tm_last.v")).over(Window.partitionBy(key).orderBy(F.col("__tm_b").asc_nulls_last()))
    edges = last.select(F.col(key).alias("__tm_key"), F.col("__tm_b").alias("__tm_eb"), edge.alias("__tm_edge"))
    joined = inner.join(edges, F.col(key).eqNullSafe(F.col("__tm_key")) & F.col("__tm_b").eqNullSafe(F.col("__tm_eb")), "left")
    found = F.when(F.col("__tm_n") == 1, F.col("__tm_edge")).otherwise(F.col("__tm_in"))
    return joined.withColumn(out, found).select(*cols, out)
