"""Incremental loads: new files go through the batch functions, each key once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.materialize import stored
from tidemark.operators.state import insert_ignore
from tidemark.sources.tables import Warehouse


def stream_csv(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of CSV files that appear in a folder."""
    return spark.readStream.schema(schema).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(folder)


def append_new_keys(
    stream: DataFrame, warehouse: Warehouse, name: str, keys: Sequence[str], first: Sequence[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df
) -> StreamingQuery:
    """Run a stream to its end into a table that keeps the first row of each key.

    Only the rows that a batch adds are written. A repeated batch adds nothing, so a restart
    after a failure gives the same table.
    """

    def batch(df: DataFrame, _: int) -> None:
        rows = prepare(df)
        have = warehouse.read(name) if warehouse.exists(name) else rows.sparkSession.createDataFrame([], rows.schema)
        warehouse.append(stored(insert_ignore(have, rows, keys, first)[1], "added-rows"), name)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
