"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster and is read from the
session. Only where it is unset (local tests) a folder of our own is used, which
is never done with a cluster master.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a temporary one for a local master without any."""
    sc = spark.sparkContext
    where = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    jvm = sc._jsc.sc().getCheckpointDir()
    if where:
        if jvm.isEmpty():
            sc.setCheckpointDir(where)
        return where
    if not jvm.isEmpty():
        return jvm.get()
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in reliable storage, its partitions as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed columnar table in the shared folder, read again.

    The table stays until the application ends: results are lazy and may read it any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
