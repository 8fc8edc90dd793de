"""Session factory and access to test tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the library expects of any session.

    On a cluster the caller brings a session of its own; the library only needs
    ``spark.sql.session.timeZone=UTC`` and adaptive execution (on by default).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a directory) below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession | None = None) -> None:
    """Give this package to the Python workers of the session (or of the active one), once per context.

    Spark copies the archive to every executor, so nothing has to be installed there.
    Every function that builds a Python operator calls this.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tidemark-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "tidemark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True
