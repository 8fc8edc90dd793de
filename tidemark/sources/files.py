"""Delimited and columnar files in and out."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bad_rows import split_records


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def header_of(spark: SparkSession, path: str) -> str:
    """First line of a file, read by the driver alone; compressed files as Spark would read them."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():  # what Spark writes: parts with a header each
        parts = sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName()[0] not in "._" and x.getLen())
        return header_of(spark, parts[0]) if parts else ""
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    raw = fs.open(p)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
    try:
        return (lines.readLine() or "").removeprefix("\ufeff")
    finally:
        lines.close()


def _names(header: str) -> list[str]:
    return next(csv.reader([header]), [])


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, pinned: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """One CSV file or several, with a header, aligned by column name.

    ``schema`` fixes all columns (nothing is inferred, only those are read). ``pinned``
    fixes the types of some and keeps the rest as text, so codes keep their zeros. Cells that
    don't fit their type come out null (``scan_checked`` keeps such records apart instead); a
    column that a file lacks is null there. Files of equal header are one scan. With
    ``multi_line`` a quoted field may hold line breaks and a file is one task; files without
    any are split into many tasks if it is off.
    """
    some = [paths] if isinstance(paths, str) else list(paths)
    if not some:
        raise FileNotFoundError("no input files")
    types = {f.name: f.dataType for f in (schema or pinned or T.StructType())}
    alike: dict[str, list[str]] = {}
    for path in some:
        alike.setdefault(header_of(spark, path), []).append(path)

    def one(header: str, files: list[str]) -> DataFrame:
        names = _names(header)
        text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(files)
        cols = [c for c in names if schema is None or c in types]
        read = text.select(*[F.trim(F.col(f"`{c}`")).try_cast(types[c]).alias(c) if c in types and not isinstance(types[c], T.StringType) else F.col(f"`{c}`") for c in cols])
        if schema is not None:
            read = read.select(*[F.col(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        return read

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (one(h, f) for h, f in alike.items()))


def scan_checked(spark: SparkSession, paths: Sequence[str], schema: T.StructType, checks: Mapping[str, Callable[[Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected records with their reason) of files of one header, a record a line: see ``operators.bad_rows``.

    Both have the file's name; columns of the files that ``schema`` doesn't name are dropped. Other headers are an error.
    """
    headers = {header_of(spark, p) for p in paths}
    if len(headers) != 1:
        raise ValueError("files of one header are needed")
    header = headers.pop()
    kinds = {f.name: f.dataType for f in schema}
    full = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in _names(header)])
    lines = spark.read.text(list(paths)).where(F.col("value") != header).select(F.col("value").alias("raw_record"), F.input_file_name().alias("file"))
    good, bad = split_records(lines, "raw_record", full, checks)
    return good.select("file", *[c for c in schema.names if c in full.names]), bad


def scan_glob(spark: SparkSession, pattern: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """All files of a pattern in their order, on any file system of Spark's; an error if there is none."""
    fs, p = _fs(spark, pattern)
    found = sorted(x.getPath().toString() for x in (fs.globStatus(p) or []))
    if not found:
        raise FileNotFoundError(pattern)
    return scan_csv(spark, found, schema, multi_line=multi_line)


def query_file(spark: SparkSession, path: str, sql: str, name: str = "file") -> DataFrame:
    """SQL over one file that stands as ``{name}`` in the statement; its kind follows from its ending."""
    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    df = scan_csv(spark, path) if kind in ("csv", "tsv", "txt") else spark.read.format(kind).load(path)
    df.createOrReplaceTempView(name)
    return spark.sql(sql)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header. ``single`` writes one file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def label_of(paths: Sequence[str], fallback: str = "all_sources") -> str:
    """Name for the output of several inputs: what their names begin with in common.

    A common beginning that stops inside a fiscal year gives all their years.
    """
    names = [os.path.splitext(os.path.basename(p))[0] for p in paths]
    common = os.path.commonprefix(names).rstrip("_-.") if names else ""
    if re.fullmatch(r"FY\d{0,3}", common):
        common = "_".join(sorted({n[:6] for n in names if re.match(r"FY\d{4}", n)})) or common
    return common or fallback


def service_codes(spark: SparkSession, df: DataFrame, code: str, end: str, today: str, cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """First row per code that has not ended before ``today``, by ``order`` or else in file order, sorted by code.

    End dates may be written MM/DD/YYYY, MM/DD/YY (from 50 on the 1900s) or YYYY-MM-DD; others count as open.
    """
    c = F.trim(F.col(end))
    short = F.regexp_extract(c, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    century = F.when(short.cast("int") >= 50, "19").otherwise("20")
    long = F.when(short != "", F.concat(F.regexp_extract(c, r"^(\d{1,2}/\d{1,2}/)", 1), century, short)).otherwise(c)
    day = F.coalesce(F.try_to_date(long, "M/d/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))
    live = df.withColumn("_at", F.struct(*order) if order else F.monotonically_increasing_id()).where((F.trim(F.col(code)) != "") & (day.isNull() | (day >= F.lit(today).cast("date"))))
    first = live.groupBy(F.trim(F.col(code)).alias(code)).agg(F.min_by(F.struct(*cols), "_at").alias("_v"))
    return first.select(code, *[F.col("_v")[x].alias(x) for x in cols]).orderBy(code)
