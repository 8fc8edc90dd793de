"""Queries that go through sources and sinks and back, with the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exprs as x
from tidemark.materialize import shared_dir
from tidemark.operators import bad_rows
from tidemark.session import table
from tidemark.sources import files, html_pages, tables
from tidemark.sources.providers import TableReturns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    """A folder of one run below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


_BAR = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), T.StructField("close_adj", T.DoubleType()), T.StructField("source", T.StringType())])


@query("SELECT ticker, date, close_adj, source FROM cache_returns")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV, found by a pattern, read under a schema."""
    path = _place(spark, "csv")
    files.write_csv(table(spark, d, "cache_returns").select(*_BAR.names), path)
    return files.scan_glob(spark, f"{path}/part-*.csv", _BAR, multi_line=False)


@query("SELECT ticker, date, close_adj, source, NULL AS is_benchmark FROM cache_returns WHERE NOT is_benchmark UNION ALL SELECT ticker, date, NULL, NULL, 'yes' FROM cache_returns WHERE is_benchmark")
def csv_union_of_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files of two headers, aligned by name; what a file lacks is null."""
    bars, path = table(spark, d, "cache_returns"), _place(spark, "headers")
    files.write_csv(bars.where(~F.col("is_benchmark")).select(*_BAR.names), f"{path}/a", single=True)
    files.write_csv(bars.where("is_benchmark").select(F.lit("yes").alias("is_benchmark"), "date", "ticker"), f"{path}/b", single=True)
    return files.scan_csv(spark, [f"{path}/a", f"{path}/b"], pinned=_BAR)


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'column_count' WHEN c_custkey % 5 = 0 THEN 'invalid_value' ELSE 'typed' END AS outcome FROM customer")
def csv_checked_scan(spark: SparkSession, d: str) -> DataFrame:
    """Records of files that don't parse come out with their reason beside the typed ones."""
    c, path = table(spark, d, "customer"), _place(spark, "checked")
    balance = F.when(F.col("c_custkey") % 7 == 0, "1,2").when(F.col("c_custkey") % 5 == 0, "much").otherwise(F.col("c_acctbal").cast("string"))
    lines = c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), balance).alias("value"))
    header = spark.createDataFrame([("c_custkey,c_acctbal",)], "value string").coalesce(1)
    header.unionByName(lines).coalesce(1).write.text(path)  # one file, its header first
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])
    good, bad = files.scan_checked(spark, [path], schema, {"c_acctbal": bad_rows.plain_number})
    failed = bad.select(F.regexp_extract("raw_record", "^([0-9]+),", 1).cast("long").alias("c_custkey"), F.col("reason").alias("outcome"))
    return good.select("c_custkey", F.lit("typed").alias("outcome")).unionByName(failed)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def file_query(spark: SparkSession, d: str) -> DataFrame:
    return files.query_file(spark, f"{d}/nation.parquet", "SELECT n_regionkey, count(*) AS n FROM nation_file GROUP BY n_regionkey", "nation_file")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey BETWEEN 5 AND 15")
def parquet_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Written by nation, read back with only the wanted folders."""
    path = _place(spark, "parquet")
    files.write_parquet(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, ["s_nationkey"])
    return spark.read.parquet(path).where(F.col("s_nationkey").between(5, 15)).withColumn("s_nationkey", F.col("s_nationkey").cast("long"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def table_rebuilt_from_itself(spark: SparkSession, d: str) -> DataFrame:
    """A named table in a namespace, replaced by what is read from it."""
    house = tables.Warehouse(spark, _place(spark, "house"))
    house.save(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "balances", "cache")
    return house.save(house.read("balances", "cache").where("c_acctbal > 0"), "balances", "cache")


@query("SELECT ticker, date, close_adj, fetched_at FROM cache_returns QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY fetched_at DESC NULLS LAST, close_adj DESC NULLS LAST) = 1")
def backup_and_restore(spark: SparkSession, d: str) -> DataFrame:
    """A cache written to files and restored, the newest row of each key."""
    root = _place(spark, "backup")
    house = tables.Warehouse(spark, f"{root}/house")
    house.save(table(spark, d, "cache_returns").select("ticker", "date", "close_adj", "fetched_at"), "returns", "cache")
    tables.backup(house, ["returns"], "cache", f"{root}/files")
    house.drop("returns", "cache")
    return tables.restore(house, "returns", "cache", f"{root}/files", ["ticker", "date"], ["fetched_at", "close_adj"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '/Search/Details?id=' || c_custkey || '&b=' || c_nationkey END AS link, c_custkey % 4 = 0 AS login FROM customer")
def search_pages(spark: SparkSession, d: str) -> DataFrame:
    """Links of search pages, and pages that ask for a login."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    link = F.concat(F.lit("<p><a class='x' href='/Search/Details?id="), key, F.lit("&amp;b="), nation, F.lit("'>View details</a></p>"))
    body = F.when(F.col("c_custkey") % 3 == 0, F.lit("<p>nothing</p>")).otherwise(link)
    c = table(spark, d, "customer").withColumns({"_body": body, "_url": F.when(F.col("c_custkey") % 4 == 0, "https://site/Agree").otherwise("https://site/Search")})
    return c.select("c_custkey", html_pages.details_link(F.col("_body")).alias("link"), html_pages.needs_login(F.col("_url"), F.col("_body")).alias("login"))


@query("SELECT DISTINCT ticker, replace(trim(ticker || '/B '), '/', '-') AS symbol FROM enriched_awards WHERE ticker IS NOT NULL")
def quote_symbols(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "enriched_awards").select("ticker").where(F.col("ticker").isNotNull()).distinct()
    return e.withColumn("symbol", x.quote_symbol(F.concat("ticker", F.lit("/B "))))


@query("WITH w AS (SELECT ticker, min(action_date) AS lo, max(action_date) AS hi FROM enriched_awards WHERE ticker IS NOT NULL GROUP BY 1) SELECT DISTINCT c.ticker, date, close_adj FROM cache_returns c JOIN w ON c.ticker = w.ticker AND date BETWEEN lo AND hi")
def provider_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the wanted tickers and days from a provider over a table."""
    e = table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull())
    wanted = e.groupBy("ticker").agg(F.min("action_date").alias("start"), F.max("action_date").alias("end"))
    return TableReturns(table(spark, d, "cache_returns")).fetch_daily_bars(wanted)
