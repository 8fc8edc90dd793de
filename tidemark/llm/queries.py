"""Queries of the language-model problems (p2, p6, p7, p8, p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import leakage, mixing, name_variants, nearest_time, splitting
from tidemark.llm.sql import SQL as SQL
from tidemark.llm.tokens import count_tokens
from tidemark.materialize import stored
from tidemark.plans.event_tables import kept
from tidemark.session import table

KEY = "contract_transaction_unique_key"


def _names(spark: SparkSession, d: str) -> DataFrame:
    raw, enriched = table(spark, d, "raw_filtered_awards"), table(spark, d, "enriched_awards")
    fields = [raw.select(F.col("recipient_parent_name_raw").alias("name")), raw.select(F.col("recipient_parent_name").alias("name")), enriched.select(F.col("highest_level_owner_name").alias("name"))]
    return fields[0].distinct().unionByName(fields[1].distinct()).unionByName(fields[2].distinct())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.pairs(name_variants.link_names(_names(spark, d), "name"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    linked = name_variants.link_names(_names(spark, d), "name")
    size = linked.groupBy("class_id").agg((F.count("*") - 1).alias("links"), F.min("name").alias("representative"))
    return linked.join(size, "class_id").select("name", "representative", "links")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names by the path that brought them to the others of their class."""
    return name_variants.link_names(_names(spark, d), "name").groupBy("path").agg(F.count("*").alias("names"), F.countDistinct("class_id").alias("classes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    awards = table(spark, d, "enriched_awards").select(KEY, "ticker", "action_date")
    bars = table(spark, d, "cache_returns").select("ticker", F.col("date").alias("bar_date"))
    near = nearest_time.nearest(awards, bars, "ticker", "action_date", "bar_date", KEY, 5)
    return near.select(KEY, "ticker", F.date_format("bar_date", "yyyy-MM-dd").alias("bar_date"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    index = kept(spark, d, "positional-index", lambda: leakage.build_index(table(spark, d, "documents"), "doc_id", "text"))
    return leakage.search(index, leakage.read_items(table(spark, d, "eval_items"), "item_id", "text", 15), 15, 6)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", F.col("item").alias("item_id"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind = 'exact'").select("doc_id", F.col("item").alias("item_id"))


def _draws(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", count_tokens(F.col("text")).alias("n_tokens"))
    targets = table(spark, d, "mix_targets").collect()  # the mixes: a few rows
    return mixing.draw(stored(docs, "document-tokens"), [t.asDict() for t in targets])


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d)


def p8_source_seats(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 4,096 characters that each source of each mix gets: the apportionment alone, on sizes that SQL knows."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    targets = [t.asDict() for t in table(spark, d, "mix_targets").collect()]
    seats = mixing.source_seats(mixing.plan(docs, targets, block_tokens=4096, shard_tokens=1 << 60))
    return spark.createDataFrame(seats, "mix_name string, source string, blocks long")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_draws(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.with_cuts(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents").select("doc_id", "text"), "text")


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each document must keep: begin and end of the text, no gap, something new in each, the limit."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pieces = splitting.split(docs, "text").select("doc_id", "start", (F.col("start") + F.length("piece")).alias("end"), "n_tokens", "piece_no")
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("piece_no"))
    fine = before.isNull() | ((F.col("start") <= before) & (F.col("end") > before))
    whole = pieces.withColumn("_fine", fine).groupBy("doc_id").agg(
        F.min("start").alias("first"), F.max("end").cast("long").alias("last"), F.every("_fine").alias("joined"), (F.max("n_tokens") <= 1024).alias("within")
    )
    return whole.withColumn("first", F.col("first").cast("long"))


QUERIES = {f.__name__: f for f in (p2_found, p2_classes, p2_paths, p6_found, p7_found, p7_matches, p7_exact, p8_draws, p8_source_seats, p8_shares, p9_found, p9_pieces, p9_cover)}
