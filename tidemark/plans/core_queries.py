"""Queries of the general data problems (p1, p3, p4, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bad_rows, heavy_keys, spikes, versions
from tidemark.plans.core_sql import SQL as SQL
from tidemark.schemas import LABELLED_TRANSACTION
from tidemark.session import table

CHECKS = {
    "contract_transaction_unique_key": bad_rows.key_parts(6),
    "federal_action_obligation": bad_rows.plain_number,
    "action_date": bad_rows.real_day,
}


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return bad_rows.split_records(table(spark, d, "mock_transaction_types"), "raw_record", LABELLED_TRANSACTION, CHECKS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)[1].select("record_id", "reason")


def p1_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d)[0]


def p1_reasons_by_file(spark: SparkSession, d: str) -> DataFrame:
    bad = _records(spark, d)[1]
    return bad.groupBy("source_file", "reason").agg(F.count("*").alias("n"), F.min("record_id").alias("first_record_id"))


ATTRIBUTES = ["market_cap", "shares_outstanding", "market_cap_quality"]


def _known(spark: SparkSession, d: str) -> DataFrame:
    awards = table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull())
    awards = awards.select("contract_transaction_unique_key", "ticker", "action_date", *ATTRIBUTES)
    history = table(spark, d, "cache_market_cap").where(F.col("status") == "success")
    effective = F.greatest(F.col("date"), F.col("fetched_at").cast("date"))
    # both days must be known: greatest() would skip a null one
    effective = F.when(F.col("date").isNotNull() & F.col("fetched_at").isNotNull(), effective)
    intervals = versions.validity_intervals(history, "ticker", effective, ["date", "fetched_at"], ATTRIBUTES)
    return versions.as_known(awards, intervals, "ticker", "action_date", ATTRIBUTES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    differs = F.lit(False)
    for c in ATTRIBUTES:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"known_{c}"))
    return _known(spark, d).where(differs).select("contract_transaction_unique_key").distinct()


def p3_known_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("contract_transaction_unique_key", "ticker", "action_date", *[f"known_{c}" for c in ATTRIBUTES])


SHARE = 0.05


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def named(df: DataFrame, key: str) -> DataFrame:
        return heavy_keys.heavy_keys(df, key, SHARE).select(F.lit(key).alias("field"), F.col(key).alias("key_value"))

    raw = table(spark, d, "raw_filtered_awards")
    listed = table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull())
    return named(raw, "award_id_piid").unionByName(named(listed, "ticker"))


def p4_award_results(spark: SparkSession, d: str) -> DataFrame:
    aggs = [
        heavy_keys.Agg("n", "count"), heavy_keys.Agg("obligated", "sum", "federal_action_obligation"), heavy_keys.Agg("first_action", "min", "action_date"),
        heavy_keys.Agg("last_potential", "last", "potential_total_value_of_award", ("action_date", "contract_transaction_unique_key", "ingested_at")),
    ]
    out = heavy_keys.aggregate(table(spark, d, "raw_filtered_awards"), "award_id_piid", aggs)
    return out.select("award_id_piid", "n", F.round("obligated", 2).alias("obligated"), "first_action", "last_potential")


def p4_ticker_results(spark: SparkSession, d: str) -> DataFrame:
    aggs = [
        heavy_keys.Agg("n", "count"), heavy_keys.Agg("max_cap", "max", "market_cap"),
        heavy_keys.Agg("last_cap", "last", "market_cap", ("action_date", "contract_transaction_unique_key")),
    ]
    out = heavy_keys.aggregate(table(spark, d, "enriched_awards").where(F.col("ticker").isNotNull()), "ticker", aggs)
    return out.drop("is_heavy")


def p4_row_shares(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_filtered_awards").select("contract_transaction_unique_key", "ingested_at", "award_id_piid", "total_dollars_obligated")
    per_key = heavy_keys.aggregate(raw, "award_id_piid", [heavy_keys.Agg("highest", "max", "total_dollars_obligated")]).drop("is_heavy")
    share = F.col("total_dollars_obligated") / F.when(F.col("highest") != 0, F.col("highest"))
    return heavy_keys.join(raw, per_key, "award_id_piid").select("contract_transaction_unique_key", "ingested_at", "award_id_piid", F.round(share, 6).alias("share_of_highest"))


MEASURES = ["potential_total_value_of_award", "ceiling_change", "relative_ceiling_change"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """One row per transaction and measure, with the bound of ceiling reductions joined in."""
    key = "contract_transaction_unique_key"
    s = table(spark, d, "signals_awards").select(
        key, F.col("awarding_sub_agency_name").alias("source"), F.col("action_date").alias("day"), F.col("award_id_piid").alias("unit"), *MEASURES
    )
    stack = ", ".join(f"'{m}', {m}" for m in MEASURES)
    return s.selectExpr(key, "source", "day", "unit", f"stack(3, {stack}) AS (field, value)")


def _bounded_readings(spark: SparkSession, d: str) -> DataFrame:
    key, r = "contract_transaction_unique_key", _readings(spark, d)
    prev = table(spark, d, "raw_filtered_awards").where(F.col("prev_potential_value").isNotNull()).select(key, "prev_potential_value")
    falls = r.where((F.col("field") == "ceiling_change") & (F.col("value") < 0)).select(key, "value")
    too_far = falls.join(prev, key).where(-F.col("value") > F.col("prev_potential_value")).select(key).distinct()
    too_far = too_far.withColumn("field", F.lit("ceiling_change")).withColumn("_too_far", F.lit(True))
    beyond = ((F.col("field") == "potential_total_value_of_award") & (F.col("value") < 0)) | ((F.col("field") == "relative_ceiling_change") & (F.col("value") < -1))
    return r.join(too_far, [key, "field"], "left").withColumn("out_of_bounds", beyond | F.coalesce(F.col("_too_far"), F.lit(False))).drop("_too_far")


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag(_bounded_readings(spark, d), ["contract_transaction_unique_key"], low_fields=("potential_total_value_of_award",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).where(F.col("found_by").isNotNull()).select("contract_transaction_unique_key", "field")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).drop("value")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("field", "found_by").agg(F.count("*").alias("n"), F.count_if("tail").alias("beyond_fit"), F.count_if("ratio").alias("beyond_ratio"))


def p5_source_medians(spark: SparkSession, d: str) -> DataFrame:
    return spikes.exact_medians(_readings(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_typed_rows, p1_reasons_by_file, p3_found, p3_known_attributes, p4_found, p4_award_results, p4_ticker_results, p4_row_shares,
        p5_found, p5_flags, p5_paths, p5_source_medians,
    )
}
