"""Column layouts. The names and orders of these fields are fixed values of the data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BOOLEAN": T.BooleanType(), "LONG": T.LongType(), "INT": T.IntegerType()}


def _struct(text: str) -> T.StructType:
    """Like ``StructType.fromDDL`` for flat types, which needs a running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


#: Raw transactions, 24 fields in the order of the delivered records.
RAW_TRANSACTION = _struct(
    "contract_transaction_unique_key STRING, award_id_piid STRING, parent_award_id_piid STRING, "
    "federal_action_obligation DOUBLE, total_dollars_obligated DOUBLE, current_total_value_of_award DOUBLE, "
    "potential_total_value_of_award DOUBLE, action_date DATE, solicitation_date DATE, "
    "period_of_performance_start_date DATE, period_of_performance_current_end_date DATE, "
    "awarding_agency_name STRING, awarding_sub_agency_name STRING, cage_code STRING, recipient_parent_uei STRING, "
    "recipient_parent_name STRING, recipient_parent_name_raw STRING, product_or_service_code STRING, "
    "product_or_service_code_description STRING, naics_code STRING, naics_description STRING, "
    "number_of_offers_received DOUBLE, transaction_description STRING, award_type STRING"
)
#: The same, with the label that the delivered sample records carry.
LABELLED_TRANSACTION = T.StructType([*RAW_TRANSACTION.fields, T.StructField("expected_transaction_type", T.StringType())])


#: What each phase adds to the columns before it.
INGESTED = [*RAW_TRANSACTION.names, "transaction_type"]
ENRICHED = [
    *INGESTED, "cage_business_name", "cage_update_date", "is_highest", "immediate_level_owner", "highest_level_owner_name", "highest_level_cage_code",
    "highest_level_cage_update_date", "is_public", "ticker", "sole_source_flag", "market_cap", "close_price", "shares_outstanding", "market_cap_quality",
    "sector", "industry", "last_verified_date", "theme_llm",
]
THEMED = [*ENRICHED, "naics_title", "naics_keywords", "psc_name", "psc_includes", "psc_level_1_category", "deliverable"]
SIGNALLED = [
    *THEMED, "contract_duration_years", "remaining_contract_length_years", "annualized_potential_value", "contract_potential_yield", "obligation_ratio", "moat_index",
    "alpha_ratio", "ceiling_change", "duration_days", "acv_signal", "acv_alpha_ratio", "difference_between_obligated_and_potential", "ceiling_change_log_dollars",
    "ceiling_change_pct_of_mcap", "relative_ceiling_change", "event_class", "is_primary_action", "signal_quality", "pipeline_version", "ingested_at",
]
