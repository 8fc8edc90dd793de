"""The batch phases: ingest, enrich, themes, signals, validate. Functions of DataFrames.

Thresholds and word lists are fixed values of the data's meaning; all are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as x
from tidemark.materialize import stored
from tidemark.operators import bars
from tidemark.operators.asof import asof_join
from tidemark.operators.history import value_before
from tidemark.operators.quantiles import quantiles
from tidemark.schemas import RAW_TRANSACTION, SIGNALLED

VERSION = "0.1.0"
#: Kinds of award in scope (fixed values).
AWARD_TYPES = ("DEFINITIVE CONTRACT", "DELIVERY ORDER", "PURCHASE ORDER")
#: Words that mark changes without new money (fixed values).
QUIET_WORDS = ("No Cost", "Time Extension", "Administrative Change", "Correction", "Address Update", "Revision", "Clerical", "SP30")
#: Words that mark new money (fixed values).
MONEY_WORDS = (
    "Add", "Obligate", "Increment", "Funding", "Production", "Procurement", "Manufacture", "Purchase", "Acquisition", "Construction", "Execute",
    "UCA", "Definitization", "Letter Contract", "Undefinitized", "ICS", "Interim Contractor Support", "CLS", "Option", "Incentive Fee", "Award Fee", "Exercise",
)
#: Kinds of transaction that announce something (fixed values).
PRIMARY = ("NEW_AWARDS", "NEW_DELIVERY_ORDERS", "FUNDING_INCREASE")


def full_history_lag(df: DataFrame) -> DataFrame:
    """Ceiling before each transaction of its contract, and the change, over unfiltered history."""
    df = df.withColumn("potential_total_value_of_award", F.col("potential_total_value_of_award").cast("double"))
    out = value_before(df, "award_id_piid", "action_date", "contract_transaction_unique_key", "potential_total_value_of_award", "prev_potential_value")
    return out.withColumn("ceiling_change", F.col("potential_total_value_of_award") - F.col("prev_potential_value"))


def transaction_type(threshold: float = 5e6) -> Column:
    """Kind of a transaction from its key, parent, obligation, description and ceiling change; null if none applies."""
    segment = x.key_segment(F.col("contract_transaction_unique_key"), -3)
    first = segment.isin("0", "000")
    parent, money, text = F.col("parent_award_id_piid"), F.col("federal_action_obligation"), F.col("transaction_description")
    orphan = parent.isNull() | parent.isin("", "-NONE-")
    later = segment.isNotNull() & ~first
    quiet = F.coalesce(x.any_keyword(text, QUIET_WORDS), F.lit(False))
    return x.first_match(
        (first & orphan, "NEW_AWARDS"), (first, "NEW_DELIVERY_ORDERS"), (~later | later.isNull(), None), (money >= threshold, "MODIFICATION"),
        ((money == 0) & quiet, None), ((money == 0) & (F.col("ceiling_change") > threshold), "FUNDING_INCREASE"),
        ((money == 0) & x.any_keyword(text, MONEY_WORDS), "FUNDING_INCREASE"), ((money > 0) & (money < threshold), "FUNDING_INCREASE"),
    )


def ingest(raw: DataFrame, least_total: float = 5e6) -> DataFrame:
    """Base columns of the rows in scope, with history lag and kind. The window comes before the filters."""
    lagged = full_history_lag(raw.select(*RAW_TRANSACTION.names))
    scope = (F.col("federal_action_obligation") >= 0) & (F.col("total_dollars_obligated") >= least_total) & F.col("award_type").isin(*AWARD_TYPES)
    return lagged.where(scope).withColumn("transaction_type", transaction_type())


def profile(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("output_count"), F.sum("federal_action_obligation").alias("total_obligation")).select(F.lit(label).alias("input_file"), F.lit(-1).cast("long").alias("input_count"), "output_count", "total_obligation")


def stamp(df: DataFrame, version: str = VERSION, now: Column | None = None) -> DataFrame:
    return df.withColumns({"pipeline_version": F.lit(version), "ingested_at": F.current_timestamp() if now is None else now})


def lookup(df: DataFrame, side: DataFrame, on: Mapping[str, str], cols: Sequence[str]) -> DataFrame:
    """Left equi-join that adds only ``cols``; the join strategy follows the measured size of ``side``."""
    right = side.select(*[F.col(r).alias("_k_" + r) for r in on.values()], *cols)
    cond = F.lit(True)
    for left, r in on.items():
        cond = cond & (F.col(left) == F.col("_k_" + r))
    return df.join(right, cond, "left").drop(*["_k_" + r for r in on.values()])


HIERARCHY = ["cage_business_name", "cage_update_date", "is_highest", "immediate_level_owner", "highest_level_owner_name", "highest_level_cage_code", "highest_level_cage_update_date"]
MARKET = ["market_cap", "close_price", "shares_outstanding", "market_cap_quality", "sector", "industry"]


def sole_source(offers: Column) -> Column:
    """True for one offer, false for more, null for unknown and for fewer."""
    return F.when(offers == 1, True).when(offers > 1, False)


def enrich(df: DataFrame, hierarchy: DataFrame, tickers: DataFrame, caps: DataFrame, today: Column | None = None) -> DataFrame:
    """Owner, ticker and market value of the day, each from its cache (one row per key).

    ``hierarchy``: cage_code and ``HIERARCHY``; ``tickers``: highest_level_owner_name, ticker;
    ``caps``: ticker, date and ``MARKET``. Keys that a cache doesn't have, or has as not found, leave nulls.
    """
    out = lookup(df, hierarchy, {"cage_code": "cage_code"}, HIERARCHY)
    out = lookup(out, tickers, {"highest_level_owner_name": "highest_level_owner_name"}, ["ticker"])
    out = out.withColumns({"is_public": F.col("ticker").isNotNull(), "sole_source_flag": sole_source(F.col("number_of_offers_received"))})
    out = lookup(out, caps, {"ticker": "ticker", "action_date": "date"}, MARKET)
    return out.withColumns({"last_verified_date": F.current_date() if today is None else today, "theme_llm": F.lit(None).cast("string")})


def themes(df: DataFrame, naics: DataFrame, keywords: DataFrame, psc: DataFrame, boilerplate: Sequence[str] = ()) -> DataFrame:
    """Normalised codes with titles, keywords (ordered, joined by ``; ``) and service texts."""
    df = df.withColumns({"naics_code": x.pad_code(F.col("naics_code")), "product_or_service_code": x.upper_code(F.col("product_or_service_code"))})
    named = lookup(df.drop("naics_description"), naics, {"naics_code": "naics_code"}, ["naics_title", "naics_description"])
    named = named.withColumn("naics_description", x.strip_phrases(F.col("naics_description"), boilerplate))
    joined = keywords.select(x.pad_code(F.col("naics_code")).alias("naics_code"), "keyword").groupBy("naics_code")
    joined = joined.agg(F.expr("listagg(keyword, '; ') WITHIN GROUP (ORDER BY keyword)").alias("naics_keywords"))
    named = lookup(named, joined, {"naics_code": "naics_code"}, ["naics_keywords"])
    named = lookup(named, psc, {"product_or_service_code": "psc_code"}, ["psc_name", "psc_includes", "psc_level_1_category"])
    return named.withColumn("deliverable", F.col("psc_level_1_category"))


def ratio_signals(df: DataFrame) -> DataFrame:
    """Durations, annual values and ratios of money, change and market value."""
    start, end, action = (F.col(c).cast("date") for c in ("period_of_performance_start_date", "period_of_performance_current_end_date", "action_date"))
    money, change, cap = F.col("federal_action_obligation"), F.col("ceiling_change"), F.col("market_cap")
    fresh = F.when(money >= 1.0, money).otherwise(change)
    df = df.withColumns({
        "contract_duration_years": x.years_between(start, end), "remaining_contract_length_years": x.years_between(action, end), "duration_days": x.floored_days(action, end),
        "difference_between_obligated_and_potential": F.col("potential_total_value_of_award") - F.col("total_dollars_obligated"),
        "obligation_ratio": x.safe_div(fresh, F.col("current_total_value_of_award")), "alpha_ratio": x.safe_div(fresh, cap),
        "moat_index": x.safe_div(F.lit(1.0), F.col("number_of_offers_received")), "is_primary_action": F.coalesce(F.col("transaction_type").isin(*PRIMARY), F.lit(False)),
        "ceiling_change_log_dollars": x.signed_log10(change), "ceiling_change_pct_of_mcap": x.safe_div(change, cap),
        "relative_ceiling_change": x.safe_div(change, F.col("prev_potential_value")) if "prev_potential_value" in df.columns else F.lit(None).cast("double"),
    })
    df = df.withColumns({
        "annualized_potential_value": x.safe_div(F.col("potential_total_value_of_award"), F.col("contract_duration_years")),
        "acv_signal": money / F.col("duration_days") * F.lit(x.DAYS_PER_YEAR),
    })
    return df.withColumns({"contract_potential_yield": x.safe_div(F.col("annualized_potential_value"), cap), "acv_alpha_ratio": x.safe_div(F.col("acv_signal"), cap)})


def event_class(major: float | Column = 1e8, moderate: float = 1e7) -> Column:
    kind, change = F.col("transaction_type"), F.col("ceiling_change")
    funding = kind == "FUNDING_INCREASE"
    return x.first_match(
        (kind == "NEW_AWARDS", "NEW_AWARD"), (kind == "NEW_DELIVERY_ORDERS", "NEW_DELIVERY_ORDER"), (funding & (change > major), "MAJOR_EXPANSION"),
        (funding & (change > moderate), "MODERATE_EXPANSION"), (funding & (change > 0), "MINOR_EXPANSION"), (change < 0, "CONTRACTION"),
        ((kind == "MODIFICATION") & (F.coalesce(change, F.lit(0.0)) == 0), "OTHER_MOD"), otherwise="NON_EVENT",
    )


def quality_tags(df: DataFrame, microcap: float = 5e7, tail: float = 0.99) -> DataFrame:
    """``signal_quality``: tags joined by ``;``. The sector's tail is an exact quantile, joined by sector."""
    sector = F.coalesce(F.col("sector"), F.lit("UNKNOWN"))
    df = df.withColumn("_sector", sector)
    limits = quantiles(df, ["_sector"], F.abs(F.col("alpha_ratio")), [tail], "_p").select("_sector", F.col("_p")[0].alias("_p"))
    df = df.join(limits, "_sector", "left")
    cap, quality = F.col("market_cap"), F.col("market_cap_quality")
    tags = x.tag_list(
        ("missing_market_cap", cap.isNull()), ("no_close", quality == "no_close"), ("no_shares", quality == "no_shares"), ("stale_shares", quality == "stale_shares"),
        ("microcap", (cap > 0) & (cap < microcap)), ("extreme_ratio", (F.col("_p") > 0) & (F.abs("alpha_ratio") > F.col("_p"))),
    )
    return df.withColumn("signal_quality", tags).drop("_sector", "_p")


def signals(df: DataFrame) -> DataFrame:
    """All signals, quality tags and event class; the ceiling change is derived where it is missing.

    The ratios are stored, because their quantiles by sector read them twice before they are tagged.
    """
    if "ceiling_change" not in df.columns:
        df = full_history_lag(df).drop("prev_potential_value")
    return quality_tags(stored(ratio_signals(df), "ratio-signals")).withColumn("event_class", event_class()).drop("prev_potential_value")


def run(raw: DataFrame, hierarchy: DataFrame, tickers: DataFrame, caps: DataFrame, naics: DataFrame, keywords: DataFrame, psc: DataFrame, now: Column | None = None, least_total: float = 5e6) -> DataFrame:
    """All phases from raw transactions to stamped signals, with the columns of ``schemas.SIGNALLED``."""
    enriched = enrich(ingest(raw, least_total), hierarchy, tickers, caps, None if now is None else now.cast("date"))
    return stamp(signals(themes(enriched, naics, keywords, psc)), now=now).select(*SIGNALLED)


def point_in_time_cap(events: DataFrame, prices: DataFrame, shares: DataFrame, current: DataFrame, close_days: int = 10, share_days: int = 180) -> DataFrame:
    """Market value of the day from the last close and the last valid share count; falls back to current shares.

    ``prices``: ticker, date, close; ``shares``: ticker, report_date, count; ``current``: ticker, shares_now.
    """
    out = asof_join(events, prices, "ticker", "action_date", "date", ["close"], "backward", close_days, "_")
    out = asof_join(out, shares, "ticker", "action_date", "report_date", ["count"], "backward", share_days, "_")
    out = lookup(out, current, {"ticker": "ticker"}, ["shares_now"])
    valid = lambda c: F.when((c > 0) & ~F.isnan(c), c)
    close, known, now = F.col("_close"), valid(F.col("_count")), valid(F.col("shares_now"))
    quality = x.first_match((close.isNull(), "no_close"), (known.isNotNull(), "ok"), (now.isNotNull(), "stale_shares"), otherwise="no_shares")
    count = F.when(close.isNotNull(), F.coalesce(known, now))
    return out.withColumns({"close_price": close, "shares_outstanding": count, "market_cap": close * count, "market_cap_quality": quality}).drop("_close", "_count", "shares_now")


def validate(events: DataFrame, daily: DataFrame, horizons: Sequence[int], benchmark: str, industry_benchmarks: Mapping[str, str]) -> DataFrame:
    """Events with forward returns of their ticker, of the benchmark and of the industry's, and the differences.

    Benchmarks are taken at the day of the ticker's own first bar; without one all stay null.
    """
    rets = bars.forward_returns(daily, horizons)
    # reference days are days of bars: one look at both tables serves all three joins
    dates = events.select(F.col("action_date").cast("date").alias("d")).unionByName(daily.select(F.col("date").cast("date").alias("d")))
    span = tuple(dates.agg(F.min("d"), F.max("d")).first())
    span = span if span[0] else None
    out = bars.attach_returns(events, rets, horizons, span=span)
    ref = F.col("reference_trading_date")
    out = out.withColumn("fiscal_quarter", x.fiscal_quarter(F.col("action_date")))
    out = out.withColumns({"_spy": F.when(ref.isNotNull(), F.lit(benchmark)), "industry_benchmark_ticker": F.when(ref.isNotNull(), bars.benchmark_of(F.col("industry"), industry_benchmarks, benchmark))})
    out = bars.attach_returns(out, rets, horizons, "_spy", "reference_trading_date", "benchmark_", "_d1", span)
    out = bars.attach_returns(out, rets, horizons, "industry_benchmark_ticker", "reference_trading_date", "industry_benchmark_", "_d2", span)
    excess = {}
    for h in horizons:
        excess[f"excess_return_{h}d"] = F.col(f"return_{h}d") - F.col(f"benchmark_return_{h}d")
        excess[f"industry_excess_return_{h}d"] = F.col(f"return_{h}d") - F.col(f"industry_benchmark_return_{h}d")
    return out.withColumns(excess).drop("_spy", "_d1", "_d2")
