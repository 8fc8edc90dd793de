"""Tables that several queries build on, stored once per session and input folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.materialize import stored
from tidemark.operators import bars
from tidemark.operators.asof import asof_join
from tidemark.plans import phases
from tidemark.session import table

KEY = "contract_transaction_unique_key"
HORIZONS = (1, 5, 20, 60, 90, 120, 180)
_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a finished phase: written on first use, read afterwards, built again when a file of the folder has changed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    state = hash(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    key = (spark.sparkContext.applicationId, d, name, state)
    if key not in _kept:
        _kept[key] = stored(build(), name)
    return _kept[key]


def forget() -> None:
    """Let the next use of every phase table build it again."""
    _kept.clear()


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Transactions, the last load of each: a phase table, since history is read more than once."""
    return kept(spark, d, "transactions", lambda: bars.latest(table(spark, d, "raw_filtered_awards"), [KEY], ["ingested_at"]))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enriched_awards").select(KEY, "ticker", "sector", "industry", "market_cap", "market_cap_quality").distinct()


def base(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with full-history lag and the attributes of their owner."""
    lagged = phases.full_history_lag(raw(spark, d).drop("prev_potential_value"))
    return lagged.join(enriched(spark, d), KEY, "left")


def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "signals", lambda: phases.signals(base(spark, d)))


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "cache_returns").where(F.col("close_adj").isNotNull()).select("ticker", "date", "fetched_at", "close_adj")
    return bars.latest(some, ["ticker", "date"], ["fetched_at", "close_adj"]).drop("fetched_at")


def benchmarks(daily: DataFrame) -> list[str]:
    """The three tickers with the most bars stand in for the market and two industries."""
    top = daily.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(3).collect()
    return [r[0] for r in top] or [""]


def validated(spark: SparkSession, d: str) -> DataFrame:
    """Signals of listed owners with market value, with forward and excess returns."""

    def build() -> DataFrame:
        daily = daily_bars(spark, d)
        tickers = benchmarks(daily) * 3
        listed = signal_rows(spark, d).where(F.col("ticker").isNotNull() & F.col("market_cap").isNotNull())
        industry = {"Aerospace & Defense": tickers[1], "Information Technology Services": tickers[2]}
        return phases.validate(listed, daily, HORIZONS, tickers[0], industry)

    return kept(spark, d, "validated", build)


#: Measures that are compared with market-excess returns, and the transaction columns that ``phases.ratio_signals`` reads.
MEASURES = ("alpha_ratio", "moat_index", "ceiling_change_pct_of_mcap", "relative_ceiling_change", "obligation_ratio", "acv_alpha_ratio")
_READ = (
    KEY, "award_id_piid", "action_date", "period_of_performance_start_date", "period_of_performance_current_end_date", "transaction_type", "number_of_offers_received",
    "federal_action_obligation", "total_dollars_obligated", "current_total_value_of_award", "potential_total_value_of_award",
)


def measured(spark: SparkSession, d: str) -> DataFrame:
    """``MEASURES`` and the market-excess returns of all rows of ``validated``, without its other columns.

    Neither texts nor tags nor industry benchmarks are carried; the excess is taken once per bar and not once per event.
    """

    def build() -> DataFrame:
        # stored, since history is read twice
        rows = stored(bars.latest(table(spark, d, "raw_filtered_awards"), [KEY], ["ingested_at"]).select(*_READ), "transaction-values")
        listed = enriched(spark, d).where(F.col("ticker").isNotNull() & F.col("market_cap").isNotNull()).select(KEY, "ticker", "market_cap")
        events = phases.ratio_signals(phases.full_history_lag(rows).join(listed, KEY)).select("ticker", "action_date", *MEASURES)
        daily = daily_bars(spark, d)
        rets = bars.forward_returns(daily, HORIZONS)
        dates = rows.select(F.col("action_date").cast("date").alias("d")).unionByName(daily.select(F.col("date").cast("date").alias("d")))
        span = tuple(dates.agg(F.min("d"), F.max("d")).first())
        span = span if span[0] else None
        market = bars.attach_returns(rets.withColumn("_market", F.lit(benchmarks(daily)[0])), rets, HORIZONS, "_market", "date", "benchmark_", "_d1", span)
        excess = {f"excess_return_{h}d": F.col(f"return_{h}d") - F.col(f"benchmark_return_{h}d") for h in HORIZONS}
        # stored, so that the driver plans two queries of half the size
        side = stored(market.select("ticker", "date", *[c.alias(k) for k, c in excess.items()]), "excess-returns")
        return asof_join(events, side, "ticker", "action_date", "date", [*excess], "forward", span=span).select(*MEASURES, *excess)

    return kept(spark, d, "measured", build)
