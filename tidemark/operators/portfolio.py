"""Long/short trades from bucketed or classed events, and their statistics.

Trades of any number of variants stand in one table with a ``variant`` column, so that one
job gives all summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import bucket, winsorize

TRADE = ["variant", "reference_trading_date", "fiscal_year", "ticker", "side", "signal_value", "gross_return", "net_return", "weight"]
TRADING_DAYS = 252


def _trades(sided: DataFrame, counts: DataFrame, signal: str, ret: str, cost_bps: float) -> DataFrame:
    """Trades of rows that have a side; a variant needs both sides. Shorts gain what the price loses.

    ``counts`` has the rows of each side (n_long, n_short), one row per variant, which is what gets broadcast.
    """
    gross = F.when(F.col("side") == "long", F.col(ret)).otherwise(-F.col(ret))
    weight = F.when(F.col("side") == "long", 1.0 / F.col("n_long")).otherwise(-1.0 / F.col("n_short"))
    both = counts.where((F.col("n_long") > 0) & (F.col("n_short") > 0)).select("variant", "n_long", "n_short")
    return sided.where(F.col("side").isNotNull()).join(F.broadcast(both), "variant").select(
        "variant", "reference_trading_date", F.substring("fiscal_quarter", 1, 4).alias("fiscal_year"), "ticker", "side", F.col(signal).alias("signal_value"),
        gross.alias("gross_return"), (gross - cost_bps / 10_000).alias("net_return"), weight.alias("weight"),
    )


def bucket_trades(rows: DataFrame, signal: str, ret: str, n_buckets: int = 10, cost_bps: float = 15.0) -> DataFrame:
    """Long the highest bucket and short the lowest of each ``variant``, a column of ``rows``.

    The buckets that occur and their sizes come from one aggregation of a few rows per variant; no variant is ordered or gathered in a task.
    """
    cut = bucket(rows.dropna(subset=[signal, ret]), ["variant"], signal, n_buckets, "_bucket")
    sizes = cut.where(F.col("_bucket").isNotNull()).groupBy("variant", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ends = sizes.groupBy("variant").agg(F.max("_bucket").alias("_top"), F.max_by("_n", "_bucket").alias("n_long"), F.coalesce(F.max(F.when(F.col("_bucket") == 1, F.col("_n"))), F.lit(0)).alias("n_short"))
    ends = ends.where(F.col("_top") >= 2)
    side = F.when(F.col("_bucket") == F.col("_top"), "long").when(F.col("_bucket") == 1, "short")
    sided = cut.join(F.broadcast(ends.select("variant", "_top")), "variant").withColumn("side", side)
    return _trades(sided, ends, signal, ret, cost_bps)


def in_class_trades(df: DataFrame, signal: str, ret: str, class_col: str, classes: Sequence[str], n_buckets: int = 10, cost_bps: float = 15.0) -> DataFrame:
    """Long the highest bucket and short the lowest within each class; a class is a variant."""
    return bucket_trades(df.where(F.col(class_col).isin(*classes)).withColumn("variant", F.col(class_col)), signal, ret, n_buckets, cost_bps)


def cross_class_trades(df: DataFrame, signal: str, ret: str, class_col: str, long_class: str, short_class: str, cost_bps: float = 15.0) -> DataFrame:
    """Long all rows of one class and short all of another."""
    side = F.when(F.col(class_col) == long_class, "long").when(F.col(class_col) == short_class, "short")
    rows = df.dropna(subset=[ret]).withColumn("variant", F.lit(f"{long_class} over {short_class}")).withColumn("side", side)
    counts = rows.groupBy("variant").agg(F.count_if(F.col("side") == "long").alias("n_long"), F.count_if(F.col("side") == "short").alias("n_short"))
    return _trades(rows, counts, signal, ret, cost_bps)


def _stats(net: Column, gross: Column) -> list[Column]:
    """Statistics of one period; ``_scaled`` brings the ratios to a year."""
    mean, sd = F.avg(net), F.stddev_samp(net)
    losses = F.stddev_samp(F.when(net < 0, net))
    return [
        F.avg(gross).alias("gross_mean"), mean.alias("net_mean"), F.coalesce(sd, F.lit(0.0)).alias("net_stddev"),
        (mean / F.when(sd > 0, sd)).alias("sharpe"), (mean / F.when(losses > 0, losses)).alias("sortino"),
        F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.sum(gross).alias("gross_total"), F.sum(net).alias("net_total"),
    ]


def _scaled(df: DataFrame, periods: Column) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.sqrt(periods) for c in ("sharpe", "sortino")})


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_trades"), F.count_if(F.col("side") == "long").alias("n_long"), F.count_if(F.col("side") == "short").alias("n_short")]


def summary_per_trade(trades: DataFrame, by: Sequence[str] = ("variant",), hold_days: int | Column = 20) -> DataFrame:
    """Every trade is one period of ``hold_days``, a number or an expression of ``by``."""
    hold = F.lit(float(hold_days)) if isinstance(hold_days, int) else hold_days
    stats = trades.groupBy(*by).agg(*_counts(), *_stats(F.col("net_return"), F.col("gross_return"))).withColumn("n_periods", F.col("n_trades"))
    return _scaled(stats, TRADING_DAYS / hold)


def summary_monthly(trades: DataFrame, by: Sequence[str] = ("variant",)) -> DataFrame:
    """A month is a period: mean of the long trades plus mean of the short ones, a missing side counting nothing.

    Trades without a date count as trades, but belong to no month.
    """
    mean = lambda c, s: F.coalesce(F.avg(F.when(F.col("side") == s, F.col(c))), F.lit(0.0))
    dated = trades.where(F.col("reference_trading_date").isNotNull())
    months = dated.groupBy(*by, F.trunc("reference_trading_date", "MM").alias("month")).agg(
        (mean("net_return", "long") + mean("net_return", "short")).alias("_net"), (mean("gross_return", "long") + mean("gross_return", "short")).alias("_gross")
    )
    stats = months.groupBy(*by).agg(F.count(F.lit(1)).alias("n_periods"), *_stats(F.col("_net"), F.col("_gross")))
    stats = _scaled(stats, F.lit(12.0))
    return trades.groupBy(*by).agg(*_counts()).join(stats, list(by))


def same_sign(by_year: DataFrame, value: str = "net_mean", by: Sequence[str] = ("variant",)) -> DataFrame:
    """Years with a value, and those above, below and at zero."""
    v = F.col(value)
    return by_year.groupBy(*by).agg(F.count(v).alias("n_years"), F.count_if(v > 0).alias("n_positive"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"))


def variant_rows(summary: DataFrame, years: DataFrame, sharpe: float = 0.5, years_needed: int = 5) -> DataFrame:
    """Summaries with the pass flags of a minimum Sharpe ratio and of years of one sign."""
    joined = summary.join(years, "variant")
    most = F.greatest("n_positive", "n_negative")
    flags = {"pass_sharpe": F.coalesce(F.col("sharpe") >= sharpe, F.lit(False)), "pass_years": most >= years_needed}
    return joined.withColumns(flags).withColumn("passes", F.col("pass_sharpe") & F.col("pass_years"))


def bucket_returns(df: DataFrame, by: Sequence[str], signal: str, ret: str, n_buckets: int = 10) -> DataFrame:
    """(by, bucket, n, mean_return, std_return) over rows with both values."""
    cut = bucket(df.dropna(subset=[signal, ret]), by, signal, n_buckets)
    return cut.where(F.col("bucket").isNotNull()).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_return"), F.stddev_samp(ret).alias("std_return"))


def top_minus_bottom(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the highest less that of the lowest bucket that occurs; null where they are one."""
    agg = buckets.groupBy(*by) if by else buckets.groupBy()
    spread = F.max_by("mean_return", "bucket") - F.min_by("mean_return", "bucket")
    return agg.agg(F.when(F.max("bucket") > F.min("bucket"), spread).alias("top_minus_bottom"))


def cumulative_pnl(df: DataFrame, signal: str, ret: str, day: str, strategy: str = "long_top", n_buckets: int = 10) -> DataFrame:
    """(day, pnl): running sum over days of the mean return of all rows of a day, those not held counting zero."""
    if strategy not in ("long_top", "long_short"):
        raise ValueError("strategy is long_top or long_short")
    cut = bucket(df.dropna(subset=[signal, ret, day]), [], signal, n_buckets)
    ends = cut.agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    held = F.when(F.col("bucket") == F.col("_hi"), F.col(ret)).when((F.col("bucket") == F.col("_lo")) & F.lit(strategy == "long_short"), -F.col(ret)).otherwise(0.0)
    daily = cut.join(F.broadcast(ends), F.lit(True)).groupBy(day).agg(F.avg(held).alias("_r"))  # ends is one row
    return daily.select(day, F.sum("_r").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)).alias("pnl"))  # a row per day


@dataclass(frozen=True)
class Backtest:
    """One variant: its configuration, and summary, years, buckets and trades as DataFrames."""

    config: dict
    summary: DataFrame
    by_year: DataFrame
    deciles: DataFrame
    trades: DataFrame


def run_backtest(
    df: DataFrame, signal: str, ret: str, class_col: str, *, framing: str, target_class: str | None = None, long_class: str | None = None, short_class: str | None = None,
    winsorized: bool = False, n_buckets: int = 10, cost_bps: float = 15.0, hold_days: int = 20,
) -> Backtest:
    """``in_class``: highest against lowest bucket of one class, each trade a period. ``cross_class``: one class against another, by months.

    ``winsorized`` clips the signal within each class before it is cut into buckets.
    """
    config = {k: v for k, v in locals().items() if k != "df"}
    if framing not in ("in_class", "cross_class"):
        raise ValueError("framing is in_class or cross_class")
    if framing == "in_class" and target_class is None:
        raise ValueError("in_class needs a target class")
    if framing == "cross_class" and (long_class is None or short_class is None):
        raise ValueError("cross_class needs a long and a short class")
    if winsorized:
        df = winsorize(df, [class_col], signal, out=signal)
    if framing == "in_class":
        trades = in_class_trades(df, signal, ret, class_col, [target_class], n_buckets, cost_bps)
        deciles = bucket_returns(df.where(F.col(class_col) == target_class), [], signal, ret, n_buckets)
        summary, years = (summary_per_trade(trades, by, hold_days) for by in (["variant"], ["variant", "fiscal_year"]))
    else:
        trades = cross_class_trades(df, signal, ret, class_col, long_class, short_class, cost_bps)
        deciles = bucket_returns(df.where(F.lit(False)), [], signal, ret, n_buckets)
        summary, years = (summary_monthly(trades, by) for by in (["variant"], ["variant", "fiscal_year"]))
    return Backtest(config, summary, years, deciles, trades)
