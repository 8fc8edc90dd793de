"""Daily bars: backward changes, forward returns over several horizons, excess returns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.asof import asof_join


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``newest``; rows that tie in all of these must be alike or any of them will do.

    A ranked window: columns that nobody reads are pruned below it, and the limit of one row
    per key is applied before the shuffle as well.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest] or [F.lit(0)])
    return df.withColumn("__tm_place", F.row_number().over(w)).where(F.col("__tm_place") == 1).drop("__tm_place")


def changes(bars: DataFrame, key: str = "ticker", day: str = "date", price: str = "close_adj", out: str = "ret_back_1d") -> DataFrame:
    """Change from the bar before."""
    before = F.lag(price).over(Window.partitionBy(key).orderBy(day))
    return bars.withColumn(out, F.col(price) / F.when(before != 0, before) - 1)


def forward_returns(bars: DataFrame, horizons: Sequence[int], key: str = "ticker", day: str = "date", price: str = "close_adj") -> DataFrame:
    """Return to the bar ``h`` places later, for all horizons over one window."""
    w = Window.partitionBy(key).orderBy(day)
    p = F.when(F.col(price) != 0, F.col(price))
    return bars.withColumns({f"return_{h}d": F.lead(price, h).over(w) / p - 1 for h in horizons})


def benchmark_of(segment: Column, mapping: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, ticker in mapping.items():
        out = F.when(segment == name, F.lit(ticker)).otherwise(out)
    return out


def attach_returns(events: DataFrame, returns: DataFrame, horizons: Sequence[int], key: str = "ticker", day: str = "action_date", prefix: str = "", date_out: str = "reference_trading_date", span: tuple | None = None) -> DataFrame:
    """``events`` with the returns of the first bar at or after their day."""
    cols = ["date", *[f"return_{h}d" for h in horizons]]
    side = returns.select(F.col("ticker").alias(key), *cols)
    joined = asof_join(events, side, key, day, "date", cols, "forward", prefix="_b_", span=span)
    return joined.withColumnsRenamed({"_b_date": date_out} | {f"_b_return_{h}d": f"{prefix}return_{h}d" for h in horizons})
