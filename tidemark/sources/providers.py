"""Where prices, names and hierarchies come from: tables that stand for outside services.

The engine asks a provider for DataFrames. Network clients are not part of it; a provider
over delivered tables is, and any other can be given that has the same methods.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import company_key, looks_like_id, quote_symbol


class ReturnsProvider(Protocol):
    def fetch_daily_bars(self, wanted: DataFrame) -> DataFrame:
        """(ticker, date, close_adj) for rows (ticker, start, end), both days included."""

    def fetch_benchmark(self, ticker: str, start: str, end: str) -> DataFrame:
        """(ticker, date, close_adj) of one benchmark."""


class TableReturns:
    """Bars from a table (ticker, date, close_adj)."""

    def __init__(self, bars: DataFrame) -> None:
        self.bars = bars.select(quote_symbol(F.col("ticker")).alias("ticker"), "date", "close_adj")

    def fetch_daily_bars(self, wanted: DataFrame) -> DataFrame:
        w = wanted.select(quote_symbol(F.col("ticker")).alias("ticker"), "start", "end")
        # overlapping ranges of a ticker give a bar once
        hit = self.bars.join(w, "ticker").where(F.col("date").between(F.col("start"), F.col("end")))
        return hit.select("ticker", "date", "close_adj").distinct()

    def fetch_benchmark(self, ticker: str, start: str, end: str) -> DataFrame:
        return self.bars.where((F.col("ticker") == ticker) & F.col("date").between(start, end))


def resolve_tickers(owners: DataFrame, candidates: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, ticker, exchange): by normalised name, the first ticker in the alphabet that is none of an identifier kind.

    ``candidates``: name, ticker, exchange. Owners without any keep a null ticker.
    """
    usable = candidates.where((F.col("ticker") != "") & ~looks_like_id(F.col("ticker")))
    best = usable.groupBy(company_key(F.col("name")).alias("_key")).agg(F.min(F.struct("ticker", "exchange")).alias("_b"))
    keyed = owners.select(owner).distinct().withColumn("_key", company_key(F.col(owner)))
    return keyed.join(best, "_key", "left").select(owner, F.col("_b.ticker").alias("ticker"), F.col("_b.exchange").alias("exchange"))
