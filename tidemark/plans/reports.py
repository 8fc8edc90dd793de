"""The validation and backtest reports, composed of sections: (HTML, Markdown) from small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranks import p_value
from tidemark.plans import analytics_queries as a
from tidemark.plans import render

#: Title and query of each section, in their order.
VALIDATION = (
    ("Signal coverage", a.signal_coverage), ("Sample size by horizon", a.horizon_sample_sizes), ("Rank correlations by signal and horizon", a.ic_summary_matrix),
    ("Primary actions against all", a.primary_vs_all_ic), ("Clean signals against all", a.quality_vs_all_ic), ("By sector", a.ic_by_segment), ("By kind of transaction", a.ic_by_transaction_type),
    ("Decision criteria", a.decision_criteria), ("Stable over quarters", a.stability_filter), ("Event classes", lambda s, d: a.event_class_ic(s, d).where("kept")),
    ("Event magnitudes", lambda s, d: a.event_magnitude_ic(s, d).where("kept")), ("Returns by bucket", a.decile_spread), ("Highest less lowest bucket", a.top_minus_bottom),
)
BACKTEST = (
    ("Variants", a.variant_matrix), ("One class over another, by months", a.summary_monthly), ("By fiscal year", a.summary_by_year), ("Limits of a major expansion", a.threshold_sweep),
    ("Rows over each limit", a.threshold_sweep_rows), ("Blended signals", a.blend_variants), ("Parts of the blend", a.component_correlations),
)


def _sorted(df: DataFrame) -> DataFrame:
    """Correlations by size with their p, other tables by their first columns."""
    if {"ic", "n"} <= set(df.columns):
        df = df.withColumn("p", p_value(F.col("ic"), F.col("n")))
    return df.orderBy(F.abs("ic").desc_nulls_last(), *df.columns[:3]) if "ic" in df.columns else df.orderBy(*df.columns[:2])


def compose(title: str, sections, spark: SparkSession, d: str, charts=()) -> tuple[str, str]:
    """Every section is one table; ``charts`` are finished SVG pictures that end the page."""
    page, text = render.report(title, [(name, _sorted(build(spark, d))) for name, build in sections])
    return page + "".join(charts), text


def validation_report(spark: SparkSession, d: str, title: str = "Signals against forward returns") -> tuple[str, str]:
    matrix = a.ic_summary_matrix(spark, d).collect()  # a row per signal and horizon
    signals, horizons = sorted({r.signal for r in matrix}), sorted({r.horizon for r in matrix})
    heat = render.heat_map(signals, [str(h) for h in horizons], {(r.signal, str(r.horizon)): r.ic for r in matrix})
    at20 = sorted((r for r in matrix if r.horizon == 20), key=lambda r: r.signal)
    buckets = a.decile_spread(spark, d).orderBy("bucket").collect()  # ten rows
    error = [b.std_return / b.n**0.5 if b.std_return is not None else 0.0 for b in buckets]
    charts = [heat, render.bar_chart([r.signal for r in at20], [r.ic for r in at20]), render.bar_chart([str(b.bucket) for b in buckets], [b.mean_return for b in buckets], error)]
    return compose(title, VALIDATION, spark, d, charts)


def backtest_report(spark: SparkSession, d: str, title: str = "Long and short portfolios") -> tuple[str, str]:
    days = a.cumulative_pnl_long_short(spark, d).orderBy("reference_trading_date").collect()  # a row per day
    return compose(title, BACKTEST, spark, d, [render.line_chart([r.pnl for r in days])])
