"""Implausible spikes in measurements, relative to each source's normal behaviour.

Readings are (source, field, value, day, unit): ``unit`` is what a value may rightly be
repeated on (one contract). Per source and field:

* **tail**: peaks over threshold. The residual of a reading is log10 of its magnitude less
  the median of its source, field and month of the year (readings without a day are a
  season of their own). Beyond the ``tail`` quantile of residuals, on either side, a
  generalised Pareto distribution is fitted by quantiles of the excesses (Pickands): spikes
  count as ranks there and move the fit by their number only, however far they lie. The fit gives the cutoff that a normal reading passes with a probability of ``risk``. The
  shape is drawn towards an exponential tail by what its own sampling error is worth, so a
  source with few readings gets a fit as well.
* **ratio**: magnitude over ``max_ratio`` times the source's exact median non-zero finite
  magnitude (or, where asked for, under its inverse). It is checked on the readings beyond
  the start of their cell (source, field, month): the fitted cutoff, or the plausibility
  bound (the ratio itself) in those cells whose fit lies beyond it or doesn't exist.
* **frozen**: one non-zero value on at least ``min_units`` units within ``span_days``.
* **impossible**: non-finite, or beyond a bound that the caller gives.

``found_by`` names the first path that gives a reading: impossible, fit (beyond the fitted
cutoff, ratio confirmed), plausibility (the same in a cell without a usable cutoff), frozen;
null for readings beyond the fitted cutoff that the ratio doesn't confirm.

Nothing is gathered per source: all quantiles are exact ones from a sketch and one counting
pass (``quantiles``); and the frozen rule works on at most ``min_units`` units a day in
pairs of neighbouring time buckets, so that a value that a third of all rows share is as
cheap as any other. Readings that are null are none. A null source takes part in the
impossible rule only, a null day in all but the frozen rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.materialize import stored
from tidemark.operators.quantiles import quantiles

GROUP = ["source", "field"]
#: Half width of the bracket around the median; the sketch's error is 1 / ACCURACY.
BRACKET, ACCURACY = 0.002, 10_000


@dataclass(frozen=True)
class Rules:
    tail: float = 0.9
    risk: float = 1e-4
    max_ratio: float = 100.0
    min_units: int = 6
    span_days: int = 30


def _measured(readings: DataFrame) -> DataFrame:
    """Non-zero finite readings of a known source with their magnitude."""
    v = F.col("value")
    return readings.where(F.col("source").isNotNull() & v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.abs(v) != float("inf"))).withColumn("mag", F.abs(v))


def exact_medians(readings: DataFrame) -> DataFrame:
    """(source, field, n, median) of non-zero finite magnitudes, exact at any size."""
    m = _measured(readings).select(*GROUP, "mag")
    p = F.percentile_approx("mag", [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY)
    bracket = m.groupBy(*GROUP).agg(p.alias("_b"))
    band = F.when(F.col("mag") < F.col("_b")[0], F.lit(-1.0)).when(F.col("mag") > F.col("_b")[1], F.lit(float("inf"))).otherwise(F.col("mag"))
    counts = m.join(bracket, GROUP).groupBy(*GROUP, band.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*GROUP)
    ranked = counts.withColumn("_cum", F.sum("_c").over(w.orderBy("_v"))).withColumn("n", F.sum("_c").over(w))
    at = lambda r: F.min(F.when(F.col("_cum") > r, F.col("_v")))
    mid = ranked.groupBy(*GROUP).agg(F.first("n").alias("n"), at(F.floor((F.col("n") - 1) / 2)).alias("_a"), at(F.ceil((F.col("n") - 1) / 2)).alias("_z"))
    return mid.select(*GROUP, "n", ((F.col("_a") + F.col("_z")) / 2).alias("median"))


#: Error variance of the shape per excess in its last quarter, over the variance that shapes have among sources.
SHRINK, MOST_SHAPE = 80, 0.5


def _season() -> Column:
    return F.coalesce(F.month("day"), F.lit(0)).alias("month")


def _reach(start: Column, half: Column, quarter: Column, n: Column, rules: Rules) -> Column:
    """Distance of the cutoff from the centre, from the residuals that p, p / 2 and p / 4 of the readings pass; null without a tail."""
    p = 1 - rules.tail
    first, second, k = half - start, quarter - half, n * (p / 4)
    shape = F.log2(second / F.when(first > 0, first)) * k / (k + SHRINK)
    xi = F.greatest(F.lit(-MOST_SHAPE), F.least(F.lit(MOST_SHAPE), shape))
    y = rules.risk / p
    flat = -first / math.log(2) * math.log(y)
    curved = first / (F.pow(F.lit(2.0), xi) - 1) * (F.pow(F.lit(y), -xi) - 1)
    return F.when((first > 0) & (second > 0), start + F.when(F.abs(xi) < 1e-6, flat).otherwise(curved))


def tail_cutoffs(readings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(source, field, month, centre, upper, lower, median, top, bottom, top_by, bottom_by): one row per cell.

    ``upper`` and ``lower`` are the fitted distances of log10 magnitude from ``centre``;
    readings beyond ``top`` or below ``bottom`` are looked at, ``*_by`` says whether these
    come from the fit or from the plausibility bound.
    """
    p = 1 - rules.tail
    m = _measured(readings).select(*GROUP, _season(), F.log10("mag").alias("lg"))
    # a row per cell, stored because three joins read it: its two passes over the readings would run for each
    season = stored(quantiles(m, [*GROUP, "month"], "lg", [0.5], "_c").select(*GROUP, "month", F.col("_c")[0].alias("centre")), "season-medians")
    res = m.join(season, [*GROUP, "month"]).select(*GROUP, (F.col("lg") - F.col("centre")).alias("r"))
    q = quantiles(res, GROUP, "r", [p / 4, p / 2, p, 1 - p, 1 - p / 2, 1 - p / 4], "_q")
    at = lambda i: F.col("_q")[i]
    fit = q.select(*GROUP, _reach(at(3), at(4), at(5), F.col("n"), rules).alias("upper"), _reach(-at(2), -at(1), -at(0), F.col("n"), rules).alias("lower"))
    cells = season.join(fit, GROUP).join(exact_medians(readings).drop("n"), GROUP)
    centre, limit = F.col("centre"), math.log10(rules.max_ratio) - 1e-9
    high, low = F.log10("median") + limit, F.log10("median") - limit
    by = lambda seen: F.when(seen, F.lit("fit")).otherwise(F.lit("plausibility"))
    return cells.withColumns({
        "top": F.least(centre + F.col("upper"), high), "top_by": by(centre + F.col("upper") <= high),
        "bottom": F.greatest(centre - F.col("lower"), low), "bottom_by": by(centre - F.col("lower") >= low),
    })


def frozen(readings: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(source, field, value, day): days on which a value counts as frozen."""
    g = [*GROUP, "value"]
    m = _measured(readings).where(F.col("day").isNotNull() & F.col("unit").isNotNull()).select(*g, "day", "unit")
    repeated = m.groupBy(*g).agg(F.min("unit").alias("_lo"), F.max("unit").alias("_hi")).where(F.col("_lo") < F.col("_hi")).select(*g)
    days = m.join(repeated, g, "left_semi").distinct()
    first = Window.partitionBy(*g, "day").orderBy("unit")
    daily = (
        days.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= rules.min_units)
        .groupBy(*g, "day").agg(F.collect_set("unit").alias("units"))
    )
    width = rules.span_days + 1
    b = F.floor(F.unix_date("day") / F.lit(width)).cast("int")
    pair = daily.withColumn("_b", F.explode(F.array(b, b - 1))).groupBy(*g, "_b").agg(F.sort_array(F.collect_list(F.struct("day", "units"))).alias("d"))
    # at most 2 * width days with at most min_units units each
    span = lambda s: F.filter("d", lambda x: (x.day >= s) & (F.datediff(x.day, s) <= rules.span_days))
    enough = lambda xs: F.size(F.array_distinct(F.flatten(F.transform(xs, lambda x: x.units)))) >= rules.min_units
    hits = F.flatten(F.transform(F.col("d"), lambda s: F.when(enough(span(s.day)), F.transform(span(s.day), lambda x: x.day)).otherwise(F.array().cast("array<date>"))))
    return pair.where(enough(F.col("d"))).select(*g, F.explode(F.array_distinct(hits)).alias("day")).distinct()


def flag(readings: DataFrame, id_cols: list[str], rules: Rules = Rules(), low_fields: tuple[str, ...] = ()) -> DataFrame:
    """Every reading that breaks a rule: impossible, tail, ratio, frozen (booleans) and found_by.

    ``readings`` has source, field, value, day, unit, ``id_cols`` and optionally a boolean
    ``out_of_bounds``. ``low_fields`` are those whose readings may also be too small.
    """
    v, bad = F.col("value"), F.col("out_of_bounds") if "out_of_bounds" in readings.columns else F.lit(False)
    small = F.col("field").isin(*low_fields) if low_fields else F.lit(False)
    finite_nonzero = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)
    lg = F.log10(F.when(finite_nonzero, F.abs(v)))
    above = (lg > F.col("top")) & (F.abs(v) > rules.max_ratio * F.col("median"))
    below = small & (lg < F.col("bottom")) & (F.abs(v) < F.col("median") / rules.max_ratio)
    tail = (lg - F.col("centre") > F.col("upper")) | (small & (F.col("centre") - lg > F.col("lower")))
    stuck = frozen(readings, rules).withColumn("_stuck", F.lit(True))
    sure = lambda c: F.coalesce(c, F.lit(False))
    out = (
        readings.where(v.isNotNull())
        .withColumn("month", _season())
        .join(tail_cutoffs(readings, rules), [*GROUP, "month"], "left")
        .join(stuck, [*GROUP, "value", "day"], "left")
        .withColumns({"impossible": sure(bad) | F.isnan(v) | (F.abs(v) == float("inf")), "tail": sure(tail), "frozen": sure(F.col("_stuck"))})
        .withColumn("_ratio_by", F.when(above, F.col("top_by")).when(below, F.col("bottom_by")))
        .withColumn("ratio", F.col("_ratio_by").isNotNull())
        .withColumn("found_by", F.when(F.col("impossible"), "impossible").otherwise(F.coalesce("_ratio_by", F.when(F.col("frozen"), F.lit("frozen")))))
    )
    return out.where(F.col("tail") | F.col("found_by").isNotNull()).select(*id_cols, *GROUP, "value", "day", "impossible", "tail", "ratio", "frozen", "found_by")
