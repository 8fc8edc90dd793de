"""Queries of windows, signals, returns, rank statistics and portfolios, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import exprs as x
from tidemark.materialize import stored
from tidemark.operators import bars, ic, portfolio
from tidemark.operators.quantiles import bucket, winsorize
from tidemark.operators.ranks import SignalSpec, blend, composite, p_value, percentile_rank, spearman
from tidemark.plans import event_sql as q
from tidemark.plans import event_tables as t
from tidemark.plans import phases

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY = t.KEY
SIGNALS = ["alpha_ratio", "moat_index", "ceiling_change_pct_of_mcap", "relative_ceiling_change"]
RETURNS = {20: "industry_excess_return_20d", 60: "industry_excess_return_60d"}
CLASSES = ["NEW_AWARD", "NEW_DELIVERY_ORDER", "MAJOR_EXPANSION", "MODERATE_EXPANSION", "MINOR_EXPANSION", "CONTRACTION"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounded, and no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def r(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


# signals

_RATIOS = ["contract_duration_years", "remaining_contract_length_years", "obligation_ratio", "moat_index", "ceiling_change_log_dollars", "relative_ceiling_change"]


@query(f"WITH {q.SIGNALS} SELECT contract_transaction_unique_key, duration_days, is_primary_action, {r(_RATIOS)}, round(alpha_ratio, 9) AS alpha_ratio, round(ceiling_change_pct_of_mcap, 9) AS ceiling_change_pct_of_mcap, round(contract_potential_yield, 9) AS contract_potential_yield, round(acv_alpha_ratio, 9) AS acv_alpha_ratio, round(acv_signal, 0) AS acv_signal, round(difference_between_obligated_and_potential, 0) AS difference_between_obligated_and_potential FROM signals")
def ratio_signals(spark: SparkSession, d: str) -> DataFrame:
    s = phases.ratio_signals(t.base(spark, d))
    s = rounded(rounded(s, *_RATIOS), "alpha_ratio", "ceiling_change_pct_of_mcap", "contract_potential_yield", "acv_alpha_ratio", digits=9)
    s = rounded(s, "acv_signal", "difference_between_obligated_and_potential", digits=0)
    return s.select(KEY, "duration_days", "is_primary_action", *_RATIOS, "alpha_ratio", "ceiling_change_pct_of_mcap", "contract_potential_yield", "acv_alpha_ratio", "acv_signal", "difference_between_obligated_and_potential")


@query(f"WITH {q.SIGNALS} SELECT contract_transaction_unique_key, signal_quality, event_class FROM signals")
def signal_quality_tags(spark: SparkSession, d: str) -> DataFrame:
    return t.signal_rows(spark, d).select(KEY, "signal_quality", "event_class")


@query(f"WITH {q.SIGNALS} SELECT is_primary_action, transaction_type, count(*) AS n FROM signals GROUP BY ALL")
def is_primary_action(spark: SparkSession, d: str) -> DataFrame:
    return t.signal_rows(spark, d).groupBy("is_primary_action", "transaction_type").agg(F.count("*").alias("n"))


@query(f"WITH {q.SIGNALS} SELECT coalesce(sector, 'UNKNOWN') AS sector_name, count(*) FILTER (contains(signal_quality, 'extreme_ratio')) AS n_extreme, count(*) AS n FROM signals GROUP BY ALL")
def sector_p99_flag(spark: SparkSession, d: str) -> DataFrame:
    s = t.signal_rows(spark, d)
    return s.groupBy(F.coalesce("sector", F.lit("UNKNOWN")).alias("sector_name")).agg(F.count_if(F.col("signal_quality").contains("extreme_ratio")).alias("n_extreme"), F.count("*").alias("n"))


_COVER = ["alpha_ratio", "moat_index", "obligation_ratio", "relative_ceiling_change", "ceiling_change_pct_of_mcap"]


@query(f"WITH {q.SIGNALS} " + " UNION ALL ".join(f"SELECT '{c}' AS signal, count({c}) AS n, round(100.0 * count({c}) / count(*), 2) AS pct FROM signals" for c in _COVER))
def signal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ic.coverage(t.signal_rows(spark, d), _COVER)


# bars and returns

_RET = [f"return_{h}d" for h in t.HORIZONS]


@query(f"WITH {q.BARS} SELECT ticker, date, {r(_RET)} FROM rets")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars.forward_returns(t.daily_bars(spark, d), t.HORIZONS), *_RET).select("ticker", "date", *_RET)


@query(f"WITH {q.BARS} SELECT ticker, date, round(close_adj / nullif(lag(close_adj) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 6) AS ret_back_1d FROM bars")
def pct_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars.changes(t.daily_bars(spark, d)), "ret_back_1d").select("ticker", "date", "ret_back_1d")


_EXCESS = [f"{p}_return_{h}d" for h in t.HORIZONS for p in ("excess", "industry_excess")]


@query(f"WITH {q.VALIDATED} SELECT contract_transaction_unique_key, reference_trading_date, fiscal_quarter, industry_benchmark_ticker, {r(_RET + _EXCESS)} FROM validated")
def excess_returns(spark: SparkSession, d: str) -> DataFrame:
    v = rounded(t.validated(spark, d), *_RET, *_EXCESS)
    return v.select(KEY, "reference_trading_date", "fiscal_quarter", "industry_benchmark_ticker", *_RET, *_EXCESS)


@query(f"WITH {q.VALIDATED} " + " UNION ALL ".join(f"SELECT {h} AS horizon, count(return_{h}d) AS n FROM validated" for h in t.HORIZONS))
def horizon_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d").alias("v")) for h in t.HORIZONS])
    return t.validated(spark, d).select(F.explode(cells).alias("c")).groupBy("c.horizon").agg(F.count("c.v").alias("n"))


# ranks, buckets, clipping

_PRANK = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / (count({c}) OVER () + 1) END"


@query(f"WITH {q.SIGNALS} SELECT contract_transaction_unique_key, round({_PRANK.format(c='relative_ceiling_change')}, 6) AS p_up, round(1 - {_PRANK.format(c='moat_index')}, 6) AS p_down FROM signals")
def percentile_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = t.signal_rows(spark, d).select(KEY, "relative_ceiling_change", "moat_index")
    s = percentile_rank(percentile_rank(s, "relative_ceiling_change", "p_up"), "moat_index", "p_down", flip=True)
    return rounded(s, "p_up", "p_down").select(KEY, "p_up", "p_down")


_PARTS = f"parts AS (SELECT contract_transaction_unique_key, {_PRANK.format(c='ceiling_change_pct_of_mcap')} AS a, 1 - {_PRANK.format(c='moat_index')} AS b FROM signals)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    s = t.signal_rows(spark, d).select(KEY, "ceiling_change_pct_of_mcap", "moat_index")
    return percentile_rank(percentile_rank(s, "ceiling_change_pct_of_mcap", "a"), "moat_index", "b", flip=True)


@query(f"WITH {q.SIGNALS}, {_PARTS} SELECT contract_transaction_unique_key, round((a * 2 + b * 1) / 3, 6) AS score FROM parts")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(KEY, F.round(composite([(F.col("a"), 2.0), (F.col("b"), 1.0)]), 6).alias("score"))


@query(f"WITH {q.SIGNALS}, {_PARTS} SELECT contract_transaction_unique_key, round((coalesce(a * 2, 0) + coalesce(b * 1, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END, 0), 6) AS score FROM parts")
def composite_partial(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(KEY, F.round(composite([(F.col("a"), 2.0), (F.col("b"), 1.0)], partial=True), 6).alias("score"))


@query(f"WITH {q.SIGNALS}, {q.qcut('signals', 'relative_ceiling_change', 'event_class')} SELECT contract_transaction_unique_key, event_class, bucket FROM cut")
def qcut_deciles(spark: SparkSession, d: str) -> DataFrame:
    return bucket(t.signal_rows(spark, d).select(KEY, "event_class", "relative_ceiling_change"), ["event_class"], "relative_ceiling_change").select(KEY, "event_class", "bucket")


@query(f"WITH {q.SIGNALS}, b AS (SELECT event_class, quantile_cont(relative_ceiling_change, 0.01) AS lo, quantile_cont(relative_ceiling_change, 0.99) AS hi, count(relative_ceiling_change) AS n FROM signals GROUP BY 1) SELECT contract_transaction_unique_key, round(CASE WHEN n >= 5 AND relative_ceiling_change IS NOT NULL THEN least(greatest(relative_ceiling_change, lo), hi) ELSE relative_ceiling_change END, 6) AS clipped FROM signals JOIN b USING (event_class)")
def winsorize_by_class(spark: SparkSession, d: str) -> DataFrame:
    w = winsorize(t.signal_rows(spark, d).select(KEY, "event_class", "relative_ceiling_change"), ["event_class"], "relative_ceiling_change")
    return rounded(w, "clipped").select(KEY, "clipped")


_PNL = "v AS (SELECT * FROM validated WHERE alpha_ratio IS NOT NULL AND return_20d IS NOT NULL AND reference_trading_date IS NOT NULL), "


def _pnl_sql(short: str) -> str:
    return (
        f"WITH {q.VALIDATED}, {_PNL} {q.qcut('v', 'alpha_ratio')}, ends AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM cut), "
        f"daily AS (SELECT reference_trading_date, avg(CASE WHEN bucket = hi THEN return_20d {short} ELSE 0 END) AS r FROM cut, ends WHERE lo < hi GROUP BY 1) "
        "SELECT reference_trading_date, round(sum(r) OVER (ORDER BY reference_trading_date), 6) AS pnl FROM daily"
    )


@query(_pnl_sql(""))
def cumulative_pnl_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.cumulative_pnl(t.validated(spark, d), "alpha_ratio", "return_20d", "reference_trading_date"), "pnl")


@query(_pnl_sql("WHEN bucket = lo THEN -return_20d"))
def cumulative_pnl_long_short(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.cumulative_pnl(t.validated(spark, d), "alpha_ratio", "return_20d", "reference_trading_date", "long_short"), "pnl")


# rank correlations


def _ic(keep: str, by: str, where: str = "TRUE", least: int = 3, signals: list[str] = SIGNALS, returns: dict[int, str] = RETURNS, tail: str = "") -> str:
    source = f"(SELECT *, {keep} FROM validated WHERE {where})" if keep else f"(SELECT * FROM validated WHERE {where})"
    seg = keep.split(" AS ")[-1] if keep else ""
    return f"WITH {q.VALIDATED}, {q.ic(q.cells(source, seg, signals, returns), by)} SELECT * FROM ics WHERE n >= {least} {tail}"


@query(_ic("", "signal, horizon"))
def ic_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ic.ic_table(t.validated(spark, d), None, SIGNALS, RETURNS), "ic")


@query(_ic("coalesce(sector, 'UNKNOWN') AS segment", "segment, signal, horizon", least=30))
def ic_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ic.ic_table(t.validated(spark, d), F.col("sector"), SIGNALS, RETURNS, 30), "ic")


@query(_ic("coalesce(transaction_type, '(NULL)') AS segment", "segment, signal, horizon", least=20))
def ic_by_transaction_type(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ic.ic_table(t.validated(spark, d), F.col("transaction_type"), SIGNALS, RETURNS, 20, "(NULL)"), "ic").orderBy(F.desc("n"))


@query(_ic("substr(fiscal_quarter, 1, 4) AS segment", "segment, signal, horizon"))
def ic_by_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ic.ic_table(t.validated(spark, d), F.substring("fiscal_quarter", 1, 4), SIGNALS, RETURNS), "ic")


_ALL = {h: f"excess_return_{h}d" for h in t.HORIZONS}
_SUMMED = [*t.MEASURES]
_SUMMARY = (
    f"WITH {q.VALIDATED}, {q.ic(q.cells('validated', '', _SUMMED, _ALL), 'signal, horizon')}, m AS (SELECT *, signal || ' ' || horizon AS cell FROM cells), {q.qcut('m', 'x', 'cell')}, "
    "b AS (SELECT signal, horizon, bucket, avg(y) AS mean FROM cut WHERE bucket IS NOT NULL GROUP BY ALL), "
    "spread AS (SELECT signal, horizon, CASE WHEN max(bucket) > min(bucket) THEN round(max_by(mean, bucket) - min_by(mean, bucket), 6) + 0.0 END AS top_minus_bottom FROM b GROUP BY ALL), "
    "summary AS (SELECT i.*, top_minus_bottom FROM ics i LEFT JOIN spread USING (signal, horizon))"
)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ic.summary(t.measured(spark, d), _SUMMED, _ALL), "ic", "top_minus_bottom")


@query(f"{_SUMMARY} SELECT * FROM summary")
def ic_summary_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)


def _population(name: str, condition: str) -> str:
    both = f"(SELECT *, 'all' AS segment FROM validated UNION ALL SELECT *, '{name}' AS segment FROM validated WHERE {condition})"
    return f"WITH {q.VALIDATED}, {q.ic(q.cells(both, 'segment', SIGNALS, RETURNS), 'segment, signal, horizon')} SELECT * FROM ics"


def _populations(v: DataFrame, name: str, condition) -> DataFrame:
    tags = F.when(condition, F.array(F.lit("all"), F.lit(name))).otherwise(F.array(F.lit("all")))
    return rounded(ic.ic_table(v.withColumn("population", F.explode(tags)), F.col("population"), SIGNALS, RETURNS), "ic")


@query(_population("primary", "is_primary_action"))
def primary_vs_all_ic(spark: SparkSession, d: str) -> DataFrame:
    return _populations(t.validated(spark, d), "primary", F.col("is_primary_action"))


@query(_population("ok", "signal_quality = 'ok'"))
def quality_vs_all_ic(spark: SparkSession, d: str) -> DataFrame:
    return _populations(t.validated(spark, d), "ok", F.col("signal_quality") == "ok")


def _two(source: str, part: str, signals: list[str], returns: dict[int, str]) -> str:
    """Correlations of segments (ics) and of their parts (ics2), and how many parts share the sign of the whole (cells3)."""
    parts = q.ic(q.cells(f"(SELECT *, {part} AS part FROM {source} WHERE {part} NOT IN ('UNKN', 'UNKNOWN'))", "segment, part", signals, returns), "segment, part, signal, horizon")
    return (
        q.ic(q.cells(source, "segment", signals, returns), "segment, signal, horizon") + ", " + parts.replace("cells", "cells2").replace("ranked", "ranked2").replace("ics", "ics2")
        + ", g AS (SELECT segment, signal, horizon, count(ic) AS n_parts, count(*) FILTER (ic > 0) AS up, count(*) FILTER (ic < 0) AS down FROM ics2 GROUP BY ALL), "
        "cells3 AS (SELECT segment, signal, horizon, n, ic, coalesce(n_parts, 0) AS n_parts, coalesce(CASE WHEN ic > 0 THEN up WHEN ic < 0 THEN down END, 0) AS same_sign FROM ics LEFT JOIN g USING (segment, signal, horizon))"
    )


_INDUSTRY = "v AS (SELECT *, industry AS segment FROM validated WHERE industry IS NOT NULL AND industry IN (SELECT industry FROM validated GROUP BY 1 HAVING count(*) >= 200))"
_QUARTERS = "CASE WHEN (SELECT count(DISTINCT fiscal_quarter) FROM validated WHERE fiscal_quarter <> 'UNKNOWN') >= 4 THEN 3 ELSE greatest(1, round_even(0.75 * (SELECT count(DISTINCT fiscal_quarter) FROM validated WHERE fiscal_quarter <> 'UNKNOWN'), 0)) END"
_STABLE = f"WITH {q.VALIDATED}, {_INDUSTRY}, {_two('v', 'fiscal_quarter', SIGNALS, RETURNS)}, kept AS (SELECT * FROM cells3 WHERE abs(ic) >= 0.02 AND same_sign >= {_QUARTERS})"


def _stable(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Industries of at least 200 rows: their stable cells, and the correlations of all their quarters."""
    v = t.validated(spark, d)
    large = v.where(F.col("industry").isNotNull()).groupBy("industry").agg(F.count("*").alias("_n")).where("_n >= 200").select("industry")
    rows = v.join(F.broadcast(large), "industry")  # a row per industry
    quarter = F.when(F.col("fiscal_quarter") != "UNKNOWN", F.col("fiscal_quarter"))
    overall, parts = rounded(ic.ic_table(rows, F.col("industry"), SIGNALS, RETURNS), "ic"), rounded(ic.part_table(rows, "industry", quarter, SIGNALS, RETURNS), "ic")
    needed = v.agg(F.countDistinct(quarter).alias("_q")).select(ic.parts_needed(F.col("_q")).alias("_needed"))
    cells = ic.same_sign(overall, parts).join(F.broadcast(needed), F.lit(True))  # one row
    return cells.where((F.abs("ic") >= 0.02) & (F.col("same_sign") >= F.col("_needed"))).drop("_needed"), parts


@query(f"{_STABLE} SELECT * FROM kept")
def stability_filter(spark: SparkSession, d: str) -> DataFrame:
    return _stable(spark, d)[0]


@query(f"{_STABLE} SELECT segment, signal, horizon, part AS fiscal_quarter, i.n, i.ic FROM ics2 i SEMI JOIN kept USING (segment, signal, horizon)")
def stability_quarters(spark: SparkSession, d: str) -> DataFrame:
    kept, parts = _stable(spark, d)
    return parts.join(kept, ic.CELL, "left_semi").withColumnRenamed("part", "fiscal_quarter")


_EVENT_SIGNALS = ["alpha_ratio", "acv_alpha_ratio", "contract_potential_yield", "moat_index", "difference_between_obligated_and_potential"]
_MAGNITUDES = ["ceiling_change_log_dollars", "ceiling_change_pct_of_mcap", "relative_ceiling_change"]
_EVENT_RETURNS = {h: f"industry_excess_return_{h}d" for h in (5, 20, 60, 120, 180)}
_IN_CLASSES = "event_class IN (" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
_YEAR = "substr(fiscal_quarter, 1, 4)"


def _event_sql(signals: list[str]) -> str:
    return f"WITH {q.VALIDATED}, v AS (SELECT *, event_class AS segment FROM validated WHERE {_IN_CLASSES}), {_two('v', _YEAR, signals, _EVENT_RETURNS)}"


def _event_cells(spark: SparkSession, d: str, signals: list[str], years_needed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Cells by event class, signal and horizon with ``kept``: |ic| of at least 0.02 and so many years of its sign; and the years' correlations."""
    v = t.validated(spark, d).where(F.col("event_class").isin(CLASSES))
    year = F.substring("fiscal_quarter", 1, 4)
    years = rounded(ic.part_table(v, "event_class", F.when(year != "UNKN", year), signals, _EVENT_RETURNS), "ic")
    cells = ic.same_sign(rounded(ic.ic_table(v, F.col("event_class"), signals, _EVENT_RETURNS), "ic"), years)
    return cells.withColumn("kept", F.coalesce((F.abs("ic") >= 0.02) & (F.col("same_sign") >= years_needed), F.lit(False))), years


_KEPT = "coalesce(abs(ic) >= 0.02 AND same_sign >= 5, FALSE) AS kept"


@query(f"{_event_sql(_EVENT_SIGNALS)} SELECT *, {_KEPT} FROM cells3 WHERE segment IN (SELECT segment FROM v GROUP BY 1 HAVING count(*) >= 100)")
def event_class_ic(spark: SparkSession, d: str) -> DataFrame:
    """Classes of at least 100 rows; the report shows the cells that are kept."""
    large = t.validated(spark, d).groupBy(F.col("event_class").alias("segment")).agg(F.count("*").alias("_n")).where("_n >= 100").select("segment")
    return _event_cells(spark, d, _EVENT_SIGNALS)[0].join(F.broadcast(large), "segment", "left_semi")  # a row per class


@query(f"{_event_sql(_EVENT_SIGNALS)} SELECT segment, signal, horizon, part AS fiscal_year, n, ic FROM ics2")
def event_class_year_ic(spark: SparkSession, d: str) -> DataFrame:
    return _event_cells(spark, d, _EVENT_SIGNALS)[1].withColumnRenamed("part", "fiscal_year")


_FILLED = " UNION ALL ".join(f"SELECT segment, '{m}' AS signal FROM v GROUP BY 1 HAVING count({m}) >= 100" for m in _MAGNITUDES)


@query(f"{_event_sql(_MAGNITUDES)}, filled AS ({_FILLED}) SELECT *, {_KEPT} FROM cells3 SEMI JOIN filled USING (segment, signal)")
def event_magnitude_ic(spark: SparkSession, d: str) -> DataFrame:
    """Classes in which at least 100 rows have the measure."""
    counts = t.validated(spark, d).groupBy(F.col("event_class").alias("segment")).agg(*[F.count(m).alias(m) for m in _MAGNITUDES])
    filled = counts.unpivot("segment", _MAGNITUDES, "signal", "_n").where("_n >= 100").select("segment", "signal")
    return _event_cells(spark, d, _MAGNITUDES)[0].join(F.broadcast(filled), ["segment", "signal"], "left_semi")


_CRITERIA = {"weak": "abs(ic) >= 0.02", "strong": "abs(ic) >= 0.05", "weak with spread": "abs(ic) >= 0.02 AND abs(top_minus_bottom) >= 0.005"}


@query(f"{_SUMMARY} " + " UNION ALL ".join(f"SELECT '{k}' AS criterion, * FROM summary WHERE {c}" for k, c in _CRITERIA.items()))
def decision_criteria(spark: SparkSession, d: str) -> DataFrame:
    met = F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in _CRITERIA.items()])
    return _summary(spark, d).withColumn("criterion", F.explode(F.array_compact(met)))


_PAIRS = [("ceiling_change_pct_of_mcap", "moat_index"), ("ceiling_change_pct_of_mcap", "relative_ceiling_change"), ("moat_index", "relative_ceiling_change")]
_COMPLETE = "(SELECT * FROM signals WHERE ceiling_change_pct_of_mcap IS NOT NULL AND moat_index IS NOT NULL AND relative_ceiling_change IS NOT NULL)"


@query(f"WITH {q.SIGNALS}, " + q.ic(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM {_COMPLETE}" for a, b in _PAIRS), "a, b") + " SELECT * FROM ics")
def component_correlations(spark: SparkSession, d: str) -> DataFrame:
    s = t.signal_rows(spark, d).dropna(subset=["ceiling_change_pct_of_mcap", "moat_index", "relative_ceiling_change"])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _PAIRS])
    return rounded(spearman(s.select(F.explode(cells).alias("c")).select("c.*"), ["a", "b"], "x", "y"), "ic")


# two-sided p of a rank correlation: the share of the null density (1 - x^2)^((n - 4) / 2) beyond it, by midpoints
_DENSE = "SELECT k + 0.5 AS k FROM (SELECT unnest(generate_series(0, 199999)) AS k)"
_P_VALUE = (
    f"{_ic('', 'signal, horizon')}".replace("SELECT * FROM ics WHERE n >= 3 ", "")
    + f", grid AS ({_DENSE}), mass AS (SELECT signal, horizon, n, ic, (1 - abs(ic)) * sum(pow(1 - pow(abs(ic) + (1 - abs(ic)) * k / 200000, 2), (n - 4) / 2.0)) / sum(pow(1 - pow(k / 200000, 2), (n - 4) / 2.0)) AS p FROM ics, grid GROUP BY signal, horizon, n, ic) "
    "SELECT signal, horizon, n, ic, round(p, 6) + 0.0 AS p FROM mass"
)


@query(_P_VALUE)
def ic_p_value(spark: SparkSession, d: str) -> DataFrame:
    table = ic.ic_table(t.validated(spark, d), None, SIGNALS, RETURNS)
    return rounded(rounded(table, "ic").withColumn("p", p_value(F.col("ic"), F.col("n"))), "p")


# buckets and portfolios

_SPREAD = f"WITH {q.VALIDATED}, v AS (SELECT * FROM validated WHERE alpha_ratio IS NOT NULL AND return_20d IS NOT NULL), {q.qcut('v', 'alpha_ratio')}, b AS (SELECT bucket, count(*) AS n, avg(return_20d) AS mean_return, stddev_samp(return_20d) AS std_return FROM cut WHERE bucket IS NOT NULL GROUP BY 1)"


@query(_SPREAD + " SELECT bucket, n, round(mean_return, 6) AS mean_return, round(std_return, 6) AS std_return FROM b")
def decile_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.bucket_returns(t.validated(spark, d), [], "alpha_ratio", "return_20d"), "mean_return", "std_return")


@query(_SPREAD + " SELECT CASE WHEN max(bucket) > min(bucket) THEN round(max_by(mean_return, bucket) - min_by(mean_return, bucket), 6) END AS top_minus_bottom FROM b")
def top_minus_bottom(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.top_minus_bottom(portfolio.bucket_returns(t.validated(spark, d), [], "alpha_ratio", "return_20d"), []), "top_minus_bottom")


_CLASS_LIST = ", ".join(f"'{c}'" for c in CLASSES)


def _traded(v: str, signal: str, ret: str = "return_20d") -> str:
    """Trades of the buckets of the relation ``v``, which has a column variant."""
    return f"""v AS ({v}), {q.qcut("v", signal, "variant")}, topped AS (SELECT *, max(bucket) OVER (PARTITION BY variant) AS hi FROM cut),
sided AS (SELECT *, CASE WHEN bucket = hi THEN 'long' WHEN bucket = 1 THEN 'short' END AS side FROM topped WHERE hi >= 2),
trades AS (SELECT variant, reference_trading_date, substr(fiscal_quarter, 1, 4) AS fiscal_year, ticker, side, {signal} AS signal_value,
  CASE side WHEN 'long' THEN {ret} ELSE -{ret} END AS gross_return, CASE side WHEN 'long' THEN {ret} ELSE -{ret} END - 0.0015 AS net_return,
  CASE side WHEN 'long' THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY variant, side) AS weight FROM sided WHERE side IS NOT NULL)"""


def _in_class(signal: str, source: str = "validated", ret: str = "return_20d") -> str:
    return _traded(f"SELECT *, event_class AS variant FROM {source} WHERE event_class IN ({_CLASS_LIST}) AND {signal} IS NOT NULL AND {ret} IS NOT NULL", signal, ret)


_MONEY = ["signal_value", "gross_return", "net_return", "weight"]
_TRADE_OUT = f"SELECT variant, reference_trading_date, fiscal_year, ticker, side, round(signal_value, 9) AS signal_value, {r(_MONEY[1:], 9)} FROM trades"


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Kept, since every summary reads them: once for all years and once by year."""
    return t.kept(spark, d, "in-class-trades", lambda: portfolio.in_class_trades(t.validated(spark, d), "ceiling_change_pct_of_mcap", "return_20d", "event_class", CLASSES))


@query(f"WITH {q.VALIDATED}, {_in_class('ceiling_change_pct_of_mcap')} {_TRADE_OUT}")
def in_class_trades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_trades(spark, d), *_MONEY, digits=9)


_CROSS = """trades AS (SELECT 'MAJOR_EXPANSION over CONTRACTION' AS variant, reference_trading_date, substr(fiscal_quarter, 1, 4) AS fiscal_year, ticker, side, ceiling_change_pct_of_mcap AS signal_value,
  CASE side WHEN 'long' THEN return_20d ELSE -return_20d END AS gross_return, CASE side WHEN 'long' THEN return_20d ELSE -return_20d END - 0.0015 AS net_return,
  CASE side WHEN 'long' THEN 1.0 ELSE -1.0 END / count(*) OVER (PARTITION BY side) AS weight
  FROM (SELECT *, CASE event_class WHEN 'MAJOR_EXPANSION' THEN 'long' WHEN 'CONTRACTION' THEN 'short' END AS side FROM validated WHERE return_20d IS NOT NULL) WHERE side IS NOT NULL)"""


def _cross(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.cross_class_trades(t.validated(spark, d), "ceiling_change_pct_of_mcap", "return_20d", "event_class", "MAJOR_EXPANSION", "CONTRACTION")


@query(f"WITH {q.VALIDATED}, {_CROSS} {_TRADE_OUT}")
def cross_class_trades(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cross(spark, d), *_MONEY, digits=9)


_STATS = ["gross_mean", "net_mean", "net_stddev", "sharpe", "sortino", "hit_rate", "gross_total", "net_total"]


def _stats(net: str, gross: str, scale: str) -> str:
    return f"""avg({gross}) AS gross_mean, avg({net}) AS net_mean, coalesce(stddev_samp({net}), 0) AS net_stddev, avg({net}) / nullif(stddev_samp({net}), 0) * sqrt({scale}) AS sharpe,
  avg({net}) / nullif(stddev_samp({net}) FILTER ({net} < 0), 0) * sqrt({scale}) AS sortino, avg(CASE WHEN {net} > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum({gross}) AS gross_total, sum({net}) AS net_total"""


_COUNTS = "count(*) AS n_trades, count(*) FILTER (side = 'long') AS n_long, count(*) FILTER (side = 'short') AS n_short"


def _per_trade(by: str, hold: str = "20.0") -> str:
    return f"summary AS (SELECT {by}, {_COUNTS}, {_stats('net_return', 'gross_return', f'252 / {hold}')}, count(*) AS n_periods FROM trades GROUP BY {by})"


def _summary_out(by: str) -> str:
    return f"SELECT {by}, n_trades, n_long, n_short, n_periods, {r(_STATS)} FROM summary"


@query(f"WITH {q.VALIDATED}, {_in_class('ceiling_change_pct_of_mcap')}, {_per_trade('variant')} {_summary_out('variant')}")
def summary_per_trade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.summary_per_trade(_trades(spark, d)), *_STATS)


_MONTHLY = f"""months AS (SELECT variant, date_trunc('month', reference_trading_date) AS month,
  coalesce(avg(net_return) FILTER (side = 'long'), 0) + coalesce(avg(net_return) FILTER (side = 'short'), 0) AS net,
  coalesce(avg(gross_return) FILTER (side = 'long'), 0) + coalesce(avg(gross_return) FILTER (side = 'short'), 0) AS gross
  FROM trades WHERE reference_trading_date IS NOT NULL GROUP BY 1, 2),
summary AS (SELECT * FROM (SELECT variant, {_COUNTS} FROM trades GROUP BY 1) JOIN (SELECT variant, count(*) AS n_periods, {_stats("net", "gross", "12")} FROM months GROUP BY 1) USING (variant))"""


@query(f"WITH {q.VALIDATED}, {_CROSS}, {_MONTHLY} {_summary_out('variant')}")
def summary_monthly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.summary_monthly(_cross(spark, d)), *_STATS)


@query(f"WITH {q.VALIDATED}, {_in_class('ceiling_change_pct_of_mcap')}, {_per_trade('variant, fiscal_year')} {_summary_out('variant, fiscal_year')}")
def summary_by_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.summary_per_trade(_trades(spark, d), ["variant", "fiscal_year"]), *_STATS)


_SAME = "years AS (SELECT variant, count(net_mean) AS n_years, count(*) FILTER (net_mean > 0) AS n_positive, count(*) FILTER (net_mean < 0) AS n_negative, count(*) FILTER (net_mean = 0) AS n_zero FROM by_year GROUP BY 1)"
_VARIANT_OUT = ["variant", "n_trades", "gross_mean", "net_mean", "net_stddev", "sharpe", "hit_rate", "n_years", "n_positive", "n_negative", "pass_sharpe", "pass_years", "passes"]
_VARIANT_STATS = ["gross_mean", "net_mean", "net_stddev", "sharpe", "hit_rate"]


def _years(hold: str = "20.0") -> str:
    return f"{_per_trade('variant, fiscal_year', hold).replace('summary AS', 'by_year AS')}, {_SAME}"


def _variants(trades: str, hold: str = "20.0") -> str:
    """Summary rows of variants with their pass flags: a Sharpe ratio of 0.5, five years of one sign."""
    return (
        f"{trades}, {_years(hold)}, {_per_trade('variant', hold)} SELECT variant, n_trades, {r(_VARIANT_STATS)}, n_years, n_positive, n_negative, coalesce(sharpe >= 0.5, FALSE) AS pass_sharpe, "
        "greatest(n_positive, n_negative) >= 5 AS pass_years, coalesce(sharpe >= 0.5, FALSE) AND greatest(n_positive, n_negative) >= 5 AS passes FROM summary JOIN years USING (variant)"
    )


def _variant_table(trades: DataFrame, hold=20) -> DataFrame:
    years = portfolio.same_sign(portfolio.summary_per_trade(trades, ["variant", "fiscal_year"], hold))
    return rounded(portfolio.variant_rows(portfolio.summary_per_trade(trades, hold_days=hold), years), *_VARIANT_STATS).select(*_VARIANT_OUT)


@query(f"WITH {q.VALIDATED}, {_in_class('ceiling_change_pct_of_mcap')}, {_years()} SELECT * FROM years")
def same_sign_years(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.same_sign(portfolio.summary_per_trade(_trades(spark, d), ["variant", "fiscal_year"]))


@query(f"WITH {q.VALIDATED}, {_variants(_in_class('ceiling_change_pct_of_mcap'))}")
def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _variant_table(_trades(spark, d))


_LIMITS = [5e7, 1e8, 2e8, 5e8, 1e9]
_MAJOR = "SELECT *, 'above ' || CAST(CAST(major_limit AS BIGINT) AS VARCHAR) AS variant FROM validated, (SELECT unnest([5e7, 1e8, 2e8, 5e8, 1e9]) AS major_limit) WHERE transaction_type = 'FUNDING_INCREASE' AND ceiling_change > major_limit"
_SWEPT = ("ceiling_change_pct_of_mcap", "industry_excess_return_20d")


def _swept(spark: SparkSession, d: str) -> DataFrame:
    """Major expansions at every limit: each limit is a variant."""
    v = t.validated(spark, d).withColumn("_limit", F.explode(F.array(*[F.lit(x) for x in _LIMITS])))
    v = v.where(phases.event_class(F.col("_limit")) == "MAJOR_EXPANSION")
    return v.withColumn("variant", F.concat(F.lit("above "), F.col("_limit").cast("long").cast("string")))


@query(f"WITH {q.VALIDATED}, {_variants(_traded(f'SELECT * FROM ({_MAJOR}) WHERE {_SWEPT[0]} IS NOT NULL AND {_SWEPT[1]} IS NOT NULL', *_SWEPT))}")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _variant_table(stored(portfolio.bucket_trades(_swept(spark, d), *_SWEPT), "sweep-trades"))


@query(f"WITH {q.VALIDATED} SELECT variant, count(*) AS n_qualified FROM ({_MAJOR}) GROUP BY 1")
def threshold_sweep_rows(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d).groupBy("variant").agg(F.count("*").alias("n_qualified"))


_SPECS = [SignalSpec("ceiling_change_pct_of_mcap", "asc", 1.0), SignalSpec("moat_index", "desc", 1.0)]
_BLENDED = {"composite": "blend", "pct_of_mcap": "ceiling_change_pct_of_mcap", "moat_index": "moat_index"}
_BLEND = f"blended AS (SELECT *, ({_PRANK.format(c='ceiling_change_pct_of_mcap')} + 1 - {_PRANK.format(c='moat_index')}) / 2 AS blend FROM validated WHERE event_class = 'MAJOR_EXPANSION')"
_BLEND_ROWS = " UNION ALL ".join(
    f"SELECT *, '{n}-T{h}' AS variant, CAST({c} AS DOUBLE) AS x, industry_excess_return_{h}d AS y FROM blended WHERE {c} IS NOT NULL AND industry_excess_return_{h}d IS NOT NULL" for h in (20, 120) for n, c in _BLENDED.items()
)
_HOLD = "(CASE WHEN ends_with(variant, 'T120') THEN 120.0 ELSE 20.0 END)"


@query(f"WITH {q.VALIDATED}, {_BLEND}, {_variants(_traded(_BLEND_ROWS, 'x', 'y'), _HOLD)}")
def blend_variants(spark: SparkSession, d: str) -> DataFrame:
    """Three signals by two holding periods within major expansions; the composite is ranked within the class."""
    v = t.validated(spark, d).where("event_class = 'MAJOR_EXPANSION'").select("reference_trading_date", "fiscal_quarter", "ticker", "ceiling_change_pct_of_mcap", "moat_index", *[f"industry_excess_return_{h}d" for h in (20, 120)])
    v = stored(blend(v, _SPECS, "blend"), "blended")
    cells = [F.struct(F.lit(f"{n}-T{h}").alias("variant"), F.col(c).cast("double").alias("x"), F.col(f"industry_excess_return_{h}d").alias("y")) for h in (20, 120) for n, c in _BLENDED.items()]
    rows = v.select("reference_trading_date", "fiscal_quarter", "ticker", F.explode(F.array(*cells)).alias("_c")).select("*", "_c.*").drop("_c")
    return _variant_table(stored(portfolio.bucket_trades(rows, "x", "y"), "blend-trades"), F.when(F.col("variant").endswith("T120"), 120.0).otherwise(20.0))


_CLIPPED = (
    "bounds AS (SELECT event_class, quantile_cont(relative_ceiling_change, 0.01) AS lo, quantile_cont(relative_ceiling_change, 0.99) AS hi, count(relative_ceiling_change) AS n FROM validated GROUP BY 1), "
    "clipped AS (SELECT v.* EXCLUDE (relative_ceiling_change), CASE WHEN n >= 5 AND relative_ceiling_change IS NOT NULL THEN least(greatest(relative_ceiling_change, lo), hi) ELSE relative_ceiling_change END AS relative_ceiling_change FROM validated v JOIN bounds USING (event_class))"
)


@query(f"WITH {q.VALIDATED}, {_CLIPPED}, " + _in_class("relative_ceiling_change", "clipped").replace(f"IN ({_CLASS_LIST})", "= 'MINOR_EXPANSION'") + f", {_per_trade('variant')} {_summary_out('variant')}")
def winsorized_backtest(spark: SparkSession, d: str) -> DataFrame:
    test = portfolio.run_backtest(t.validated(spark, d), "relative_ceiling_change", "return_20d", "event_class", framing="in_class", target_class="MINOR_EXPANSION", winsorized=True)
    return rounded(test.summary, *_STATS)


@query(f"WITH {q.VALIDATED} SELECT ticker, count(*) AS n, round(avg(return_20d), 6) AS mean_return, row_number() OVER (ORDER BY count(*) DESC, ticker) AS place FROM validated GROUP BY ticker")
def ticker_activity(spark: SparkSession, d: str) -> DataFrame:
    g = t.validated(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("return_20d"), 6).alias("mean_return"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ticker")))  # a row per ticker


@query(f"WITH {q.SIGNALS} SELECT fiscal, event_class, n FROM (SELECT {q.FISCAL} AS fiscal, event_class, count(*) AS n FROM signals GROUP BY ALL)")
def event_class_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return t.signal_rows(spark, d).groupBy(x.fiscal_quarter(F.col("action_date")).alias("fiscal"), "event_class").agg(F.count("*").alias("n"))
