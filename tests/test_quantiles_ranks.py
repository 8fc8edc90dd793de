import random
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ic, portfolio, quantiles, ranks


def make(seed, n, kind):
    rng = random.Random(seed)
    value = {"normal": lambda: rng.gauss(0, 1), "tied": lambda: rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, None]), "nulls": lambda: rng.choice([None, float("nan"), rng.random()]), "equal": lambda: 3.0}[kind]
    return [(i, rng.choice(["g", "g", "h", None]), value(), rng.gauss(0, 1)) for i in range(n)]


DDL = "id long, g string, x double, y double"


def pandas_of(rows):
    return pd.DataFrame(rows, columns=["id", "g", "x", "y"]).astype({"x": float, "y": float})


@pytest.mark.parametrize(("kind", "n"), [("normal", 6000), ("normal", 37), ("tied", 9000), ("nulls", 900), ("equal", 50)])
def test_quantiles_and_buckets(spark, kind, n):
    rows = make(n, n, kind)
    df, pdf = spark.createDataFrame(rows, DDL), pandas_of(rows)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: list(r.q) for r in quantiles.quantiles(df, ["g"], "x", probs).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        want = part.x.dropna().quantile(probs).tolist()
        assert got[None if pd.isna(g) else g] == pytest.approx(want, rel=1e-12, abs=1e-12)
    cut = {r.id: r.bucket for r in quantiles.bucket(df.withColumn("bucket", F.lit("clash")), ["g"], "x").collect()}
    for _, part in pdf.groupby("g", dropna=False):
        x = part.x.dropna()
        want = pd.Series(np.nan, part.index)
        if len(x) >= 10:
            want[x.index] = pd.qcut(x, 10, labels=False, duplicates="drop") + 1
        for i, b in zip(part.id, want, strict=True):
            assert cut[i] == (None if pd.isna(b) else b)


def test_winsorize(spark):
    rows = make(3, 5000, "normal") + [(-1, "few", 99.0, 0.0), (-2, None, 1e9, 0.0)]
    got = {r.id: r.clipped for r in quantiles.winsorize(spark.createDataFrame(rows, DDL), ["g"], "x").collect()}
    pdf = pandas_of(rows)
    for g, part in pdf.groupby("g", dropna=False):
        want = part.x if pd.isna(g) or len(part) < 5 else part.x.clip(part.x.quantile(0.01), part.x.quantile(0.99))
        assert [got[i] for i in part.id] == pytest.approx(want.tolist())


@pytest.mark.parametrize("kind", ["normal", "tied", "nulls", "equal"])
def test_percentile_ranks_and_spearman(spark, kind):
    rows = make(8, 1500, kind)
    df, pdf = spark.createDataFrame(rows, DDL), pandas_of(rows)
    got = {r.id: r.p for r in ranks.percentile_rank(df, "x", "p").collect()}
    want = pdf.x.rank(method="average") / (pdf.x.notna().sum() + 1)
    for i, p in zip(pdf.id, want, strict=True):
        assert got[i] is None if pd.isna(p) else got[i] == pytest.approx(p)
    ics = {r.g: (r.n, r.ic) for r in ranks.spearman(df, ["g"], "x", "y").collect()}
    for g, part in pdf.groupby("g", dropna=False):
        part = part.dropna(subset=["x", "y"])
        n, value = ics[None if pd.isna(g) else g]
        assert n == len(part)
        if part.x.nunique() < 2:
            assert value is None
        else:
            assert value == pytest.approx(part.x.rank().corr(part.y.rank()))


def test_p_value(spark):
    df = spark.createDataFrame([(0.0, 20), (0.5, 20), (-0.5, 20), (1.0, 5), (None, 9), (0.3, 2)], "r double, n int")
    got = [r[0] for r in df.select(ranks.p_value(F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == got[2] == pytest.approx(0.024769, abs=1e-5)
    assert got[3] == 0 and got[4:] == [None, None]


def test_composite(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, None), (None, None)], "a double, b double")
    parts = [(F.col("a"), 1.0), (F.col("b"), 3.0)]
    assert [r[0] for r in df.select(ranks.composite(parts)).collect()] == [0.625, None, None]
    assert [r[0] for r in df.select(ranks.composite(parts, partial=True)).collect()] == [0.625, 1.0, None]
    with pytest.raises(ValueError):
        ranks.composite([])


def test_coverage_and_tables(spark):
    df = spark.createDataFrame([("s", 1.0, None), (None, 2.0, 1.0), ("s", 3.0, 2.0)], "sector string, a double, r double")
    assert sorted(map(tuple, ic.coverage(df, ["a", "r"]).collect())) == [("a", 3, 100.0), ("r", 2, 66.67)]
    out = ic.ic_table(df, F.col("sector"), ["a"], {5: "r"}).collect()
    assert sorted((r.segment, r.n, r.ic) for r in out) == [("UNKNOWN", 1, None), ("s", 1, None)]


TRADES = "variant string, reference_trading_date date, fiscal_year string, ticker string, side string, signal_value double, gross_return double, net_return double, weight double"


def test_summaries(spark):
    from datetime import date

    rows = [("v", date(2024, m, d), "FY24", "T", side, 1.0, g, g, 1.0) for m, d, side, g in [(1, 2, "long", 0.04), (1, 9, "long", 0.02), (1, 3, "short", 0.01), (2, 2, "long", 0.04)]]
    rows.append(("v", None, "FY24", "T", "short", 1.0, 0.5, 0.5, 1.0))
    df = spark.createDataFrame(rows, TRADES)
    per = portfolio.summary_per_trade(df.where("reference_trading_date is not null")).first()
    net = pd.Series([0.04, 0.02, 0.01, 0.04])
    assert per.n_trades == 4 and per.sharpe == pytest.approx(net.mean() / net.std() * 12.6**0.5) and per.sortino is None and per.hit_rate == 1
    month = portfolio.summary_monthly(df).first()
    assert (month.n_trades, month.n_periods) == (5, 2) and month.net_mean == pytest.approx(0.04) and month.net_stddev == pytest.approx(0.0)
    assert portfolio.summary_per_trade(df.limit(0)).count() == 0


def test_buckets_pnl_and_trades(spark):
    from datetime import date

    rows = [(float(i), i / 100, date(2024, 1, 1 + i % 5), "C" if i % 2 else "D", "FY24Q1", "T") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "s double, r double, reference_trading_date date, c string, fiscal_quarter string, ticker string")
    spread = portfolio.bucket_returns(df.where("s <= 10"), [], "s", "r")
    assert portfolio.top_minus_bottom(spread, []).first()[0] == pytest.approx(0.09)
    pnl = {r[0]: r[1] for r in portfolio.cumulative_pnl(df, "s", "r", "reference_trading_date").collect()}
    assert pnl[date(2024, 1, 5)] == pytest.approx(sum(x / 100 for x in range(37, 41)) / 8)
    trades = portfolio.in_class_trades(df, "s", "r", "c", ["C", "D", "none"]).collect()
    assert {(t.variant, t.side) for t in trades} == {("C", "long"), ("C", "short"), ("D", "long"), ("D", "short")}
    for v in "CD":
        assert sum(t.weight for t in trades if t.variant == v) == pytest.approx(0.0)
    assert portfolio.cumulative_pnl(df.withColumn("s", F.lit(1.0)), "s", "r", "reference_trading_date").count() == 0
    cross = portfolio.cross_class_trades(df, "s", "r", "c", "C", "D").collect()
    assert len(cross) == 40 and all(t.net_return == pytest.approx(t.gross_return - 0.0015) for t in cross)
    assert portfolio.cross_class_trades(df, "s", "r", "c", "C", "none").count() == 0


def test_signal_specs_and_blend(spark):
    with pytest.raises(ValueError):
        ranks.SignalSpec("a", "up")
    with pytest.raises(ValueError):
        ranks.SignalSpec("a", "asc", 0)
    df = spark.createDataFrame([(1.0, 9.0), (2.0, 5.0), (3.0, 1.0), (4.0, None)], "a double, b double")
    got = [r.s for r in ranks.blend(df, [ranks.SignalSpec("a"), ranks.SignalSpec("b", "desc", 3.0)], "s").orderBy("a").collect()]
    assert got == [pytest.approx((0.2 + 3 * 0.25) / 4), pytest.approx((0.4 + 3 * 0.5) / 4), pytest.approx((0.6 + 3 * 0.75) / 4), None]


def test_backtest_entry(spark):
    rows = [(float(i), 0.01 * (i % 10), "C" if i < 100 else "D", date(2024, 1 + i % 12, 1), "FY24Q1", "T") for i in range(200)]
    df = spark.createDataFrame(rows, "s double, r double, c string, reference_trading_date date, fiscal_quarter string, ticker string")
    for bad in ({"framing": "x"}, {"framing": "in_class"}, {"framing": "cross_class", "long_class": "C"}):
        with pytest.raises(ValueError):
            portfolio.run_backtest(df, "s", "r", "c", **bad)
    one = portfolio.run_backtest(df, "s", "r", "c", framing="in_class", target_class="C", winsorized=True)
    assert one.summary.first().n_trades == 20 and one.deciles.count() == 10 and one.by_year.count() == 1 and one.config["target_class"] == "C"
    assert {r.weight for r in one.trades.collect()} == {0.1, -0.1}
    two = portfolio.run_backtest(df, "s", "r", "c", framing="cross_class", long_class="C", short_class="D")
    assert two.summary.first().n_trades == 200 and two.summary.first().n_periods == 12 and two.deciles.count() == 0
    assert portfolio.run_backtest(df.where("c = 'none'"), "s", "r", "c", framing="in_class", target_class="C").summary.count() == 0
    flat = df.withColumn("s", F.lit(1.0))
    assert portfolio.run_backtest(flat, "s", "r", "c", framing="in_class", target_class="C").trades.count() == 0


def test_parts_of_one_sign(spark, rows):
    cells = spark.createDataFrame([("a", "s", 20, 0.5), ("b", "s", 20, -0.5), ("c", "s", 20, None), ("d", "s", 20, 0.1)], "segment string, signal string, horizon int, ic double")
    parts = spark.createDataFrame([("a", "s", 20, p, v) for p, v in (("q1", 0.1), ("q2", -0.1), ("q3", 0.2), ("q4", None))] + [("b", "s", 20, "q1", -0.3)], "segment string, signal string, horizon int, part string, ic double")
    assert rows(ic.same_sign(cells, parts), "segment", "n_parts", "same_sign") == [("a", 3, 2), ("b", 1, 1), ("c", 0, 0), ("d", 0, 0)]
    need = spark.createDataFrame([(n,) for n in range(1, 25)], "n int").select(ic.parts_needed(F.col("n"))).collect()
    assert [r[0] for r in need] == [1, 2, 2] + [3] * 21
    wide = ic.pivoted(cells, parts, ["q1", "q2"])
    assert rows(wide, "segment", "ic_q1", "ic_q2")[:2] == [("a", 0.1, -0.1), ("b", -0.3, None)]
