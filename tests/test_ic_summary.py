"""The summary of many signals and returns against one pair at a time, and the narrow table it reads."""

import random

import pandas as pd
import pytest

from tidemark.operators import ic
from tidemark.plans import analytics_queries as a
from tidemark.plans import event_tables as t

SIGNALS, RETURNS = ["a", "b", "c"], {5: "r5", 20: "r20"}
DDL = "a double, b double, c double, r5 double, r20 double"


def make(n):
    """Distinct, heavily tied and equal signals, with nulls and NaN; tied and rare returns."""
    rng = random.Random(n)
    miss = lambda v, p: None if rng.random() < p else float("nan") if rng.random() < 0.02 else v
    return [(miss(rng.gauss(0, 1), 0.1), miss(rng.choice([0.0, -0.0, 0.0, 0.0, 0.5, 1.0]), 0.2), 3.0, miss(round(rng.gauss(0, 1), 2), 0.1), miss(rng.gauss(0, 1), 0.7)) for _ in range(n)]


def wanted(pdf, signal, ret):
    pairs = pdf[[signal, ret]].dropna()
    x, y = pairs[signal] + 0.0, pairs[ret]
    value = x.rank().corr(y.rank()) if len(x) >= 3 and x.nunique() > 1 and y.nunique() > 1 else None
    spread = None
    if len(x) >= 10 and x.nunique() > 1:
        means = y.groupby(pd.qcut(x, 10, labels=False, duplicates="drop")).mean()
        spread = means.iloc[-1] - means.iloc[0] if len(means) > 1 else None
    return len(x), value, spread


@pytest.mark.parametrize("n", [3000, 60, 4])
def test_summary_is_that_of_each_pair(spark, n):
    rows = make(n)
    pdf = pd.DataFrame(rows, columns=[*SIGNALS, *RETURNS.values()]).astype(float)
    got = {(r.signal, r.horizon): r for r in ic.summary(spark.createDataFrame(rows, DDL).repartition(3), SIGNALS, RETURNS).collect()}
    want = {(s, h): w for s in SIGNALS for h, r in RETURNS.items() if (w := wanted(pdf, s, r))[0]}
    assert got.keys() == want.keys()
    for k, (count, value, spread) in want.items():
        assert got[k].n == count
        assert got[k].ic == (None if value is None else pytest.approx(value, abs=1e-9)), k
        assert got[k].top_minus_bottom == (None if spread is None else pytest.approx(spread, abs=1e-9)), k


def test_summary_of_nothing(spark):
    assert ic.summary(spark.createDataFrame([], DDL), SIGNALS, RETURNS).count() == 0


def test_measured_rows_are_those_of_validated(spark, small):
    cols = [*t.MEASURES, *a._ALL.values()]
    assert t.measured(spark, small).columns == cols
    got, want = (sorted(map(repr, map(tuple, df.select(*cols).collect()))) for df in (t.measured(spark, small), t.validated(spark, small)))
    assert got and got == want


def names(spark, small, query):
    """The phase tables that a query builds."""
    before = dict(t._kept)
    t.forget()
    try:
        query(spark, small).collect()
        return {k[2] for k in t._kept}
    finally:
        t._kept.update(before)


def test_decision_criteria_builds_no_wide_table(spark, small):
    assert names(spark, small, a.decision_criteria) == {"measured"}


def test_ic_summary_matrix_builds_no_wide_table(spark, small):
    assert names(spark, small, a.ic_summary_matrix) == {"measured"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_is_planned_in_small_parts(spark):
    """Adaptive execution plans all of a query again after each stage: one query of everything filled the driver's memory."""
    last = plan(ic.summary(spark.createDataFrame(make(60), DDL), SIGNALS, RETURNS))
    assert "percentile_approx" not in last  # cut points are taken once, not in each place that reads them
    assert last.count("Exchange") <= 10


def test_measured_is_planned_in_small_parts(spark, small, monkeypatch):
    seen, stored = {}, t.stored
    monkeypatch.setattr(t, "stored", lambda df, name: seen.update({name: plan(df)}) or stored(df, name))
    monkeypatch.setattr(t, "_kept", {})
    t.measured(spark, small)
    assert {"transaction-values", "excess-returns", "measured"} <= seen.keys()
    assert "lead(close_adj" in seen["excess-returns"] and "lead(close_adj" not in seen["measured"]  # returns of bars are in a table of their own
