import random
import statistics
from datetime import date, timedelta

import pytest

from tidemark.operators import spikes as s

DDL = "source string, field string, value double, day date, unit string, id long"
D0 = date(2023, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DDL)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(4000):
        src = rng.choice(["a", "a", "b", None])
        v = rng.choice([0.0, None, float("nan"), float("inf"), *[rng.lognormvariate(10 if src == "a" else 3, 0.7) * rng.choice([1, -1])] * 30])
        out.append((src, rng.choice("xy"), v, D0 + timedelta(days=rng.randint(0, 700)), f"u{i % 400}"))
    out += [("a", "x", 5e9, D0, "u1"), ("b", "y", 1e-9, D0, "u1"), ("b", "x", None, None, None)]
    # a frozen value: six units within 30 days; another over 31 days; one repeated on a single unit
    out += [("b", "x", 7.125, D0 + timedelta(days=6 * k), f"f{k}") for k in range(6)]
    out += [("b", "x", 8.125, D0 + timedelta(days=int(6.2 * k)), f"f{k}") for k in range(6)]
    out += [("b", "x", 9.125, D0 + timedelta(days=k), "f0") for k in range(20)]
    return out


def measured(rows, src, field):
    ok = lambda v: v is not None and v == v and abs(v) != float("inf") and v != 0
    return [abs(r[2]) for r in rows if r[0] == src and r[1] == field and ok(r[2])]


def test_medians_are_exact(spark, rows):
    got = {(r.source, r.field): (r.n, r.median) for r in s.exact_medians(frame(spark, rows)).collect()}
    assert got.keys() == {(a, b) for a in "ab" for b in "xy"}
    for (a, b), (n, m) in got.items():
        vals = measured(rows, a, b)
        assert n == len(vals) and m == pytest.approx(statistics.median(vals), rel=1e-12)


def test_frozen_against_brute_force(spark, rows):
    got = {tuple(r) for r in s.frozen(frame(spark, rows)).collect()}
    assert {g[2] for g in got} == {7.125}
    assert {g[3] for g in got} == {D0 + timedelta(days=6 * k) for k in range(6)}


def test_a_hot_frozen_value(spark):
    rows = [("a", "x", 1.5, D0 + timedelta(days=k % 500), f"u{k}") for k in range(6000)]
    got = s.frozen(frame(spark, rows))
    assert got.count() == 500


def test_flags(spark, rows):
    df = frame(spark, rows)
    flags = {r.id: r for r in s.flag(df, ["id"], low_fields=("y",)).collect()}
    n = len(rows)
    assert len(flags) == s.flag(df, ["id"], low_fields=("y",)).count()
    for i, r in enumerate(rows):
        v = r[2]
        if v is None:
            assert i not in flags
        elif v != v or abs(v) == float("inf"):
            assert flags[i].impossible
        elif v == 5e9:
            assert flags[i].ratio and flags[i].tail
        elif r[0] is not None and v and abs(v) > 100 * statistics.median(measured(rows, r[0], r[1])):
            assert flags[i].ratio
    assert any(r[2] == 1e-9 and flags[i].ratio for i, r in enumerate(rows))
    assert sum(f.tail for f in flags.values()) < 0.01 * n


def test_the_fit_finds_the_spikes_and_more(spark):
    """Normal readings with three spikes in a thousand: the fitted cutoff lies between both and is not moved by the spikes."""
    rng = random.Random(7)
    clean = [("a", "x", 10 ** rng.gauss(5, 0.3), D0 + timedelta(days=rng.randint(0, 700)), f"u{i}") for i in range(6000)]
    spikes = [("a", "x", 10 ** rng.uniform(7.2, 12), D0 + timedelta(days=rng.randint(0, 700)), f"s{i}") for i in range(20)]
    mild = [("a", "x", 10 ** 6.9, D0 + timedelta(days=i), f"m{i}") for i in range(5)]
    farther = [(a, b, v * 1e30, *rest) for a, b, v, *rest in spikes]
    uppers = []
    for rows in (clean, clean + spikes + mild, clean + farther + mild):
        cells = s.tail_cutoffs(frame(spark, rows)).collect()
        assert len(cells) == 12 and {c.top_by for c in cells} == {"fit"}
        uppers.append(cells[0].upper)
    assert 0.9 < uppers[0] < 1.5 and uppers[1] < 1.9 and uppers[2] == pytest.approx(uppers[1])
    flags = {r.id: r for r in s.flag(frame(spark, clean + spikes + mild), ["id"]).collect()}
    recall = sum(flags[i].found_by == "fit" for i in range(6000, 6020)) / 20
    assert recall == 1.0
    assert all(flags[i].tail and not flags[i].ratio and flags[i].found_by is None for i in range(6020, 6025))
    assert sum(i < 6000 for i in flags) < 12


def test_cells_without_a_tail_fall_back_to_the_plausibility_bound(spark):
    rows = [("a", "x", 2.0, D0, "u0")] * 50 + [("a", "x", 2e6, D0, "u0"), ("a", "x", 2e6, None, "u0")]
    flags = s.flag(frame(spark, rows), ["id"]).collect()
    assert sorted((f.id, f.found_by, f.tail) for f in flags) == [(50, "plausibility", False), (51, "plausibility", False)]


def test_null_sources_and_empty(spark):
    assert s.flag(frame(spark, []), ["id"]).count() == 0
    got = s.flag(frame(spark, [(None, "x", float("inf"), None, None), (None, "x", 1e300, D0, "u")]), ["id"]).collect()
    assert [r.id for r in got] == [0]
