import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versions as v
from tidemark.operators.asof import asof_join

D0 = date(2024, 1, 1)


def day(n):
    return None if n is None else D0 + timedelta(days=n)


def known(spark, events, history, **kw):
    h = spark.createDataFrame(history, "k string, d date, at timestamp_ntz, x double")
    e = spark.createDataFrame(events, "k string, t date, id long")
    eff = F.when(F.col("d").isNotNull() & F.col("at").isNotNull(), F.greatest(F.col("d"), F.col("at").cast("date")))
    return v.as_known(e, v.validity_intervals(h, "k", eff, ["d", "at"], ["x"]), "k", "t", ["x"], **kw)


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    history = []
    for _ in range(300):
        d = rng.choice([None, *range(0, 200)])
        late = rng.choice([0, 0, 1, 30, 90])
        at = None if d is None else datetime(2024, 1, 1, rng.randint(0, 23)) + timedelta(days=d + late)
        history.append((rng.choice("abcd"), day(d), at, rng.choice([None, float("nan"), rng.random()])))
    history += history[:40]
    events = [(rng.choice(["a", "a", "a", "b", "c", "d", "e", None]), day(rng.choice([None, *range(-10, 320)])), i) for i in range(500)]
    got = {r.id: r.known_x for r in known(spark, events, history, bucket_days=7).collect()}
    assert len(got) == 500
    key = lambda h: (h[1], h[2], -1 if h[3] is None else 2 if h[3] != h[3] else h[3])
    for k, t, i in events:
        fit = [h for h in history if h[0] == k and k is not None and t is not None and h[1] is not None and h[1] <= t and h[2].date() <= t]
        want = max(fit, key=key)[3] if fit else None
        assert got[i] == want or (got[i] != got[i] and want != want), (k, t)


def test_empty_sides_and_clashing_columns(spark):
    assert known(spark, [], []).count() == 0
    assert [r.known_x for r in known(spark, [("a", D0, 1)], []).collect()] == [None]
    e = spark.createDataFrame([("a", D0, 7, 8, 9)], "k string, t date, known_x long, n long, x long")
    h = spark.createDataFrame([("a", D0, 1.5)], "k string, d date, x double")
    r = v.as_known(e, v.validity_intervals(h, "k", F.col("d"), ["d"], ["x"]), "k", "t", ["x"]).first()
    assert (r.known_x, r.n, r.x) == (1.5, 8, 9)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_against_brute_force(spark, direction, tolerance):
    rng = random.Random(2)
    right = [(rng.choice("ab"), day(rng.randint(0, 120)), rng.random()) for _ in range(40)] + [(None, D0, 1.0), ("a", None, 2.0)]
    left = [(rng.choice(["a", "b", "c", None]), day(rng.choice([None, *range(-5, 130)])), i) for i in range(200)]
    out = asof_join(spark.createDataFrame(left, "k string, t date, i long"), spark.createDataFrame(right, "k string, d date, x double"), "k", "t", "d", ["d", "x"], direction, tolerance, "r_")
    got = {r.i: (r.r_d, r.r_x) for r in out.collect()}
    sign = 1 if direction == "backward" else -1
    for k, t, i in left:
        fit = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and 0 <= sign * (t - r[1]).days <= (999 if tolerance is None else tolerance)]
        best = max(fit, key=lambda r: (sign * (r[1] - D0).days, r[2])) if fit else (None, None, None)
        assert got[i] == best[1:], (k, t)


def test_asof_rejects_a_direction(spark):
    df = spark.createDataFrame([("a", D0)], "k string, t date")
    with pytest.raises(ValueError):
        asof_join(df, df, "k", "t", "t", [], "sideways")
