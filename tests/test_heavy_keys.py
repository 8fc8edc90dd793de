import random
from collections import Counter, defaultdict

import pytest

from tidemark.operators import heavy_keys as h


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    keys = ["hot"] * 3000 + ["warm"] * 600 + [None] * 300 + [f"k{rng.randint(0, 2000)}" for _ in range(5000)]
    rng.shuffle(keys)
    return [(k, i % 97, rng.choice([None, float(i)]), i) for i, k in enumerate(keys)]


def test_heavy_keys_are_exact(spark, data):
    df = spark.createDataFrame(data, "k string, day long, x double, n long")
    got = {r.k: (r.n, r.total) for r in h.heavy_keys(df, "k", 0.05).collect()}
    assert got == {"hot": (3000, len(data)), "warm": (600, len(data))}
    with pytest.raises(ValueError):
        h.heavy_keys(df, "k", 1e-6)


def test_two_path_aggregate(spark, data, rows):
    df = spark.createDataFrame(data, "k string, day long, x double, n long")
    aggs = [h.Agg("cnt", "count"), h.Agg("total", "sum", "x"), h.Agg("lo", "min", "x"), h.Agg("hi", "max", "x"), h.Agg("final", "last", "x", ("day", "n"))]
    got = {r.k: r for r in h.aggregate(df, "k", aggs, 0.05).collect()}
    by = defaultdict(list)
    for r in data:
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for k, rs in by.items():
        xs = [r[2] for r in rs if r[2] is not None]
        assert got[k].cnt == len(rs)
        assert got[k].total == (sum(xs) if xs else None)
        assert (got[k].lo, got[k].hi) == ((min(xs), max(xs)) if xs else (None, None))
        assert got[k].final == max(rs, key=lambda r: (r[1], r[3]))[2]
    assert {k for k, r in got.items() if r.is_heavy} >= {"hot", "warm"}


def test_two_path_join_keeps_all_rows(spark, data):
    df = spark.createDataFrame(data, "k string, day long, x double, n long")
    side = h.aggregate(df, "k", [h.Agg("cnt", "count")], 0.05).drop("is_heavy").where("k <> 'k1'")
    out = h.join(df, side, "k", 0.05).collect()
    counts = Counter(r[0] for r in data)
    assert len(out) == len(data)
    assert all(r.cnt == (None if r.k in (None, "k1") else counts[r.k]) for r in out)


def test_empty_and_all_null(spark):
    for some in ([], [(None, 1)]):
        df = spark.createDataFrame(some, "k string, x long")
        assert h.heavy_keys(df, "k", 0.1).count() == 0
        assert h.aggregate(df, "k", [h.Agg("n", "count")]).count() == len(some)
