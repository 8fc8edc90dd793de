import random
from datetime import date, timedelta

from tidemark.operators.history import value_before


def test_against_brute_force(spark):
    rng = random.Random(6)
    keys = ["hot"] * 700 + ["warm"] * 90 + [None] * 400 + [f"k{i % 60}" for i in range(300)]
    day = lambda: rng.choice([None, *[date(2024, 1, 1) + timedelta(days=rng.randint(0, 300))] * 12])
    rows = [(k, day(), f"t{i:04}", rng.choice([None, float(i)]), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, d date, tie string, v double, n int")
    got = {r.n: r.before for r in value_before(df, "k", "d", "tie", "v", "before").collect()}
    assert len(got) == len(rows)
    for k in set(keys):
        some = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or date.min, r[2]))
        for a, b in zip([None, *some], some, strict=False):
            assert got[b[4]] == (a[3] if a else None)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, d date, tie string, v double")
    assert value_before(df, "k", "d", "tie", "v", "before").count() == 0


def test_no_task_orders_a_whole_history(spark):
    """A null key of 30 % and a key of 1.9 %: the rows of no (key, bucket) are many times the median."""
    from pyspark.sql import functions as F

    day = lambda i: date(2024, 1, 1) + timedelta(days=i % 300)
    rows = [(None if i % 10 < 3 else "k19" if i % 53 == 7 else f"k{i % 997}", day(i // 10), f"t{i}", float(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, d date, tie string, v double")
    out = value_before(df, "k", "d", "tie", "v", "before")
    assert out.count() == 20_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    wide = [line for line in plan.splitlines() if "Window" in line and "__tm_b" not in line.split("],")[1]]
    assert len(wide) == 1  # over one row per key and bucket
    most = df.groupBy("k", "d").count().agg(F.max("count")).first()[0]
    assert most <= 60
