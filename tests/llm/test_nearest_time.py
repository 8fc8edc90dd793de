import random
from datetime import date, timedelta

import pytest

from tidemark.llm.nearest_time import nearest

D0 = date(2024, 1, 1)
L, R = "k string, t date, id string, bar string", "k string, d date, x double"


def run(spark, left, right, tolerance=5, partitions=None):
    out = nearest(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "k", "t", "d", "id", tolerance, partitions)
    return sorted((r.id, r.k, r.t, r.d) for r in out.collect())


def brute(left, right, tolerance=5):
    out = set()
    for k, t, i, _ in left:
        fit = [r[1] for r in right if r[0] == k and k is not None and t is not None and r[1] is not None and abs((t - r[1]).days) <= tolerance]
        if fit:
            out.add((i, k, t, min(fit, key=lambda d: (abs((t - d).days), d))))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    at = lambda n: D0 + timedelta(days=n)
    right = [(rng.choice("abc"), at(rng.randint(0, 400)), None) for _ in range(60)] + [(None, at(3), 1.0), ("a", None, 1.0)]
    right += right[:9]
    # one entity holds most rows, and one of its days a third
    left = [(rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([at(rng.randint(-5, 420)), at(77), at(77), None]), f"i{i}", "clash") for i in range(900)]
    left += left[:50]
    assert run(spark, left, right, 5, partitions) == brute(left, right)


def test_ties_edges_and_empty(spark):
    at = lambda n: D0 + timedelta(days=n)
    left = [("a", at(5), "x", None), ("a", at(5), "x", None), ("b", at(5), "y", None)]
    assert run(spark, left, [("a", at(4), 1.0), ("a", at(6), 1.0), ("b", at(10), None), ("b", at(-1), None)]) == [("x", "a", at(5), at(4)), ("y", "b", at(5), at(10))]
    assert run(spark, left, []) == [] and run(spark, [], [("a", at(4), 1.0)]) == []
    assert run(spark, left, [("b", at(11), 1.0)]) == []


def test_repeats_of_one_row_and_more_partitions_by_size(spark, monkeypatch):
    """One record a thousand times is one record; the number of partitions follows from the rows."""
    from tidemark.llm import nearest_time

    monkeypatch.setattr(nearest_time, "PARTITION_ROWS", 100)
    left = [("a", D0, "same", None)] * 1000 + [("a", D0 + timedelta(days=i % 300), f"i{i}", None) for i in range(900)]
    right = [("a", D0 + timedelta(days=7 * i + 3), None) for i in range(40)]
    assert run(spark, left, right) == brute(left, right)
