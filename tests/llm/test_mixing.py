import random

import pytest

from tidemark.llm import mixing as m


def plain_sainte_lague(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        live = [i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not live:
            break
        got[max(live, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_against_the_rule_itself():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 6)
        w = [rng.choice([0.0, 0.05, 0.1, 0.25, rng.random()]) for _ in range(n)]
        caps = [rng.choice([0, 3, 20, 1000]) for _ in range(n)]
        seats = rng.randint(0, 120)
        assert m.sainte_lague(w, seats, caps) == plain_sainte_lague(w, seats, caps)
    assert m.sainte_lague([], 5, []) == []


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    sources = ["alpha"] * 900 + ["Beta-x", " beta_x"] * 150 + ["gamma"] * 30 + [None] * 50 + ["other"] * 100
    rows = [(i, s, rng.choice([0, rng.randint(50, 900), rng.randint(50, 900), 4000])) for i, s in enumerate(sources)]
    rows += [(None, "alpha", 500), (5000, "alpha", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def mix(name, parts, fraction):
    return [{"mix_name": name, "source": s, "target_share": w, "max_repeats": r, "corpus_fraction": fraction} for s, w, r in parts]


def test_shares_repeats_and_missing_sources(spark, docs):
    targets = mix("even", [("alpha", 0.5, 1), ("beta-X", 0.5, 3)], 0.5) + mix("scarce", [("gamma", 0.6, 2), ("alpha", 0.3, 2), ("absent", 0.1, 9)], 0.4)
    drawn = m.draw(docs, targets, block_tokens=256)
    rows = drawn.collect()
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    limits = {("even", "alpha"): 1, ("even", "beta_x"): 3, ("scarce", "gamma"): 2, ("scarce", "alpha"): 2}
    assert all(1 <= r.copies <= limits[r.mix_name, r.source] for r in rows)
    table = spark.createDataFrame([tuple(t.values()) for t in targets], "mix_name string, source string, target_share double, max_repeats int, corpus_fraction double")
    got = {(r.mix_name, r.source): r for r in m.shares(drawn, table).collect()}
    assert abs(got["even", "alpha"].reached_share - 0.5) < 0.02 and abs(got["even", "beta_x"].reached_share - 0.5) < 0.02
    assert got["scarce", "absent"].tokens == 0
    # gamma is too small: every document of it is used as often as allowed
    gamma = {r.doc_id for r in docs.where("source = 'gamma' and n_tokens > 0").collect()}
    assert {r.doc_id for r in rows if r.source == "gamma" and r.copies == 2} == gamma
    whole = sum(r.n_tokens or 0 for r in docs.collect())
    assert abs(sum(r.copies * r.n_tokens for r in rows if r.mix_name == "even") / whole - 0.5) < 0.02


def test_seeded_and_sharded(spark, docs):
    targets = mix("one", [("alpha", 1.0, 1)], 0.2)
    key = lambda df: sorted((r.doc_id, r.copies) for r in df.collect())
    a = key(m.draw(docs, targets, seed=1, block_tokens=256))
    assert a == key(m.draw(docs.repartition(7), targets, seed=1, block_tokens=256))
    assert a != key(m.draw(docs, targets, seed=2, block_tokens=256))
    many = m.draw(docs, targets, seed=1, block_tokens=256, shard_tokens=20_000).collect()
    whole = sum(r.n_tokens or 0 for r in docs.collect())
    assert abs(sum(r.n_tokens for r in many) / whole - 0.2) < 0.03


def test_two_levels_of_shards(spark, docs):
    """Many shards in groups: every shard gets its share of blocks, no document more copies than allowed."""
    targets = mix("one", [("alpha", 0.7, 2), ("beta_x", 0.3, 1)], 0.6)
    p = m.plan(docs, targets, block_tokens=256, shard_tokens=9_000)
    groups, shards = p.shards.select("source", "group").distinct().count(), p.shards.count()
    assert shards > 30 and groups < 2 * shards**0.5 + 2
    drawn = m.draw(docs, targets, block_tokens=256, shard_tokens=9_000).collect()
    whole = sum(r.n_tokens or 0 for r in docs.collect())
    got = {s: sum(r.copies * r.n_tokens for r in drawn if r.source == s) / whole for s in ("alpha", "beta_x")}
    assert abs(got["alpha"] - 0.42) < 0.05 and all(r.copies <= (2 if r.source == "alpha" else 1) for r in drawn)


def test_empty(spark, docs):
    assert m.draw(docs.limit(0), mix("x", [("alpha", 1.0, 1)], 0.5)).count() == 0
    assert m.draw(docs, []).count() == 0
