import random

import numpy as np
import pytest

from tidemark.llm import leakage as k


def slow(item, doc, least, per):
    """Every passage against every stretch, by plain edit distance."""
    for s in range(len(item)):
        for e in range(s + least, len(item) + 1):
            p = item[s:e]
            prev = [0] * (len(doc) + 1)
            for i, a in enumerate(p, 1):
                cur = [i]
                for j, b in enumerate(doc, 1):
                    cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
                prev = cur
            if per * min(prev) <= len(p):
                return True
    return False


def test_has_passage_against_all_passages():
    rng = random.Random(1)
    seen = set()
    for _ in range(150):
        item = [rng.randint(1, 30) for _ in range(rng.randint(4, 16))]
        doc = [rng.randint(31, 60) for _ in range(3)] + item + [rng.randint(31, 60) for _ in range(3)]
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(doc))
            doc[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [99], [98, 97]])
        want = slow(item, doc, 5, 4)
        seen.add(want)
        assert k.has_passage(np.array(item), np.array(doc), 5, 4) == want
    assert seen == {True, False}


def test_words():
    assert k.words("<p>Granular **bids**, at\r\n> 5_yields</p> a<b") == ["granular", "bids", "at", "5", "yields", "a", "b"]
    assert k.words("") == []


ITEM = " ".join(f"word{i}" for i in range(40))
OTHER = " ".join(f"term{i}" for i in range(30)) + " word1 word2 word3"


def edited(words, edits):
    w = words.split()
    for at, new in edits:
        w[at : at + 1] = new
    return " ".join(w)


DOCS = {
    1: ITEM,
    2: "before it " + " ".join(ITEM.split()[5:20]) + " after it",
    3: " ".join(ITEM.split()[5:19]) + " end",  # fourteen words, but fifteen with one changed
    4: "a b " + " ".join(ITEM.split()[5:12]) + " c d",
    5: edited(ITEM, [(7, ["x"]), (14, []), (22, ["word22", "y"]), (30, ["z"])]),
    6: edited(ITEM, [(i, ["x"]) for i in range(0, 40, 4)]),
    7: ITEM.upper().replace(" ", ",\n> **") + "**",
    8: OTHER + " and then " + ITEM,
    9: None,
    10: "",
    11: "nothing here " * 20000,
    12: " ".join(ITEM.split()[:9]) + " gap gap gap gap gap gap gap gap " + " ".join(ITEM.split()[9:18]),
    13: ITEM,
}


def items(spark, rows, least=15):
    return k.read_items(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", least)


@pytest.fixture(scope="module")
def found(spark):
    rows = [(d, t, "clash") for d, t in DOCS.items()]
    docs = spark.createDataFrame([*rows, (14, " ".join(["pad"] * 300000) + " " + ITEM, "")], "doc_id long, text string, words string").repartition(3)
    index = k.build_index(docs, "doc_id", "text")
    return sorted(tuple(r) for r in k.search(index, items(spark, [(100, ITEM), (200, OTHER), (300, "too short"), (400, None)])).collect())


def test_matches(found):
    assert {(d, i) for d, i, _ in found} == {(1, 100), (2, 100), (3, 100), (5, 100), (7, 100), (8, 100), (8, 200), (13, 100), (14, 100)}
    kinds = {(d, i): kind for d, i, kind in found}
    assert kinds[1, 100] == kinds[2, 100] == kinds[14, 100] == "exact"
    assert kinds[3, 100] == kinds[5, 100] == "proximity"
    assert len(found) == len(kinds)


@pytest.mark.parametrize("least, per", [(15, 6), (12, 4), (10, 5), (6, 3), (8, 2), (5, 9)])
def test_random_documents_against_all_passages(spark, least, per):
    """The phrase size follows from the parameters, so none of them loses a passage; shards and packs are small here."""
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(24))) for i in range(4)]
    docs = []
    for d in range(50):
        w = rng.choice(texts)[1].split()[rng.randint(0, 6) :]
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["q"], ["q", "r"]])
        docs.append((d, " ".join(["pre"] * rng.randint(0, 4) + w)))
    index = k.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), "doc_id", "text", shard_words=150)
    got = {(r.doc_id, r.item) for r in k.search(index, items(spark, texts, least), least, per, pack_words=30).collect()}
    want = {(d, i) for d, t in docs for i, text in texts if slow(text.split(), t.split(), least, per)}
    assert got == want and want


def test_phrase_sizes():
    assert k.phrase_size(15, 6) == (4, 3) and k.phrase_size(12, 4)[0] == 2
    with pytest.raises(ValueError):
        k.phrase_size(15, 1)


def test_an_index_of_all_words_serves_any_items(spark):
    index = k.build_index(spark.createDataFrame([(1, ITEM), (2, OTHER)], "doc_id long, text string").coalesce(1), "doc_id", "text")
    assert [tuple(r)[:2] for r in k.search(index, items(spark, [(7, OTHER)])).collect()] == [(2, 7)]
    assert [tuple(r)[:2] for r in k.search(index, items(spark, [(8, ITEM)])).collect()] == [(1, 8)]
    row = index.collect()[0]
    assert list(row.terms) == sorted(set((ITEM + " " + OTHER).split()))


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert k.search(k.build_index(docs, "doc_id", "text"), items(spark, [(1, ITEM)])).count() == 0
    some = k.build_index(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), "doc_id", "text")
    assert k.search(some, items(spark, [])).count() == 0
