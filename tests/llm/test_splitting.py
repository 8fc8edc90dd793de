import random

import pytest

from tidemark.llm import splitting as s
from tidemark.llm.tokens import count_tokens, encoding

TEXTS = [
    "One sentence here. " * 300,
    "Paragraph of words that go on.\n\n" * 200,
    "line of a list\n" * 400,
    "A1F3" * 3000,
    "é" * 3000,
    "漢字かな" * 900,
    " " * 9000,
    "words without any stop " * 300,
    "x\r\n\r\ny. " * 700,
    "😀😁 " * 900,
]


def check(text, limit, overlap):
    enc, pieces = encoding(), s.cut(text, limit, overlap)
    end = 0
    for i, (start, length, tokens) in enumerate(pieces):
        piece = text[start : start + length]
        assert tokens == len(enc.encode_ordinary(piece)) <= limit
        assert start <= end < start + length  # nothing is missed, every piece adds something
        if i:
            assert len(enc.encode_ordinary(text[start:end])) >= min(overlap, 1)
        end = start + length
    assert end == len(text)
    return pieces


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(1024, 64), (50, 10), (16, 0)])
def test_pieces_cover_and_fit(text, limit, overlap):
    check(text, limit, overlap)


def test_random_texts():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Longer phrase. ", "\n", "\n\n", "é", "漢", "abcdef", "12 ", "\t", "!?"]) for _ in range(rng.randint(1, 400)))
        check(text, rng.choice([20, 64]), rng.choice([0, 5, 9]))


def test_cuts_fall_on_natural_places():
    text = "Some words stand here and more. " * 400
    for start, length, _ in s.cut(text, 200, 20)[:-1]:
        assert text[: start + length].endswith(".")
    text = "alpha beta gamma delta.\n\n" * 300
    assert all(text[a + n : a + n + 2] == "\n\n" for a, n, _ in s.cut(text, 100, 10)[:-1])


def test_overlap_is_exact_in_plain_text():
    text, enc = "Some words stand here and more. " * 400, encoding()
    p = s.cut(text, 1024, 64)
    for (a, n, _), (b, _, _) in zip(p, p[1:], strict=False):
        assert len(enc.encode_ordinary(text[b : a + n])) == 64


def test_rows(spark):
    rows = [(1, t, "old", 7) for t in TEXTS[:2]] + [(2, None, "", 0), (3, "", "", 0), (4, "short", "", 0), (5, TEXTS[4], "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, cuts int")
    out = s.split(df, "text").collect()
    assert {r.doc_id for r in out} == {1, 5} and out[0].asDict().keys() == {"doc_id", "cuts", "piece_no", "start", "n_tokens", "piece"}
    want = [(d, i, t[a : a + n]) for d, t, _, _ in rows if t for i, (a, n, _) in enumerate(s.cut(t, 1024, 64)) if d in (1, 5)]
    assert sorted((r.doc_id, r.piece_no, r.piece) for r in out) == sorted(want)
    assert s.split(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        s.with_cuts(df, "text", 100, 60)


def test_counts(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(count_tokens(df.t)).collect()] == [3, 0, None]


def test_a_natural_place_in_the_first_half_comes_before_a_hard_cut():
    head = "A few words stand in front of it, and they are more than the overlap has."
    text = head + " " + "xQ7" * 400 + " and some more words to end with."
    first = check(text, 300, 10)[0]
    assert text[first[0] : first[0] + first[1]] == head
