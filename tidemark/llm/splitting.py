"""Splitting oversized items at natural boundaries.

An item of more than ``limit`` tokens becomes consecutive pieces of at most ``limit``
tokens. Token lengths give prefix sums of byte offsets; the places where a text may be
cut are sorted arrays, one per strength: blank line, line break, sentence end, white
space. For each piece a binary search finds the last place of the strongest kind within
the limit that still fills half of it, else the last place of any kind beyond the overlap;
only text without any such place is cut hard, between two tokens and never inside a character. The next piece starts ``overlap`` tokens before
that cut, so nothing is missed.

All places are starts of white space, where the tokenizer's own split falls as well, so a
piece tokenized alone has the same tokens as in its item. Where a piece begins or ends
elsewhere (an overlap that starts in a word, a hard cut) it is tokenized again and, if it
came out longer than the limit, shortened.

Null and empty texts and items of up to ``limit`` tokens stay whole and give no pieces. A text of at most ``limit`` bytes cannot have
more tokens than that and is never tokenized. Equal texts give equal pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, byte_lengths, encoding
from tidemark.session import ship

_BLANK = re.compile(rb"(?<!\s)\s+")
_SENTENCE = re.compile(rb"[.!?;:][\"')\]*_]*$|\xe3\x80\x82$")
_PIECE = "array<struct<start:int,length:int,n_tokens:int>>"


def _places(raw: bytes, offsets) -> list[list[int]]:
    """Token indices at which white space begins, from the strongest kind to the weakest."""
    import numpy as np

    kinds: list[list[int]] = [[], [], [], []]
    for m in _BLANK.finditer(raw):
        s, e = m.span()
        breaks = raw.count(b"\n", s, e) or raw.count(b"\r", s, e)
        kind = 0 if breaks > 1 else 1 if breaks else 2 if _SENTENCE.search(raw[max(0, s - 8) : s]) else 3
        kinds[kind].append(s)
    out = []
    for places in kinds:
        at = np.asarray(places, dtype=np.int64)
        k = np.searchsorted(offsets, at)
        out.append(k[offsets[k] == at].tolist() if len(at) else [])
    return out


def cut(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, int]]:
    """(first character, characters, tokens) of each piece; one piece if the text fits."""
    import numpy as np

    enc, sizes = encoding(path), byte_lengths(path)
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n)]
    raw = text.encode()
    offsets = np.concatenate(([0], np.cumsum(sizes[np.asarray(ids)])))
    ascii_only = len(raw) == len(text)
    if ascii_only:
        char_of = None
    else:
        char_of = np.concatenate((np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1, [len(text)]))
    inside = lambda k: not ascii_only and k < n and (raw[offsets[k]] & 0xC0) == 0x80
    chars = lambda k: int(offsets[k] if char_of is None else char_of[offsets[k]])
    levels = _places(raw, offsets)

    def clean(k: int) -> bool:
        """White space begins at token k after an ASCII character, or the text does."""
        b = int(offsets[k])
        return k in (0, n) or (raw[b : b + 1].isspace() and raw[b - 1] < 0x80 and not raw[b - 1 : b].isspace())

    out, s, done = [], 0, 0
    while True:
        most = limit
        while True:
            end = min(n, s + most)
            if end < n:
                # the strongest place in the last half, else the last place of any kind that adds something, else a hard cut
                for least in (most // 2, overlap):
                    found = [places[i - 1] for places in levels if (i := bisect_right(places, end)) and places[i - 1] > max(s + max(least, overlap), done)]
                    if found:
                        end = found[0] if least > overlap else max(found)
                        break
                else:
                    while inside(end) and end > s + 1:
                        end -= 1
            tokens = end - s
            if not (clean(s) and clean(end)):
                tokens = len(enc.encode_ordinary(text[chars(s) : chars(end)]))
            if tokens <= limit or end - s <= 1:
                break
            most = min(most, end - s) - (tokens - limit)
        if end <= done:  # the overlap left no room for anything new: begin later
            s += 1
            while inside(s):
                s += 1
            continue
        out.append((chars(s), chars(end) - chars(s), tokens))
        if end >= n:
            return out
        done = end
        nxt = max(end - overlap, s + 1)
        while inside(nxt) and nxt > s + 1:
            nxt -= 1
        while inside(nxt):
            nxt += 1
        s = nxt


def _cuts(path: str, limit: int, overlap: int):
    @F.pandas_udf(_PIECE)
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("start", "length", "n_tokens"), p, strict=True)) for p in cut(t, limit, overlap, path)] for t in texts])

    # else the optimiser repeats it, once for the filter on its result and once for the result
    return cuts.asNondeterministic()


def with_cuts(df: DataFrame, text: str, limit: int = 1024, overlap: int = 64, path: str = VOCABULARY, out: str = "cuts") -> DataFrame:
    """Rows of more than ``limit`` tokens with the array of their cuts."""
    ship(df.sparkSession)
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of limit")
    if out.lower() == text.lower():
        raise ValueError("the output can't be called like the text")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()])
    long = df.where(F.octet_length(text) > limit)  # tokens are at least one byte each
    return long.withColumn(out, _cuts(path, limit, overlap)(F.col(text))).where(F.size(out) > 1)


def split(df: DataFrame, text: str, limit: int = 1024, overlap: int = 64, path: str = VOCABULARY) -> DataFrame:
    """One row per piece: the other columns, piece_no from 0, start, n_tokens, piece.

    Input columns called like these four are replaced.
    """
    cuts = with_cuts(df, text, limit, overlap, path, "__tm_cuts")
    rest = [F.col(f"`{c}`") for c in df.columns if c != text and c.lower() not in ("piece_no", "start", "n_tokens", "piece")]
    rows = cuts.select(*rest, text, F.posexplode("__tm_cuts").alias("piece_no", "__tm_c"))
    return rows.select(*rest, "piece_no", F.col("__tm_c.start").alias("start"), F.col("__tm_c.n_tokens").alias("n_tokens"), F.substr(F.col(text), F.col("__tm_c.start") + 1, F.col("__tm_c.length")).alias("piece"))
