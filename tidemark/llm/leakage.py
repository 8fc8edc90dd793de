"""Evaluation texts leaking into training text: a distributed positional inverted index.

The corpus is indexed once, with all its words and without regard to any evaluation text,
in shards of documents. A shard is one row: its documents, where each begins in the shard's
run of positions, its terms in order and the sorted list of positions of each (as gaps).
Words are runs of letters and digits in lower case, tags are no words. The index is a table
that any number of evaluation sets can be searched in; the texts are not read again.

A passage of L >= ``min_words`` item words with at most L / ``per_edit`` edits keeps L - k
words in at most k + 1 unchanged runs, and so at least L - k - (q - 1)(k + 1) phrases of q
words. ``phrase_size`` takes the longest q that leaves three (or else one) for every L (a
longer passage than 2 * min_words falls into two, of which one keeps the bound), so the
search is complete for any parameters; those that no phrase size can serve are refused.

1. Each distinct phrase starts from the positions of its term that is rarest in the whole
   corpus; these are intersected, adjusted by their offsets, with the lists of its other
   terms from the rarer to the more frequent.
2. Phrase matches are gathered by document and item and by neighbouring offsets.
3. A place whose phrases show an unchanged run of ``min_words`` is an exact match; any other
   is aligned by edit distance over words and is a proximity match if some passage keeps
   the bound.

All documents and whole texts are indexed; searching is local to a shard, so nothing is
shuffled and no document can become a hot key: the work is in proportion to the text. Items
are searched in packs of about ``pack_words`` words, each broadcast once to the executors,
so the evaluation side has no bound either. Null and empty texts match nothing; items of
fewer words than ``min_words`` can't leak; repeated documents come out each; an item that
occurs twice in one document comes out once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.materialize import stored
from tidemark.session import ship

#: Words of a shard, after which the next one begins (a longer document is a shard of its own), and of a pack of items.
SHARD_WORDS, PACK_WORDS = 400_000, 1_000_000
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Free positions between two documents of a shard, so that no phrase spans both; phrases are at most half as long.
GAP = 16
INDEX = "doc_ids array<long>, starts array<int>, terms array<string>, ends array<int>, gaps array<int>"


def words(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def phrase_size(min_words: int, per_edit: int) -> tuple[int, int]:
    """(words of a phrase, phrases that every passage within the bound keeps)."""
    def kept(q: int) -> int:
        return min(n - n // per_edit - (q - 1) * (n // per_edit + 1) for n in range(min_words, 2 * min_words))

    for enough in (3, 1):
        for q in range(min(GAP // 2, min_words), 0, -1):
            if kept(q) >= enough:
                return q, kept(q)
    raise ValueError("a passage may be edited so much that no word of it need be left")


def read_items(items: DataFrame, item_id: str, text: str, min_words: int) -> DataFrame:
    """(item, words) of the evaluation texts that are long enough to leak."""
    ship(items.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            long = [(i, w) for i, t in zip(batch["i"], batch["t"], strict=True) if len(w := words(t)) >= min_words]
            if long:
                yield pd.DataFrame(long, columns=["item", "words"])

    rows = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    return rows.mapInPandas(read, "item long, words array<string>")


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def build_index(docs: DataFrame, doc_id: str, text: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: documents, their first positions, and the positions of every term of theirs."""
    ship(docs.sparkSession)

    def pack(ids: list, counts: list[int], numbers: dict[str, int], run: list[int]) -> pd.DataFrame:
        import numpy as np

        n = np.asarray(counts)
        starts = np.concatenate(([0], np.cumsum(n + GAP))).astype(np.int32)
        pos = np.arange(len(run), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32) * GAP, n)
        names = list(numbers)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), dtype=np.int32)
        place[by_name] = np.arange(len(names), dtype=np.int32)
        term = place[np.asarray(run, dtype=np.int32)]
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(names))).astype(np.int32)
        gaps = np.diff(pos[order], prepend=np.int32(0))
        return pd.DataFrame({"doc_ids": [ids], "starts": [starts], "terms": [[names[i] for i in by_name]], "ends": [ends], "gaps": [gaps]})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts, numbers, run = [], [], _Numbers(), []
        for batch in batches:
            for d, t in zip(batch["d"], batch["t"], strict=True):
                w = words(t)
                if w:
                    ids.append(d)
                    counts.append(len(w))
                    run.extend(map(numbers.__getitem__, w))
                if len(run) > shard_words:
                    yield pack(ids, counts, numbers, run)
                    ids, counts, numbers, run = [], [], _Numbers(), []
        if run:
            yield pack(ids, counts, numbers, run)

    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return rows.mapInPandas(index, INDEX)


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` (a bounded table) occurs in all documents."""
    ends = F.zip_with("ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda e, b: e - b)
    rows = index.select(F.explode(F.arrays_zip(F.col("terms"), ends.alias("n"))).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.n").alias("n"))
    return rows.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("n"))


def has_passage(item, doc, min_words: int, per_edit: int) -> bool:
    """Whether some min_words or more consecutive words of ``item`` stand in ``doc`` with at most one edit per ``per_edit`` of them.

    Row s of the table holds the least edits of item[s:j] against any stretch of doc that ends
    at each place. Starts of the last 2 * min_words words are enough: a longer passage falls
    into two of at least min_words words, and one of them keeps the bound as well.
    """
    import numpy as np

    m, n, rows = len(item), len(doc), 2 * min_words
    cols = np.arange(n + 1, dtype=np.int32)
    best = np.zeros((rows, n + 1), dtype=np.int32)
    for j in range(m):
        best[j % rows] = 0
        step = best + 1
        np.minimum(step[:, 1:], best[:, :-1] + (doc != item[j]), out=step[:, 1:])
        best = np.minimum.accumulate(step - cols, axis=1) + cols
        starts = np.arange(max(0, j + 1 - rows), j + 2 - min_words)
        if len(starts) and (per_edit * best[starts % rows].min(axis=1) <= j + 1 - starts).any():
            return True
    return False


class _Pack:
    """Some items as numbers of their terms, and their phrases: terms and offsets from the rarest to the most frequent term."""

    def __init__(self, rows: list, counts: dict[str, int], q: int) -> None:
        import numpy as np

        numbers = _Numbers()
        self.ids = [r[0] for r in rows]
        self.items = [np.array([numbers[w] for w in r[1]], dtype=np.int64) for r in rows]
        self.vocabulary = list(numbers)
        n = [counts.get(w, 0) for w in self.vocabulary]
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            t = item.tolist()
            for i in range(len(t) - q + 1):
                places[tuple(t[i : i + q])].append((k, i))
        phrases = [p for p in places if all(n[t] for t in p)]
        self.places = [places[p] for p in phrases]
        self.offsets = np.array([sorted(range(q), key=lambda o: (n[p[o]], o)) for p in phrases], dtype=np.int64).reshape(-1, q)  # noqa: B023
        self.terms = np.take_along_axis(np.array(phrases, dtype=np.int64).reshape(-1, q), self.offsets, axis=1)


class _Shard:
    """The postings of one row of the index."""

    def __init__(self, row) -> None:
        import numpy as np

        self.doc_ids, self.starts, self.terms = row["doc_ids"], np.asarray(row["starts"]), list(row["terms"])
        self.ends = np.asarray(row["ends"], dtype=np.int64)
        self.first = np.concatenate(([0], self.ends[:-1]))
        self.pos = np.cumsum(np.asarray(row["gaps"], dtype=np.int64))
        self.span = int(self.starts[-1]) + 2 * GAP
        self.of_pos = np.repeat(np.arange(len(self.terms)), self.ends - self.first)
        self.key = self.of_pos * self.span + self.pos  # in order: by term, then by position
        self._words = None

    def holds(self, term, pos):
        import numpy as np

        key = term * self.span + pos
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key

    def matches(self, terms, offsets, block: int = 2_000_000) -> Iterator[tuple[int, int]]:
        """(phrase, position of its first word) of all phrases, given by term numbers of this shard."""
        import numpy as np

        there = np.flatnonzero((terms >= 0).all(axis=1))
        sizes = (self.ends - self.first)[terms[there, 0]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), block), side="right")
        for part in np.split(there, np.unique(cuts)[1:] if len(cuts) > 1 else []):
            n = (self.ends - self.first)[terms[part, 0]]
            phrase = np.repeat(part, n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = self.pos[np.repeat(self.first[terms[part, 0]], n) + inside] - offsets[phrase, 0]
            phrase, begin = phrase[begin >= 0], begin[begin >= 0]
            for o in range(1, terms.shape[1]):
                ok = self.holds(terms[phrase, o], begin + offsets[phrase, o])
                phrase, begin = phrase[ok], begin[ok]
            yield from zip(phrase.tolist(), begin.tolist(), strict=True)

    def words(self, doc: int):
        """Term numbers of one document in their order."""
        import numpy as np

        if self._words is None:
            self._words = np.full(self.span, -1, dtype=np.int64)
            self._words[self.pos] = self.of_pos
        return self._words[self.starts[doc] : self.starts[doc + 1] - GAP]


def _judge(shard: _Shard, doc: int, item, seeds: list[tuple[int, int]], q: int, least: int, min_words: int, per_edit: int) -> str | None:
    m, first = len(item), int(shard.starts[doc])
    slack = m // per_edit + 2
    seeds = sorted((s - first - i, i) for s, i in seeds)  # by offset of the document against the item
    run = 1
    for a, b in zip([None, *seeds], seeds, strict=False):
        run = run + 1 if a is not None and (a[0], a[1] + 1) == b else 1
        if run >= min_words - q + 1:
            return "exact"
    groups, last = [], None
    for offset, _ in seeds:
        if last is None or offset - last > slack:
            groups.append([])
        groups[-1].append(offset)
        last = offset
    text = shard.words(doc)
    for g in groups:
        if len(g) >= least and has_passage(item, text[max(0, g[0] - slack) : min(len(text), g[-1] + m + slack)], min_words, per_edit):
            return "proximity"
    return None


def search(index: DataFrame, items: DataFrame, min_words: int = 15, per_edit: int = 6, pack_words: int = PACK_WORDS) -> DataFrame:
    """(doc_id, item, kind): documents with the items they contain, kind ``exact`` or ``proximity``.

    ``index`` comes from ``build_index`` and should be stored, ``items`` from ``read_items``.
    """
    q, least = phrase_size(min_words, per_edit)
    spark = index.sparkSession
    ship(spark)
    items = stored(items, "evaluation-items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    packs = math.ceil(total / pack_words)
    schema = "doc_id long, item long, kind string"
    out = spark.createDataFrame([], schema)
    for number in range(packs):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(packs)) == number)
        counts = {r[0]: r[1] for r in term_counts(index, some.select(F.explode("words").alias("term")).distinct()).collect()}
        pack = spark.sparkContext.broadcast(_Pack(some.collect(), counts, q))  # both of about pack_words words at most

        def look(batches: Iterator[pd.DataFrame], pack=pack) -> Iterator[pd.DataFrame]:
            import numpy as np

            p = pack.value
            for batch in batches:
                rows = []
                for _, row in batch.iterrows():
                    shard = _Shard(row)
                    at = {t: i for i, t in enumerate(shard.terms)}
                    local = np.array([at.get(w, -2) for w in p.vocabulary], dtype=np.int64)
                    by_doc: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                    for phrase, begin in shard.matches(local[p.terms], p.offsets):
                        doc = int(np.searchsorted(shard.starts, begin, side="right")) - 1
                        for k, i in p.places[phrase]:
                            by_doc[doc, k].append((begin, i))
                    for (doc, k), seeds in by_doc.items():
                        if len(seeds) >= least and (kind := _judge(shard, doc, local[p.items[k]], seeds, q, least, min_words, per_edit)):
                            rows.append((int(shard.doc_ids[doc]), p.ids[k], kind))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item", "kind"])

        out = out.unionByName(index.mapInPandas(look, schema))
    return out
