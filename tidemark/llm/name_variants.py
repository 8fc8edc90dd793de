"""Variant spellings of names typed by people.

A name is brought into a normal form: its distinctive part (an invented word or a surname)
and its other words in order of the alphabet, so reordered names have one form. Legal forms,
noise, accents and nicknames are folded by public tables (``name_parts``), abbreviations by
the words they shorten. Which words are general is learned by counting: an ordinary word of
the language by its names, any other word by the different distinctive words that it goes
with, since one organisation's own word may be in many names. Both counts are constants, so
more data can make a word general, but the size of the data alone can't.

Names are linked by a pigeonhole segment join over their normal forms: a form is cut into
k + 1 segments, at most k edits leave one of them whole, so the other form holds it at a
place shifted by as much as the edits allow. Segments form an inverted index (the words that
must be equal, length, segment number, segment), looked up with the admissible substrings
only, and candidates are verified with the banded edit distance of the JVM. The edits may
fall into the distinctive part only: two general words that differ make sister companies,
not typing errors. k goes by length: up to four letters must be equal, five to seven may
have one edit or two neighbours swapped, eight and more two edits. The same join over single
words mends the typing errors of general words beforehand.

Names with dropped or shortened words join the one class that covers them; where several
classes of nearest spelling do (sister companies that differ in one word) they stay apart.

Everything is done on distinct names and distinct words; no name group, pair list or
component is gathered. Fetched are only general words: ordinary words of the tokenizer's
vocabulary, and words that at least ``LEAST`` names and ``COMPANIONS`` distinctive words
share. Null names and placeholders mean nobody and get no class; names without any
distinctive word link only to names of the same words; exact repeats are one name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import name_parts as parts
from tidemark.llm.components import components
from tidemark.llm.tokens import VOCABULARY, encoding
from tidemark.materialize import stored
from tidemark.session import ship

#: Names that a word which is none of the language's must be in to count as general.
LEAST = 25
#: A frequent word is general if it goes with so many different distinctive words, each in so many of its names.
COMPANIONS, TOGETHER = 4, 2
#: A frequent word of one organisation is a typing error of a general word that is so many times as frequent.
MISTYPED = 10
#: Letters from which one edit is a typing error, and from which two are.
ONE_EDIT_FROM, TWO_EDITS_FROM = 5, 8
#: Names of one class on one side of a task that lists pairs.
PAIR_BLOCK = 2_000


def near_forms(forms: DataFrame, form: str, equal: str | None = None) -> DataFrame:
    """(a, b, edits[, equal]): pairs a < b of distinct forms that one may be typed for the other, with the same ``equal``.

    Pigeonhole segment join, see the module. A pair goes by the length of its shorter form.
    """
    key = [F.col(equal).alias("same")] if equal else []
    s = forms.select(F.col(form).alias("s"), *key).where(F.length(form) >= ONE_EDIT_FROM).distinct().withColumn("n", F.length("s"))
    same = ["same"] if equal else []

    def segment(n, i: int, parts_n: int):
        """(start from 1, length) of segment i of a string of length n: the last ones are longer."""
        base, rest = F.floor(n / parts_n).cast("int"), (n % parts_n).cast("int")
        longer = F.when(F.lit(i) >= parts_n - rest, 1).otherwise(0)
        return F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - (F.lit(parts_n) - rest)) + 1, base + longer

    entries, probes = [], []
    for k in (1, 2):
        fits = lambda n, k=k: (n < TWO_EDITS_FROM) if k == 1 else (n >= TWO_EDITS_FROM)
        for i in range(k + 1):
            start, size = segment(F.col("n"), i, k + 1)
            entries.append(F.when(fits(F.col("n")), F.struct(F.col("n").alias("m"), F.lit(i).alias("i"), F.substring("s", start, size).alias("seg"))))
            for delta in range(k + 1):  # the indexed form is shorter by delta
                m = F.col("n") - delta
                start, size = segment(m, i, k + 1)
                for shift in range(-i, i + 1):
                    if abs(shift - delta) <= k - i:
                        probes.append(F.when(fits(m) & (start + shift >= 1), F.struct(m.alias("m"), F.lit(i).alias("i"), F.substring("s", start + shift, size).alias("seg"))))
    # swapped neighbours are two edits: short forms meet by their letters as well
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swap = F.when(F.col("n") < TWO_EDITS_FROM, F.struct(F.col("n").alias("m"), F.lit(-1).alias("i"), letters(F.col("s")).alias("seg")))
    cut = lambda name, some: s.select(F.col("s").alias(name), *same, F.explode(F.array_distinct(F.array_compact(F.array(*some, swap)))).alias("e")).select(name, *same, "e.*")
    pairs = cut("x", entries).join(cut("y", probes), [*same, "m", "i", "seg"]).where(F.col("x") != F.col("y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *same).distinct()
    near = pairs.withColumn("edits", F.levenshtein("a", "b", 2)).where(F.col("edits") >= 0)
    long = (F.length("a") >= TWO_EDITS_FROM) & (F.length("b") >= TWO_EDITS_FROM)
    near = near.where((F.col("edits") <= 1) | long | (letters(F.col("a")) == letters(F.col("b"))))
    return near.withColumnRenamed("same", equal) if equal else near


def _tokens():
    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield pd.Series([None if parts.is_placeholder(n) else parts.tokens(n) for n in names])

    return tokens


def _ordinary(path: str):
    @F.pandas_udf("boolean")
    def ordinary(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for words in batches:
            yield pd.Series([any(len(enc.encode_ordinary(x)) == 1 for x in (" " + w, " " + w.capitalize(), w.capitalize())) for w in words])

    return ordinary


def general_words(read: DataFrame, seen: DataFrame, frequent: DataFrame, ordinary: set[str], near: DataFrame) -> DataFrame:
    """Those of the ``frequent`` words that go with at least ``COMPANIONS`` different distinctive words.

    Ordinary words, given names, legal forms, abbreviations, known words written together and
    typing errors of all these don't count, and the typing errors of one word count as that word.
    So the spellings of one organisation add nothing to the figure of its own word.
    """
    known = {*ordinary, *parts.LEGAL, *parts.NOISE, *parts.GIVEN, *parts.SHORT}
    long: dict[str, list[str]] = {}
    for w in ordinary:
        long.setdefault(w[0], []).append(w)
    whole = {w for w in known if len(w) > 3}

    @F.pandas_udf("boolean")
    def distinctive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def own(w: str) -> bool:
            if w in known or any(len(c) > len(w) + 1 and parts.abbreviates(w, c) for c in long.get(w[0], ())):
                return False
            joined = parts.split_joined(w, whole)
            return len(joined) == 1 or joined[0] not in whole

        for words in batches:
            yield pd.Series([own(w) for w in words])

    sides = near.select(F.col("a").alias("w"), F.col("b").alias("right")).unionByName(near.select(F.col("b").alias("w"), F.col("a").alias("right")))
    n = seen.select(F.col("w").alias("right"), F.col("n").alias("_n"))
    right = sides.join(n, "right").join(seen.select("w", "n"), "w").where(F.struct("_n", "right") > F.struct("n", "w")).groupBy("w").agg(F.max_by("right", F.struct("_n", "right")).alias("right"))
    words = seen.where(F.length("w") >= ONE_EDIT_FROM).select("w").join(right, "w", "left").select("w", F.coalesce("right", "w").alias("other"))
    words = stored(words.where(distinctive(F.col("other"))), "distinctive-words")
    each = read.select("name", F.explode(F.array_distinct("words")).alias("w"))
    some = each.join(frequent.select("w"), "w").select("name", F.col("w").alias("frequent"))
    by = some.join(each.join(words, "w").select("name", "other").distinct(), "name").where(F.col("other") != F.col("frequent"))
    pairs = by.groupBy("frequent", "other").agg(F.count("*").alias("n")).where(F.col("n") >= TOGETHER)
    return pairs.groupBy(F.col("frequent").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= COMPANIONS).select("w")


def link_names(names: DataFrame, name: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(name, class_id, path) of every distinct name that means somebody.

    ``path`` says how the name came to the others of its class: ``form`` (equal normal form),
    ``near`` (segment join) or ``shortened`` (dropped or shortened words).
    """
    ship(names.sparkSession)
    # stored before they are parted: the filter on words would else run below the distinct, on every row
    distinct = stored(names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct(), "distinct-names")
    read = stored(distinct.withColumn("words", _tokens()(F.col("name"))).where(F.size("words") > 0), "names")
    seen = stored(read.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "word-counts")
    some = stored(seen.where((F.col("n") >= 3) & (F.length("w") > 3)).withColumn("ordinary", _ordinary(vocabulary)(F.col("w"))), "frequent-words")
    counts = {r.w: r.n for r in some.where("ordinary").collect()}  # at most the tokenizer's vocabulary
    listed = [*parts.LEGAL, *parts.NOISE, *parts.GIVEN, *parts.SHORT]
    frequent = some.where(~F.col("ordinary") & (F.col("n") >= LEAST) & ~F.col("w").isin(listed))
    near = stored(near_forms(seen, "w"), "near-seen")
    general = stored(general_words(read, seen, frequent, set(counts), near), "general-words")
    more = {r.w: r.n for r in general.join(seen, "w").collect()}
    common = parts.common_words({**counts, **more}, counts.keys(), LEAST)
    counts |= more
    longest = max(map(len, common), default=1)
    whole = {w for w in (*common, *parts.GIVEN, *(x for x in parts.LEGAL if len(x) > 5)) if len(w) > 3}

    @F.pandas_udf("array<string>")
    def unjoin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[p for w in ws for p in ([w] if w in whole or w in parts.LEGAL else parts.split_joined(w, whole))] for ws in lists])

    parted = stored(read.select("name", unjoin(F.col("words")).alias("words")), "name-words")
    each = parted.select("name", F.posexplode("words").alias("at", "w"))
    near = stored(near_forms(each, "w"), "near-words")

    # typing errors in general words are mended; words that are themselves frequent are none
    spark = names.sparkSession
    rank = lambda w: float(counts.get(w, 0))
    known = spark.createDataFrame([(w, rank(w)) for w in sorted(whole)] or [("", 0.0)], "right string, n double")
    sides = near.select(F.col("a").alias("w"), F.col("b").alias("right"), "edits").unionByName(near.select(F.col("b").alias("w"), F.col("a").alias("right"), "edits"))
    often = [w for w, n in counts.items() if n >= LEAST]
    own = frequent.join(general, "w", "left_anti").select("w", F.col("n").alias("own"))
    mend = (
        sides.join(F.broadcast(known), "right").join(own, "w", "left").where(F.col("own").isNull() | (F.col("n") > MISTYPED * F.col("own")))
        .join(F.broadcast(known.select(F.col("right").alias("w"))), "w", "left_anti")  # general words, see above
        .where(~F.col("w").isin(often) if often else F.lit(True))
        .groupBy("w").agg(F.min_by("right", F.struct("edits", -F.col("n"), "right")).alias("right"))
    )
    mended = each.join(mend, "w", "left").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "w").alias("w")))).alias("l"))

    @F.pandas_udf("stem string, full array<string>, items array<string>")
    def profile(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = parts.Vocabulary(common)
        for lists in batches:
            yield pd.DataFrame([parts.profile(list(ws), vocabulary)[:3] for ws in lists], columns=["stem", "full", "items"])

    profiled = mended.select("name", profile(F.col("l.w")).alias("p")).select("name", "p.*")
    key = F.concat_ws("\x1f", "stem", F.concat_ws(" ", "full"), F.concat_ws(" ", "items"))
    profiled = stored(profiled.withColumn("node", key), "name-profiles")
    nodes = profiled.select("node", "stem", "full", "items").distinct().where(~F.col("stem").startswith("="))
    exact = nodes.where((F.size("items") == 0) & (F.size("full") > 0)).select("node", "stem", "full")

    # the segment join over normal forms: the other words equal, edits in the distinctive part
    stems = near.select("a", "b", "edits")
    forms = exact.select("node", "stem", F.concat_ws(" ", "full").alias("words"))
    met = near_forms(forms, "stem", "words")
    left, right = (forms.select(F.col("node").alias(c), F.col("stem").alias("_" + c), "words") for c in "ab")
    typed = met.withColumnsRenamed({"a": "_a", "b": "_b"}).join(left, ["_a", "words"]).join(right, ["_b", "words"]).select("a", "b")
    own = exact.select(F.col("node").alias("a"), F.col("node").alias("b"))
    first = components(typed.unionByName(own)).withColumnRenamed("label", "class")
    classes = stored(exact.join(first, "node").select("class", F.col("stem").alias("_stem"), F.col("full").alias("target")).distinct(), "name-classes")

    # dropped and shortened words, and words written together with the distinctive part
    reach = (
        nodes.select(F.col("stem"), F.col("stem").alias("_stem"), F.lit(0).alias("edits"), F.lit("").alias("rest")).distinct()
        .unionByName(stems.select(F.col("a").alias("stem"), F.col("b").alias("_stem"), "edits", F.lit("").alias("rest")))
        .unionByName(stems.select(F.col("b").alias("stem"), F.col("a").alias("_stem"), "edits", F.lit("").alias("rest")))
        .unionByName(
            nodes.select("stem").distinct().where(F.length("stem") > ONE_EDIT_FROM + 1)
            # what follows the distinctive part shortens a common word
            .withColumn("_cut", F.explode(F.sequence(F.greatest(F.lit(ONE_EDIT_FROM), F.length("stem") - longest), F.length("stem") - 2)))
            .select("stem", F.substring("stem", F.lit(1), F.col("_cut")).alias("_stem"), F.lit(0).alias("edits"), F.substring("stem", F.col("_cut") + 1, F.length("stem")).alias("rest"))
        )
    )

    @F.pandas_udf("boolean")
    def covers(full: pd.Series, items: pd.Series, rest: pd.Series, target: pd.Series) -> pd.Series:
        out = []
        for f, i, r, t in zip(full, items, rest, target, strict=True):
            f, i, t = list(f), list(i), list(t)
            extra = parts.joined_items(r, t) if r else []
            out.append(extra is not None and bool(len(t) > len(f) or i) and len(t) >= len(f) + len(i) + len(extra) and parts.fits(f, i + extra, t))
        return pd.Series(out)

    # a covering class has the first of the full words (or, without any, only the distinctive part in common)
    sure = F.filter("full", lambda w: ~w.endswith("."))
    looking = nodes.withColumn("_word", F.coalesce(F.try_element_at(sure, F.lit(1)), F.lit("")))
    offered = classes.withColumn("_word", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "target"))))
    options = (
        looking.join(reach, "stem").join(offered, ["_stem", "_word"]).join(first.withColumnRenamed("class", "_own"), "node", "left")
        .where(F.col("_own").isNull() | (F.col("_own") != F.col("class")))
        .where((F.size("target") >= F.size("full") + F.size("items")) & (F.size(F.array_except(sure, "target")) == 0))
        .where(covers("full", "items", "rest", "target"))
        .select(F.coalesce("_own", "node").alias("from"), "class", "target", "edits").groupBy("from", "class", "target").agg(F.min("edits").alias("edits"))
    )
    chosen = options.groupBy("from").agg(F.min("edits").alias("_least")).join(options, "from").where(F.col("edits") == F.col("_least"))
    # few classes can cover one name: they share its nearest distinctive part
    sets = chosen.groupBy("from").agg(F.collect_set(F.struct("class", "target")).alias("c"))
    wider = F.filter("c", lambda x: ~F.exists("c", lambda y: (F.size(y.target) > F.size(x.target)) & (F.size(F.array_except(x.target, y.target)) == 0)))
    one = sets.withColumn("c", F.array_distinct(F.transform(wider, lambda x: x["class"]))).where(F.size("c") == 1)
    joins = one.select(F.col("from").alias("a"), F.col("c")[0].alias("b"))
    links = first.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(joins)
    final = components(links)
    several = typed.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("_near", F.lit(True))
    short = joins.select(F.col("a").alias("node")).distinct().withColumn("_short", F.lit(True))
    via = F.when(F.col("_near"), "near").when(F.col("_short"), "shortened").otherwise("form")
    # an exact class that was joined as a whole is named by its class
    labelled = final.join(several, "node", "left").join(first, "node", "left").withColumn("_k", F.coalesce("class", "node"))
    labelled = labelled.join(short.withColumnRenamed("node", "_k"), "_k", "left").select("node", "label", via.alias("path"))
    return profiled.join(labelled, "node", "left").select("name", F.coalesce("label", "node").alias("class_id"), F.coalesce("path", F.lit("form")).alias("path"))


def pairs(linked: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of names of a class.

    A class of many names is cut into blocks: every name meets each block apart, so no task
    has more than one block of a class on its one side.
    """
    sizes = linked.groupBy("class_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1")
    split = linked.select("class_id", "name").join(sizes, "class_id", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    a = split.select("class_id", F.col("name").alias("name_a"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    b = split.select("class_id", F.col("name").alias("name_b"), F.pmod(F.xxhash64("name"), F.col("_blocks")).cast("int").alias("_block"))
    return a.join(b, ["class_id", "_block"]).where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
