"""Rank correlations of many signals with many returns by segment, in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.materialize import stored
from tidemark.operators.ranks import BANDS, spearman


def long_form(df: DataFrame, keep: Sequence[str], signals: Sequence[str], returns: Mapping[int, str]) -> DataFrame:
    """(keep, signal, horizon, x, y): one row per row, signal and horizon with both values."""
    cells = [F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).cast("double").alias("x"), F.col(r).cast("double").alias("y")) for s in signals for h, r in returns.items()]
    rows = df.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def ic_table(df: DataFrame, segment: Column | None, signals: Sequence[str], returns: Mapping[int, str], min_rows: int = 3, unknown: str | None = "UNKNOWN") -> DataFrame:
    """(segment, signal, horizon, n, ic); without ``segment`` the whole. Segments under ``min_rows`` pairs are left out."""
    if segment is None:
        rows, by = long_form(df, [], signals, returns), ["signal", "horizon"]
    else:
        name = F.coalesce(segment.cast("string"), F.lit(unknown)) if unknown else segment.cast("string")
        rows, by = long_form(df.withColumn("segment", name), ["segment"], signals, returns), ["segment", "signal", "horizon"]
    out = spearman(rows, by, "x", "y")
    return out.where(F.col("n") >= min_rows) if min_rows > 3 else out


def summary(df: DataFrame, signals: Sequence[str], returns: Mapping[int, str], n_buckets: int = 10) -> DataFrame:
    """(signal, horizon, n, ic, top_minus_bottom): rank correlation of each signal with each return, and the mean return of its highest bucket less that of its lowest.

    The same as ``ic_table`` and ``portfolio.top_minus_bottom`` of the whole, for many returns; NaN is no value.
    A row is exploded over signals only and carries its returns. The values of a signal are counted for all
    horizons at once; their running counts, within value bands, give ranks and exact quantiles. The ranks of
    the returns come from the sums of the signal's ranks at each return, so no row is joined a second time.
    Cut points, ranks, edges of buckets and counts of bands are stored: each is computed once, and the driver
    plans a few small queries, since adaptive execution plans all of a query again after each of its stages.
    """
    hs = [*returns]
    js, one, ends = range(len(hs)), Window.unboundedPreceding, ["s", "j"]
    value = lambda c, name: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(name)
    xs, ys = [f"x{i}" for i in range(len(signals))], [f"y{j}" for j in js]
    wide = df.select(*[value(c, n) for c, n in zip(signals, xs, strict=True)], *[value(c, n) for c, n in zip(returns.values(), ys, strict=True)])
    # cut points of values, by signal and by horizon; any would do
    edges = stored(wide.agg(*[F.percentile_approx(c, [i / BANDS for i in range(1, BANDS)], 1000).alias(c) for c in [*xs, *ys]]), "cut-points")

    def banded(d: DataFrame, key: str, cols: list[str], v: str) -> DataFrame:
        """With ``b``, how many of the ordered cut points lie under ``v``, by halving; BANDS is a power of two."""
        d = d.join(F.broadcast(edges.select(F.posexplode(F.array(*cols)).alias(key, "_e"))), key).withColumn("b", F.lit(0))  # a row per signal or horizon
        half = BANDS // 2
        while half:
            d = d.withColumn("b", F.col("b") + F.when(F.col("_e")[F.col("b") + (half - 1)] < F.col(v), half).otherwise(0))
            half //= 2
        return d.drop("_e")

    # ranks of signals, about their mean: a row per signal and value, a column per horizon
    rows = wide.select(F.posexplode(F.array(*xs)).alias("s", "x"), *ys).where(F.col("x").isNotNull() & F.coalesce(*ys).isNotNull())
    counts = banded(rows.groupBy("s", "x").agg(*[F.count(y).alias(f"c{j}") for j, y in enumerate(ys)]), "s", xs, "x")
    totals = counts.groupBy("s", "b").agg(*[F.sum(f"c{j}").alias(f"t{j}") for j in js])
    lower, whole = Window.partitionBy("s").orderBy("b").rowsBetween(one, -1), Window.partitionBy("s")
    totals = totals.select("s", "b", *[F.coalesce(F.sum(f"t{j}").over(lower), F.lit(0)).alias(f"l{j}") for j in js], *[F.sum(f"t{j}").over(whole).alias(f"n{j}") for j in js])
    within = Window.partitionBy("s", "b").orderBy("x").rowsBetween(one, 0)
    ranked = counts.withColumns({f"m{j}": F.sum(f"c{j}").over(within) for j in js}).join(F.broadcast(totals), ["s", "b"])  # BANDS rows per signal
    ranked = stored(ranked.select("s", "x", *[F.col(f"c{j}") for j in js], *[(F.col(f"l{j}") + F.col(f"m{j}")).alias(f"m{j}") for j in js], *[F.col(f"n{j}") for j in js]), "signal-ranks")

    # the inner edges of the outer buckets, from the values at the wanted places
    n, below, upto = F.col("n"), F.col("m") - F.col("c"), F.col("m")
    # a wanted place lies between the places of the value, or just beside them
    near = lambda j: (F.col(f"c{j}") > 0) & ((n_buckets * F.col(f"m{j}")) % F.greatest(F.col(f"n{j}") - 1, F.lit(1)) <= n_buckets * (F.col(f"c{j}") + 1))
    some = F.lit(False)
    for j in js:
        some = some | near(j)
    places = F.array(*[F.struct(F.lit(j).alias("j"), *[F.col(f"{k}{j}").alias(k) for k in "cmn"]) for j in js])
    few = ranked.where(some).select("s", "x", F.explode(places).alias("p")).select("s", "x", "p.*").where((below < upto) & (n >= n_buckets))
    at = lambda r: F.min(F.when(upto > r, F.col("x")))
    place = [(n - 1) * F.lit(float(i / n_buckets)) for i in range(n_buckets + 1)]
    picked = few.repartition(*ends).groupBy(*ends).agg(F.max("n").alias("n"), *[a.alias(f"{k}{i}") for i, r in enumerate(place) for k, a in (("a", at(F.floor(r))), ("z", at(F.ceil(r))))])
    quantile = F.array_distinct(F.array(*[F.col(f"a{i}") + (F.col(f"z{i}") - F.col(f"a{i}")) * (r - F.floor(r)) for i, r in enumerate(place)]))
    inner = picked.select(*ends, quantile.alias("e")).where(F.size("e") >= 3).select(*ends, F.col("e")[1].alias("lo"), F.element_at("e", -2).alias("hi"))
    inner = stored(inner.groupBy("s").agg(*[F.max(F.when(F.col("j") == j, F.col(k))).alias(f"{k}{j}") for j in js for k in ("lo", "hi")]), "bucket-edges")

    # sums at each return, then the ranks of returns
    centred = [(F.col(f"m{j}") - (F.col(f"c{j}") - 1) / 2.0 - (F.col(f"n{j}") + 1) / 2.0).alias(f"d{j}") for j in js]
    placed = rows.join(ranked.select("s", "x", *centred), ["s", "x"]).join(F.broadcast(inner), "s", "left")  # a row per signal
    cell = F.array(*[F.struct(F.lit(j).alias("j"), F.col(y).alias("y"), F.col(f"d{j}").alias("d"), (F.col("x") <= F.col(f"lo{j}")).alias("low"), (F.col("x") > F.col(f"hi{j}")).alias("high")) for j, y in enumerate(ys)])
    cells = placed.select("s", F.explode(cell).alias("c")).select("s", "c.*").where(F.col("y").isNotNull())
    d = F.col("d")
    sums = cells.groupBy(*ends, "y").agg(F.count(F.lit(1)).alias("c"), F.sum(d).alias("d"), F.sum(d * d).alias("dd"), F.count_if("low").alias("low"), F.count_if("high").alias("high"))
    totals = wide.select(F.posexplode(F.array(*ys)).alias("j", "y"), *xs).where(F.col("y").isNotNull() & F.coalesce(*xs).isNotNull())
    totals = banded(totals, "j", ys, "y").groupBy("j", "b").agg(*[F.count(x).alias(x) for x in xs])
    totals = totals.select("j", "b", F.posexplode(F.array(*xs)).alias("s", "t"))
    lower, whole = Window.partitionBy(*ends).orderBy("b").rowsBetween(one, -1), Window.partitionBy(*ends)
    totals = totals.select(*ends, "b", F.coalesce(F.sum("t").over(lower), F.lit(0)).alias("l"), F.sum("t").over(whole).alias("n"))
    totals = stored(totals, "band-counts")
    within = Window.partitionBy(*ends, "b").orderBy("y").rowsBetween(one, 0)
    both = banded(sums, "j", ys, "y").withColumn("m", F.sum("c").over(within)).join(F.broadcast(totals), [*ends, "b"])  # BANDS rows per signal and horizon
    both = both.withColumn("e", F.col("l") + F.col("m") - (F.col("c") - 1) / 2.0 - (n + 1) / 2.0)
    mean = lambda k: F.sum(F.when(F.col(k) > 0, F.col("y") * F.col(k))) / F.sum(k)
    e, spread = F.col("e"), F.sqrt(F.sum("dd")) * F.sqrt(F.sum(F.col("c") * F.col("e") * F.col("e")))
    out = both.groupBy(*ends).agg(F.sum("c").alias("n"), (F.sum(e * d) / F.when(spread > 0, spread)).alias("ic"), F.when(F.sum("low") > 0, mean("high") - mean("low")).alias("top_minus_bottom"))
    names = [F.element_at(F.array(*[F.lit(v) for v in vs]), F.col(k) + 1).alias(name) for vs, k, name in ((signals, "s", "signal"), (hs, "j", "horizon"))]
    return out.select(*names, "n", F.when(n >= 3, F.col("ic")).alias("ic"), "top_minus_bottom")


CELL = ["segment", "signal", "horizon"]


def part_table(df: DataFrame, segment: str, part: Column, signals: Sequence[str], returns: Mapping[int, str]) -> DataFrame:
    """(segment, part, signal, horizon, n, ic): the correlations of every part (a quarter, a year) of every segment."""
    rows = long_form(df.withColumns({"segment": F.col(segment), "part": part}), ["segment", "part"], signals, returns)
    return spearman(rows.where(F.col("part").isNotNull()), ["segment", "part", "signal", "horizon"], "x", "y")


def same_sign(overall: DataFrame, parts: DataFrame) -> DataFrame:
    """``overall`` with n_parts, the parts that have a correlation, and same_sign, those of its own sign."""
    signs = parts.groupBy(*CELL).agg(F.count("ic").alias("n_parts"), F.count_if(F.col("ic") > 0).alias("_up"), F.count_if(F.col("ic") < 0).alias("_down"))
    same = F.when(F.col("ic") > 0, F.col("_up")).when(F.col("ic") < 0, F.col("_down"))
    out = overall.join(signs, CELL, "left")
    return out.withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "same_sign": F.coalesce(same, F.lit(0))}).drop("_up", "_down")


def parts_needed(n: Column, usual: int = 3) -> Column:
    """Parts of one sign that a stable cell needs: ``usual``, or three quarters of fewer than four."""
    return F.when(n >= 4, F.lit(usual)).otherwise(F.greatest(F.lit(1), F.bround(n * 0.75).cast("int")))


def pivoted(cells: DataFrame, parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``cells`` with a column ic_<part> for each of the named parts."""
    wide = parts.groupBy(*CELL).pivot("part", list(names)).agg(F.first("ic"))
    return cells.join(wide.withColumnsRenamed({n: f"ic_{n}" for n in names}), CELL, "left")


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(signal, n, pct): non-null values of each column."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("n")) for c in cols])
    return counts.select("_n", F.explode(cells).alias("_c")).select("_c.signal", "_c.n", F.round(100.0 * F.col("_c.n") / F.when(F.col("_n") > 0, F.col("_n")), 2).alias("pct"))
