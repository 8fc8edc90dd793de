"""Mixing sources to target weights.

The size of a mix is cut into equal-token blocks. Sainte-Lague apportionment with the
target shares as weights (the next block goes to the source with the highest quotient
weight / (2 * blocks + 1)) gives each source its number of blocks; a source that has used
up its allowed repeats drops out and the quotients of the others decide, so that shares
stay as close to their targets as the repeats allow. The same rule then splits a source's
blocks over its shards, in proportion to their tokens.

A shard is a hash class of documents small enough for one task; its documents stand in
seeded order and are cut into blocks by running token sums, a document belonging to the
block that holds its middle. A quota of q blocks of c gives every document q // c copies
and one more to the documents of q % c consecutive blocks from a seeded place, which in a
shuffled order is a random selection of blocks. Shards are apportioned in two levels: the
driver sees sums of groups of about the square root of a source's shards, and each group
is apportioned to its shards in a task of its own, so the number of shards has no bound.

Documents without tokens, without id or of a source outside of the mix are not drawn, but
all tokens count for the size of the corpus. Sources without documents get nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.materialize import stored

BLOCK_TOKENS = 1024
SHARD_TOKENS = 50_000_000


def normal_source(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients; nobody gets more than their cap; ties go to the first."""
    n = len(weights)
    alloc = [0] * n
    live = [w > 0 and c > 0 for w, c in zip(weights, caps, strict=True)]
    seats = min(seats, sum(c for c, x in zip(caps, live, strict=True) if x))
    if not seats:
        return alloc
    at = lambda x: [min(c, math.floor(w * x + 0.5)) if a else 0 for w, c, a in zip(weights, caps, live, strict=True)]
    lo, hi = 0.0, 1.0
    while sum(at(hi)) < seats:
        hi *= 2
    for _ in range(200):  # a divisor just short of the seats, then the last quotients one by one
        mid = (lo + hi) / 2
        if sum(at(mid)) < seats:
            lo = mid
        else:
            hi = mid
    alloc = at(lo)
    heap = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, alloc, strict=True)) if live[i] and a < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(alloc)):
        _, i = heapq.heappop(heap)
        alloc[i] += 1
        if alloc[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * alloc[i] + 1), i))
    return alloc


@dataclass(frozen=True)
class Plan:
    """Documents placed in shards, the shards' blocks, and the blocks that each group of shards of a mix's source gets."""

    placed: DataFrame
    shards: DataFrame
    quotas: list[tuple]


def plan(docs: DataFrame, targets: Sequence[Mapping], seed: int = 17, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> Plan:
    """Seats of every source of every mix, and of its groups of shards: (mix_name, source, group, quota, max_repeats)."""
    named = [dict(t) for t in targets]
    for t in named:
        t["source"] = (t["source"] or "").strip().lower().replace("-", "_")
    wanted = sorted({t["source"] for t in named})
    docs = docs.select("doc_id", normal_source(F.col("source")).alias("source"), "n_tokens")
    whole = docs.agg(F.sum("n_tokens")).first()[0] or 0
    usable = docs.where(F.col("source").isin(wanted) & (F.col("n_tokens") > 0) & F.col("doc_id").isNotNull())
    sums = {r[0]: r[1] for r in usable.groupBy("source").agg(F.sum("n_tokens")).collect()}
    count, width = F.lit(1), F.lit(1)
    for s, n in sums.items():
        k = max(1, math.ceil(n / shard_tokens))
        count = F.when(F.col("source") == s, F.lit(k)).otherwise(count)
        width = F.when(F.col("source") == s, F.lit(max(1, math.isqrt(k)))).otherwise(width)
    place = F.xxhash64(F.lit(seed), "doc_id")
    placed = usable.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), count.cast("long")).cast("int")).withColumn("_place", place)
    held = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held"))
    held = held.withColumns({"blocks": F.greatest(F.lit(1), F.round(F.col("held") / block_tokens)).cast("long"), "group": F.floor(F.col("shard") / width).cast("int")})
    shards = stored(held, "mix-shards")
    # about the square root of the number of shards
    groups = {(r[0], r[1]): r[2] for r in shards.groupBy("source", "group").agg(F.sum("blocks")).collect()}

    quotas = []
    for mix in sorted({t["mix_name"] for t in named}):
        rows = sorted((t for t in named if t["mix_name"] == mix), key=lambda t: t["source"])
        own = [[k for k in sorted(groups) if k[0] == t["source"]] for t in rows]
        caps = [t["max_repeats"] * sum(groups[k] for k in keys) for t, keys in zip(rows, own, strict=True)]
        seats = round(rows[0]["corpus_fraction"] * whole / block_tokens)
        for t, keys, q in zip(rows, own, sainte_lague([t["target_share"] for t in rows], seats, caps), strict=True):
            parts = sainte_lague([groups[k] for k in keys], q, [t["max_repeats"] * groups[k] for k in keys])
            quotas += [(mix, *k, part, t["max_repeats"]) for k, part in zip(keys, parts, strict=True) if part]
    return Plan(placed, shards, quotas)


_SHARD = "mix_name string, source string, shard int, quota long, blocks long, held long"


def _apportion(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one group of one mix to the shards of the group."""
    rows = rows.sort_values("shard")
    blocks = rows["blocks"].tolist()
    parts = sainte_lague(blocks, int(rows["quota"].iloc[0]), [int(m) * b for m, b in zip(rows["max_repeats"], blocks, strict=True)])
    return rows.assign(quota=parts)[["mix_name", "source", "shard", "quota", "blocks", "held"]]


def draw(docs: DataFrame, targets: Sequence[Mapping], seed: int = 17, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, copies) of the drawn documents.

    ``docs`` has doc_id, source, n_tokens and should be stored: it is read three times.
    ``targets`` are the rows of the mixes (a bounded table): mix_name, source,
    target_share, max_repeats, corpus_fraction.
    """
    spark = docs.sparkSession
    p = plan(docs, targets, seed, block_tokens, shard_tokens)
    wide = spark.createDataFrame(p.quotas, "mix_name string, source string, group int, quota long, max_repeats long")
    table = p.shards.join(wide, ["source", "group"]).groupBy("mix_name", "source", "group").applyInPandas(_apportion, _SHARD).where("quota > 0")
    table = table.withColumn("first", F.pmod(F.xxhash64(F.lit(seed + 2), "mix_name", "source", "shard"), F.col("blocks")))

    before = F.sum("n_tokens").over(Window.partitionBy("source", "shard").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2
    # a row per mix and shard; by the keys of the window, so documents are shuffled once
    joined = p.placed.withColumn("_middle", before).join(table, ["source", "shard"])
    at = F.least(F.floor(F.col("_middle") / (F.col("held") / F.col("blocks"))), F.col("blocks") - 1)
    ring = F.pmod(at - F.col("first"), F.col("blocks"))
    copies = F.floor(F.col("quota") / F.col("blocks")) + F.when(ring < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    return joined.select("mix_name", "doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def source_seats(p: Plan) -> list[tuple]:
    """(mix_name, source, blocks) of sources that get any."""
    seats: dict[tuple, int] = {}
    for mix, source, _, quota, _ in p.quotas:
        seats[mix, source] = seats.get((mix, source), 0) + quota
    return [(*k, n) for k, n in sorted(seats.items())]


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target, documents, copies, tokens and the share really reached."""
    key = ["mix_name", "source"]
    got = drawn.groupBy(*key).agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    goal = targets.select("mix_name", normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    all_rows = goal.join(got, key, "left").fillna(0, ["documents", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return all_rows.withColumn("reached_share", F.round(F.col("tokens") / F.when(total > 0, total), 6))
