"""Mixing sources to target weights: blocks of equal tokens apportioned by highest quotients (Sainte-Laguë)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Tokens of a block at most; tokens of a shard, until a source has MAX_SHARDS (one task apportions a source's shards, a row
#: each; beyond, shards grow); sources at most (their totals are held on the driver).
BLOCK = 64
SHARD = 1 << 18
MAX_SHARDS = 1 << 20
MAX_SOURCES = 1 << 20


def water_fill(sizes: list[int], weights: list[int], share: tuple[int, int] = (3, 2), cap: int = 2) -> list[float]:
    """Targets that share ``share`` of all sizes by weight; none above ``cap`` times its size, the excess reshared."""
    num, den = share
    rest, total = num * sum(sizes), sum(weights)  # rest and caps are scaled by den, so that all is in integers
    out = [0.0] * len(sizes)
    for k, i in enumerate(order := sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])):
        if rest * weights[i] < den * cap * sizes[i] * total:
            for j in order[k:]:
                out[j] = rest * weights[j] / (den * total)
            break
        out[i] = float(cap * sizes[i])
        rest, total = rest - den * cap * sizes[i], total - weights[i]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Integer seats by the highest quotients votes / (2 s + 1); none above its cap.

    Starts just below the proportional share, which the method never leaves by
    many seats, and gives out the rest one by one. Ties go to the lower index.
    """
    caps = caps or [seats] * len(votes)
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    # the common divisor d: every party holds at least floor(v / d + 1/2) seats for any d above the final one
    low, high = total / (2 * seats + 2 * len(votes) + 2), 2 * max(votes) + 1.0
    given = lambda d: [min(c, int(v / d + 0.5)) for v, c in zip(votes, caps, strict=True)]
    while sum(given(low)) < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(given(mid)) > seats else (low, mid)
    out = given(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    """Integer block quotas of the shards of one source, and the seeded start of each selection."""
    group = group.sort_values("shard")
    n = [int(x) for x in group["blocks"]]
    group["quota"] = sainte_lague([float(x) for x in group["tokens"]], int(group["seats"].iloc[0]), [2 * x for x in n])
    return group[["src", "shard", "blocks", "tokens", "quota", "seats"]]


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = 17,
    row: str | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, source,
    whole (times the whole text is taken), part_from and part_to (words taken once more; equal: none; beyond
    the size they go on at the front); and ``row``, a column that names the rows, where given.

    Size is the number of words; sources in code point order, null last, weigh
    ``weights`` in turn. Targets are filled into blocks of equal tokens: the
    sources get integer block quotas by highest quotients, then the shards of
    each source (seeded slices of its documents, about ``shard`` tokens each,
    so that a hot source is many tasks). In a shard the documents lie end to
    end in seeded order; the quota takes all blocks whole rounds, then a run
    of blocks from a seeded start, which cuts at most two documents.

    A block has ``block`` tokens, or a thousandth of the smallest target above
    0 if that is less (a word at least), so that each target is met to about
    that share. More than MAX_SOURCES sources raise an error.

    Null and empty texts have size 0 and are never taken; a source whose sizes
    are all 0 has target 0. Rows that repeat a doc_id are taken on their own;
    their order in a shard follows their content. Other columns are ignored;
    no rows give no rows. Equal input gives equal output, however partitioned.
    """
    named = [row] if row else []
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("src"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("lot"),  # rows that share an id spread over the shards too
            *named,
        ),
        "sized",
    )
    totals = sized.groupBy("src").agg(F.sum("size").alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["src"] is None, r["src"] or ""))
    sizes = [int(r["t"] or 0) for r in totals]
    weigh = [weights[i % len(weights)] for i in range(len(totals))]
    targets = water_fill(sizes, weigh, share, cap)
    least = min((t for t in targets if t > 0), default=0.0)
    block = max(1, min(block, int(least / 1000)))
    seats = sainte_lague(targets, round(sum(targets) / block), [cap * -(-s // block) for s in sizes])
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r["src"], s, t, q, min(MAX_SHARDS, max(1, -(-s // shard)))) for r, s, t, q in zip(totals, sizes, targets, seats, strict=True)],
        "src string, source_size long, target double, seats long, shards long",
    )
    # the number of sources is checked above, so the plan may be broadcast
    same = F.col("a.src").eqNullSafe(F.col("b.src"))
    dealt = (
        sized.alias("a")
        .join(F.broadcast(plan.alias("b")), same)
        .select("doc_id", "a.src", "size", "lot", "source_size", "target", "seats", F.pmod(F.shiftright("lot", 20), "shards").alias("shard"), *named)
    )
    shards = (
        dealt.groupBy("src", "shard")
        .agg(F.sum("size").alias("tokens"), F.max("seats").alias("seats"))
        .withColumn("blocks", F.ceil(F.col("tokens") / block))
    )
    quotas = shards.groupBy("src").applyInPandas(
        _shard_quotas, "src string, shard long, blocks long, tokens long, quota long, seats long"
    )
    line = Window.partitionBy("src", "shard").orderBy("lot", "doc_id", "size", *named).rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    quota = staged(quotas.select(F.col("src").alias("q_src"), F.col("shard").alias("q_shard"), "blocks", "tokens", "quota"), "quotas")
    both = laid.join(quota, F.col("src").eqNullSafe(F.col("q_src")) & (F.col("shard") == F.col("q_shard")))
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))
    more = F.col("quota") - rounds * F.col("blocks")
    start = F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), F.greatest("blocks", F.lit(1)))
    # a run of `more` blocks from `start`, which may go on at the front of the line
    stop = start + more
    run_a, run_b = start * block, F.least(stop * block, "tokens")
    wrap_b = F.greatest(stop - F.col("blocks"), F.lit(0)) * block
    inside = lambda lo, hi: F.greatest(F.least("end", hi) - F.greatest("begin", lo), F.lit(0))
    tail, head = inside(run_a, run_b), inside(F.lit(0), wrap_b)
    both = both.select("*", rounds.alias("whole"), tail.alias("tail"), head.alias("head"), run_a.alias("run_a"))
    extra = F.col("tail") + F.col("head")
    full = (extra == F.col("size")) & (F.col("size") > 0)
    part_from = F.when(F.col("tail") > 0, F.greatest(F.col("run_a") - F.col("begin"), F.lit(0))).otherwise(F.lit(0))
    return both.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).alias("taken"),
        F.col("src").alias("source"),
        (F.col("whole") + full.cast("int")).alias("whole"),
        F.when(full, F.lit(0)).otherwise(part_from).cast("long").alias("part_from"),
        F.when(full, F.lit(0)).otherwise(part_from + extra).cast("long").alias("part_to"),
        *named,
    )
