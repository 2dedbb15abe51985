"""URL verdicts by longest host/path rule, then by an exact Bloom filter cascade. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

HASHES = 4
#: Largest filter that is put into a plan; lists beyond it are joined.
MAX_FILTER_BYTES = 1 << 24


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of ``key`` in the filter of a level."""
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + k), key), F.lit(bits)) for k in range(HASHES)]


class Cascade:
    """Bit arrays of the levels; odd levels hold listed keys, even levels false positives."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    def _in(self, key: Column, i: int) -> Column:
        bits, table = self.levels[i]

        def bit(words: Column, slot: Column) -> Column:
            byte = F.conv(F.hex(F.substring(words, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1

        # the table is bound once: each place that named it would hold a copy of its own
        probe = lambda words: F.forall(F.array(*_slots(key, i, bits)), lambda slot: bit(words, slot))
        return F.get(F.transform(F.array(F.unhex(F.lit(table.hex()))), probe), 0)

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self._in(key, i), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(universe: DataFrame, bits_per_key: int = 10, max_filter_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """A cascade over ``universe`` (key string, listed boolean; one row per key).

    Each level is a Bloom filter of the keys the level before let through
    wrongly, until none is left. Only bit arrays reach the driver; their size
    is checked against ``max_filter_bytes`` before anything is collected: None
    if a level is above it. An empty list gives a cascade without levels, which
    contains nothing.
    """
    levels: list[tuple[int, bytes]] = []
    left = staged(universe.where(F.col("key").isNotNull()), "keys")
    for level in range(64):
        want = F.col("listed") == F.lit(level % 2 == 0)
        n = left.where(want).count()
        if n == 0:
            return Cascade(levels)
        bits = max(64, 8 * math.ceil(n * bits_per_key / 8))
        if bits // 8 > max_filter_bytes:
            return None
        slots = left.where(want).select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("slot"))
        table = bytearray(bits // 8)
        packed = slots.groupBy(F.floor(F.col("slot") / 32).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(32)).cast("int"))).alias("b")
        )
        found = packed.toArrow()
        for w, b in zip(found["w"], found["b"], strict=True):
            table[4 * w.as_py() : 4 * w.as_py() + 4] = b.as_py().to_bytes(4, "little")[: len(table) - 4 * w.as_py()]
        levels.append((bits, bytes(table)))
        passed = Cascade([(0, b"")] * level + [levels[-1]])._in(F.col("key"), level)
        # the next level encodes what this one let through wrongly, against this level's own keys
        left = staged(left.where(want | passed), "keys")
    raise RuntimeError("the cascade did not settle in 64 levels")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules`` are (verdict, host, path); a rule fits its host and subdomains if
    the path starts with the rule's; of those that fit, the longest wins.
    Without a rule a page is blocked if its host or a parent of it is among
    ``listed`` (key string), by a Bloom filter cascade over all host suffixes
    of the corpus; where a filter would be above ``max_filter_bytes`` (about 13
    million listed keys that the corpus has), by a join of the distinct hosts
    instead, with the same verdicts. Null urls and urls without ``://`` have an empty host and
    path and are allowed. Repeated rows are judged alike; other columns are
    ignored; no rows give no rows.
    """
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    corpus = rows.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    tagged = corpus.withColumn("seen", F.lit(True)).withColumn("listed", F.lit(False)).unionByName(
        listed.select("key").withColumn("seen", F.lit(False)).withColumn("listed", F.lit(True))
    )
    universe = tagged.groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed")).where("seen")
    cascade = build_cascade(universe.select("key", "listed"), max_filter_bytes=max_filter_bytes)
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        by_rule = F.when(fits, F.lit(verdict)).otherwise(by_rule)
    if cascade is not None:
        blocked = F.exists(suffixes(F.col("host")), cascade.contains)
    else:
        bad = rows.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = bad.join(listed.select("key"), "key", "left_semi").select("host", F.lit(True).alias("bad")).distinct()
        rows = rows.join(bad, "host", "left")
        blocked = F.coalesce("bad", F.lit(False))
    return rows.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(by_rule, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
