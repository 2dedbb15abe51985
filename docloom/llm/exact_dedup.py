"""Exact deduplication by content hash, with the bytes compared inside hash groups. DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, staged


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def exact_dedup(docs: DataFrame, content_hash=F.md5, text_hash=lambda c: F.sha2(c, 256)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space (null: empty).
    Groups form on (128-bit hash, normalised bytes): the bytes are compared, so
    texts of one hash stay apart. The partial aggregate leaves at most one row
    per group and input task, so a hot group does not reach one task. A row
    finds its group by both digests; where two groups share both, which a count
    tells, by the bytes as well. Of a group the row with the most code points,
    then the smallest doc_id stays. Rows that repeat a doc_id share its fate;
    null ids stay only if a group has no other. Other columns of ``docs`` are
    ignored; no rows give no rows.
    """
    norm = normalised(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).alias("n"),
        norm.alias("norm"),
    ).withColumn("h", F.unhex(content_hash("norm")))
    # one decimal orders the rows of a group: an id at all, code points, the smaller id; hash aggregates hold decimals
    place, top = F.lit(Decimal(10**20)), F.lit(Decimal(2**63 - 1))
    rank = F.when(F.col("doc_id").isNotNull(), F.col("n").cast("decimal(10,0)") * place + (top - F.col("doc_id").cast("decimal(19,0)")))
    groups = rows.select("h", "norm", rank.cast("decimal(38,0)").alias("rank")).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"))
    keep = (top - F.col("best") % place).cast("long")
    found = groups.select("h", F.unhex(text_hash("norm")).alias("s"), "group_size", keep.alias("keep_id"))
    found = staged(found, "groups")  # two plain shuffles below the join, so that a hot key's partition can be split
    twins = found.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "s")
    key = ["h", "s"]
    own = rows.select("doc_id", "h", F.unhex(text_hash("norm")).alias("s"), "norm")
    if twins.limit(1).count():
        twins = staged(twins, "twins")
        apart = groups.select("h", F.unhex(text_hash("norm")).alias("s"), "norm", "group_size", keep.alias("keep_id")).join(twins, key, "left_semi")
        joined = own.join(apart, [*key, "norm"]).select("doc_id", "keep_id", "group_size", "s")
        plain = own.drop("norm").join(found.join(twins, key, "left_anti"), key)
        joined = joined.unionByName(plain.select("doc_id", "keep_id", "group_size", "s"))
    else:
        joined = own.drop("norm").join(found, key)
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )
