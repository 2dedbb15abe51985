"""A corpus pipeline: toxicity filter, exact and near deduplication, source mixing, tokenizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm.common import WORD, staged
from docloom.llm.exact_dedup import exact_dedup, normalised
from docloom.llm.jaccard import jaccard_components
from docloom.llm.mixing import mix_sources
from docloom.llm.queries import token_digests
from docloom.llm.toxicity import fit_toxicity, reject_toxic

#: The toxicity network can't be written in SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def free(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, as no column of ``docs`` is called."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network fitted to the labels does not predict toxic; all columns as they are.

    Null and empty texts are scored as texts without words, and stay unless the
    network holds such texts for toxic; texts are read whole, however long.
    Repeated rows share their fate; null ids are scored like others. Without
    labels, or with labels of one class only, all rows get the class's share as
    their score. No rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_toxic(docs, fit_toxicity(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one row that exact_dedup keeps; all columns as they are.

    Null counts as the empty text: one of all such rows stays. Of rows that
    share id and text the longest original text stays, then the first by its
    content; rows that share an id only are compared by their texts. Null ids
    stay where a group has no other. No rows give no rows.
    """
    keep = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("keep_id"), F.unhex("text_sha256").alias("keep_text"))
    digest, nth, whole = free(docs, "__text"), free(docs, "__nth"), free(docs, "__row")
    rows = with_row(docs, whole).withColumn(digest, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    keep = keep.distinct().withColumnsRenamed({"keep_id": free(rows, "keep_id"), "keep_text": free(rows, "keep_text")})
    same = F.col("doc_id").cast("long").eqNullSafe(keep[keep.columns[0]]) & (F.col(digest) == keep[keep.columns[1]])
    one = Window.partitionBy("doc_id", digest).orderBy(F.desc_nulls_last(F.length("text")), whole)
    rows = rows.join(keep, same, "left_semi").withColumn(nth, F.row_number().over(one))
    return rows.where(F.col(nth) == 1).select(*docs.columns)


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a hash of each row's whole content: rows that share it are alike in every column."""
    return docs.withColumn(name, F.unhex(F.sha2(F.to_json(F.struct(*docs.columns)), 256)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles, directly or through others, the one row with the smallest doc_id (null last,
    then by content); all rows whose texts have no words, null and empty ones among them. All columns as they are.

    Rows are told apart by their whole content, not by their id: of rows alike
    in every column one stays, rows that share an id only are judged each on
    its own. No rows give no rows.
    """
    row, nth, one = free(docs, "__row"), free(docs, "__nth"), free(docs, "__one")
    found = jaccard_components(with_row(docs, row), row=row).select(row, "component_key", "doc_id")
    first = Window.partitionBy("component_key").orderBy(F.asc_nulls_last("doc_id"), row)
    linked = found.where("component_key is not null").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    keep = linked.select(row, F.lit(True).alias(one)).unionByName(
        found.where("component_key is null").select(row, F.lit(False).alias(one)).distinct()
    )
    rows = with_row(docs, row).join(keep, row)
    same = Window.partitionBy(row).orderBy(row)
    return rows.withColumn(nth, F.row_number().over(same)).where(~F.col(one) | (F.col(nth) == 1)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each time a document is taken whole, and one with the words of a part, with single spaces;
    the columns of ``docs``, with text and n_chars of what is taken.

    Null and empty texts, and sources of such texts only, are never taken. Each
    row has its own plan, by its whole content: rows that share an id, null
    ids among them, are taken each on its own, rows alike in every column as
    often as their plans say together. Reruns agree. No rows give no rows.
    """
    row, held, got = free(docs, "__row"), free(docs, "__plan"), free(docs, "__taken")
    keyed = with_row(docs, row)
    plan = mix_sources(keyed, row=row).where("taken > 0").select(row, F.struct("size", "whole", "part_from", "part_to").alias(held))
    of = lambda c: F.col(held)[c]
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    ahead = F.slice(words, (of("part_from") + 1).cast("int"), (F.least(of("part_to"), of("size")) - of("part_from")).cast("int"))
    again = F.slice(words, F.lit(1), F.greatest(of("part_to") - of("size"), F.lit(0)).cast("int"))
    part = F.when(of("part_to") > of("part_from"), F.array(F.array_join(F.concat(ahead, again), " ")))
    taken = F.concat(F.array_repeat("text", of("whole").cast("int")), F.coalesce(part, F.array().cast("array<string>")))
    # rows alike in every column are one here; each has its own plan
    rows = keyed.dropDuplicates([row]).join(plan, row).withColumn(got, F.explode(taken))
    columns = {"text": F.col(got), "n_chars": F.length(got).cast("long")}
    return rows.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the text decoded from them: doc_id, n_tokens, ids_sha256,
    decoded_sha256, one row per row of ``docs``.

    Null and empty texts have no ids and the digests of nothing; texts are
    encoded whole, however long; repeated rows give repeated rows, null ids
    stay null; other columns are ignored; no rows give no rows.
    """
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return token_digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
