"""The operators' queries over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .cross_entropy import fit_models, score_difference
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .jaccard import jaccard_components
from .lang_crf import fit_languages, label_languages
from .mixing import mix_sources
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import url_verdicts
from .vector_dedup import vector_components

#: (verdict, host, path); the longest that fits a url wins.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Hosts listed for blocking, with their subdomains, on each example domain.
BAD_NAMES = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]
BAD_HOSTS = [f"{n}.example.{t}" for n in BAD_NAMES for t in ("com", "net", "org")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = label_languages(docs, fit_languages(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_windows", "worst_word")


def token_digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Number and digest of the ids, and digest of the decoded bytes."""
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return token_digests(encoded, ranks)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_difference(docs, fit_models(docs, good))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in BAD_HOSTS], "key string")
    return url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_jaccard": op3_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_html_text": op7_html_text,
    "op8_lm_score": op8_lm_score,
    "op9_url_filter": op9_url_filter,
    "op10_vector_dedup": op10_vector_dedup,
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLES = {
    "op6_exact_dedup": f"""
WITH rows AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents
), kept AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY (doc_id IS NULL), n DESC, doc_id) AS keep_id
  FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM kept
""",
    "op9_url_filter": """
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES %s
), fits AS (
  SELECT s.page_id, s.host, s.path,
         max_by(r.rh || r.rp, length(r.rh || r.rp)) AS rule, max_by(r.verdict, length(r.rh || r.rp)) AS by_rule
  FROM split s LEFT JOIN rules r ON (s.host = r.rh OR ends_with(s.host, '.' || r.rh)) AND starts_with(s.path, r.rp)
  GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN regexp_matches(host, '^(.*\\.)?(%s)\\.example\\.(com|net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""
    % (", ".join(map(str, URL_RULES)), "|".join(BAD_NAMES)),
}
