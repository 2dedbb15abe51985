"""Rules that need one object at a time, over a stream of value nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def stream_value_rules(nodes: DataFrame) -> DataFrame:
    """doc_id, code, path of numbers, names, strings and streams that break a rule of their own. Stateless; for readStream."""
    kind = F.col("kind")
    code = (
        F.when((kind == "number") & (~S.is_finite("num_val") | ((F.col("num_val") == F.rint("num_val")) & ~S.is_safe_integer("num_val"))), "invalid-number")
        .when((kind == "name") & ~S.is_name("text_val"), "invalid-name")
        .when((kind == "byte-name") & ~S.is_name_bytes("bytes_val"), "invalid-name")
        .when(kind.isin("literal-string", "hex-string") & F.col("bytes_val").isNull(), "invalid-byte-string")
        .when((kind == "stream") & F.col("parent_node").isNotNull(), "stream-must-be-indirect")
        .when((kind == "stream") & F.col("bytes_val").isNull(), "invalid-stream")
        .when(kind == "unknown", "invalid-object")
    )
    return nodes.select("doc_id", code.alias("code"), "path").where("code is not null")
