"""Bytes of documents: values folded from the deepest level up, offsets by prefix sums, cross-references by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.graphs import Graph
from ..stages import staged
from .references import definitions

MARKER = "25E2E3CFD30A"  # a comment line of bytes above 7F
MAX_GAPS = 1_000_000


def key_bytes() -> Column:
    return F.coalesce("key_bytes", F.encode("key_text", "UTF-8"))


def encode_values(nodes: DataFrame, any_number: bool = True) -> DataFrame:
    """doc_id, obj_index, body (binary): the serialized value of each object; nothing is validated.

    A pass per level of nesting: leaves become text, then children are joined
    in order into their parents. Nested streams and unknown values give null.
    With ``any_number`` numbers that aren't integers are written too, in Python.
    """
    number = S.pdf_number("num_val") if any_number else S.integer_text("num_val")
    leaf = (
        F.when(F.col("kind") == "null", F.lit("null"))
        .when(F.col("kind") == "boolean", F.col("bool_val").cast("string"))
        .when(F.col("kind") == "number", F.col("number"))
        .when(F.col("kind") == "name", S.pdf_name(F.encode("text_val", "UTF-8")))
        .when(F.col("kind") == "byte-name", S.pdf_name("bytes_val"))
        .when(F.col("kind") == "literal-string", S.literal_string("bytes_val"))
        .when(F.col("kind") == "hex-string", S.hex_string("bytes_val"))
        .when(F.col("kind") == "reference", F.concat_ws(" ", F.col("ref_obj").cast("string"), F.col("ref_gen").cast("string"), F.lit("R")))
    )
    key = F.when(F.col("entry_side").isNotNull(), F.concat(S.pdf_name(key_bytes()), F.lit(" "))).otherwise(F.lit(""))
    rows = nodes.where("kind <> 'undefined'").withColumn("number", F.when(F.col("kind") == "number", number))
    data = F.when(F.col("kind") == "stream", F.col("bytes_val"))
    rows = staged(
        rows.select("doc_id", "obj_index", "node_id", "parent_node", "depth", "ord", "kind", key.alias("key"), leaf.alias("text"), data.alias("data")),
        "leaves",
    )
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    ids = ["doc_id", "obj_index"]
    done = None
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth)
        inside = F.lit("")
        if done is not None:
            items = done.groupBy(*ids, F.col("parent_node").alias("node_id")).agg(
                F.array_sort(F.collect_list(F.struct("ord", F.concat("key", "text").alias("item")))).alias("items"),
                F.bool_and(F.col("text").isNotNull()).alias("whole"),
            )
            here = here.join(items, [*ids, "node_id"], "left")
            inside = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<struct<ord:int,item:string>>")), lambda x: x["item"]), " ")
            inside = F.when(F.coalesce("whole", F.lit(True)), inside)
        length = F.concat(F.lit("/Length "), F.octet_length("data").cast("string"))
        spaced = F.when(F.length(inside) > 0, F.concat(inside, F.lit(" "))).when(inside.isNotNull(), F.lit(""))
        text = (
            F.when(F.col("kind") == "array", F.concat(F.lit("["), inside, F.lit("]")))
            .when(F.col("kind") == "dictionary", F.concat(F.lit("<< "), spaced, F.lit(">>")))
            .when((F.col("kind") == "stream") & F.lit(depth == 0), F.concat(F.lit("<< "), spaced, length, F.lit(" >>")))
            .otherwise(F.col("text"))
        )
        done = here.select(*ids, "node_id", "parent_node", "ord", "key", text.alias("text"), "data")
        if depth:
            done = staged(done.drop("data"), "level")
    stream = F.concat(F.encode(F.concat("text", F.lit("\nstream\n")), "UTF-8"), F.col("data"), F.encode(F.lit("\nendstream"), "UTF-8"))
    return done.select(*ids, F.when(F.col("data").isNotNull(), stream).otherwise(F.encode("text", "UTF-8")).alias("body"))


def prefix_sums(rows: DataFrame, order: str, value: str, out: str, bucket: int = 1 << 16) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same doc_id before this one in ``order`` (a long column).

    In two levels, by ranges of ``order``, so that a huge document is many tasks.
    """
    rows = rows.withColumn("__b", F.floor(F.col(order) / bucket))
    sums = rows.groupBy("doc_id", "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy("doc_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("doc_id", "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("doc_id", "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(base, ["doc_id", "__b"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__b", "__base", "__in")


def object_bytes(graph: Graph, any_number: bool = True) -> DataFrame:
    """doc_id, object_number, generation, bytes of each object from ``n g obj`` to ``endobj``, and their length."""
    first = definitions(graph)
    body = encode_values(graph.nodes, any_number).join(first, ["doc_id", "obj_index"])
    head = F.format_string("%d %d obj\n", "object_number", "generation")
    whole = F.concat(F.encode(head, "UTF-8"), F.col("body"), F.encode(F.lit("\nendobj\n"), "UTF-8"))
    return body.select("doc_id", "object_number", "generation", whole.alias("bytes"), F.octet_length(whole).cast("long").alias("length"))


def object_offsets(objects: DataFrame) -> DataFrame:
    """``objects`` (doc_id, object_number, length, ...) with the byte offset of each in its file; the header is 15 bytes."""
    return prefix_sums(objects, "object_number", "length", "before").withColumn("offset", F.col("before") + 15).drop("before")


def xref_table(offsets: DataFrame) -> DataFrame:
    """Cross-reference entries: doc_id, object_number (0 first), field, generation, in_use, entry.

    ``offsets`` (doc_id, object_number, generation, offset). Numbers without
    an object are free and linked: each names the next, the last names 0.
    Documents with more than a million gaps get no entries.
    """
    used = offsets.select("doc_id", F.col("object_number").cast("long").alias("object_number"), "generation", F.col("offset").cast("long").alias("field"))
    top = used.groupBy("doc_id").agg(F.max("object_number").alias("top"), F.count(F.lit(1)).alias("n")).where(F.col("top") - F.col("n") <= MAX_GAPS)
    every = top.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("object_number"))
    free = every.join(used, ["doc_id", "object_number"], "left_anti")
    chain = Window.partitionBy("doc_id").orderBy("object_number")
    free = free.withColumn("field", F.lead("object_number", 1, 0).over(chain))
    head = top.join(free.groupBy("doc_id").agg(F.min("object_number").alias("first")), "doc_id", "left").select(
        "doc_id", F.lit(0).cast("long").alias("object_number"), F.lit(65_535).alias("generation"), F.coalesce("first", F.lit(0)).alias("field"), F.lit(False).alias("in_use")
    )
    free = free.select("doc_id", "object_number", F.lit(0).alias("generation"), "field", F.lit(False).alias("in_use"))
    used = used.join(top.select("doc_id"), "doc_id", "left_semi").withColumn("in_use", F.lit(True))
    rows = head.unionByName(free).unionByName(used)
    return rows.withColumn("entry", S.xref_entry("field", "generation", F.col("in_use")))


def serialize(graph: Graph, any_number: bool = True) -> DataFrame:
    """doc_id, bytes: whole files. Warnings don't keep a document from being written; validate first."""
    objects = staged(object_offsets(object_bytes(graph, any_number)), "objects")
    body = objects.groupBy("doc_id").agg(
        F.expr("listagg(bytes) within group (order by object_number)").alias("body"),
        F.sum("length").alias("size"),
        F.max("object_number").alias("top"),
    )
    xref = xref_table(objects).groupBy("doc_id").agg(F.expr("listagg(entry) within group (order by object_number)").alias("xref"))
    d = graph.documents
    ref = lambda c: F.format_string("%d %d R", F.col(c)["obj"], F.col(c)["gen"])
    header = F.concat(F.encode(F.concat(F.lit("%PDF-"), "version", F.lit("\n")), "UTF-8"), F.unhex(F.lit(MARKER)))
    tail = F.concat(
        F.lit("xref\n0 "), (F.col("top") + 1).cast("string"), F.lit("\n"), "xref",
        F.lit("trailer\n<< /Size "), (F.col("top") + 1).cast("string"), F.lit(" /Root "), ref("root"),
        F.when(F.col("info").isNotNull(), F.concat(F.lit(" /Info "), ref("info"))).otherwise(F.lit("")),
        F.when(F.col("id").isNotNull(), F.concat(F.lit(" /ID ["), S.hex_string(F.get("id", 0)), F.lit(" "), S.hex_string(F.get("id", 1)), F.lit("]"))).otherwise(F.lit("")),
        F.lit(" >>\nstartxref\n"), (F.col("size") + 15).cast("string"), F.lit("\n%%EOF\n"),
    )
    rows = d.join(body, "doc_id").join(xref, "doc_id")
    return rows.select("doc_id", F.concat(header, F.col("body"), F.encode(tail, "UTF-8")).alias("bytes"))


def write_files(files: DataFrame, folder: str) -> None:
    """One file per document: ``folder``/doc_id.pdf, written by the tasks into a store that all of them reach (a URI, or the
    path of a shared mount). Partial files never carry the final name."""
    from pyarrow import fs

    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])

    def put(rows):
        store, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            path = f"{base}/{r['doc_id']}.pdf"
            with store.open_output_stream(path + ".part") as f:
                f.write(bytes(r["bytes"]))
            store.move(path + ".part", path)

    files.select("doc_id", "bytes").foreachPartition(put)
