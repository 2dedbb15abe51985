"""From logical page trees to numbered objects: a preorder, running costs, and the constructed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..stages import staged
from .content import page_contents, procedure_sets, resource_names
from .serialize import prefix_sums

PAGE_NODES = "doc_id string, node_id bigint, parent_id bigint, child_idx int, kind string, mediabox array<double>, rotation int, owner_id string"
METADATA = ("title", "author", "subject", "keywords", "creator", "producer")
# Keys of Info in the order in which they are written.
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def preorder(page_nodes: DataFrame) -> DataFrame:
    """``page_nodes`` with path (as in ``pages[0].children[1]``), the place in preorder and the ancestors, a round per level.

    A node of ``kind`` root without a parent stands for the document's tree.
    """
    level = page_nodes.where("parent_id is null").select(
        "*", F.lit("pages").alias("path"), F.array().cast("array<int>").alias("at"), F.array().cast("array<bigint>").alias("ancestors")
    )
    below = page_nodes.where("parent_id is not null")
    done = None
    while True:
        level = staged(level, "tree")
        if not level.limit(1).count():
            break
        done = level if done is None else done.unionByName(level)
        up = level.select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"), F.col("at").alias("up_at"), F.col("ancestors").alias("up_ancestors"), F.col("parent_id").isNull().alias("top"))
        step = F.when(F.col("top"), F.concat(F.lit("pages["), "child_idx", F.lit("]"))).otherwise(F.concat("up_path", F.lit(".children["), "child_idx", F.lit("]")))
        level = below.join(up, ["doc_id", "parent_id"]).select(
            *page_nodes.columns, step.alias("path"), F.concat("up_at", F.array("child_idx")).alias("at"), F.concat("up_ancestors", F.array("parent_id")).alias("ancestors")
        )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("long")
    return done.withColumn("place", rank)


def source_diagnostics(page_nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents without a page tree, nodes listed twice, and nodes of another builder: doc_id, code, path, related."""
    tree = preorder(page_nodes).join(documents.select("doc_id", F.col("owner_id").alias("doc_owner")), "doc_id")
    none = F.lit(None).cast("string")
    missing = documents.join(page_nodes.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("missing-page-tree").alias("code"), F.lit("pages").alias("path"), none.alias("related"))
    of_node = Window.partitionBy("doc_id", "node_id").orderBy("place")
    twice = tree.where("parent_id is not null").withColumn("nth", F.row_number().over(of_node)).withColumn("first", F.first("path").over(of_node)).where("nth > 1")
    twice = twice.select("doc_id", F.lit("page-node-reused").alias("code"), "path", F.col("first").alias("related"))
    foreign = tree.where("parent_id is not null and doc_owner is not null and not (owner_id <=> doc_owner)").select("doc_id", F.lit("foreign-source").alias("code"), "path", none.alias("related"))
    return missing.unionByName(twice).unionByName(foreign)


def leaf_counts(tree: DataFrame) -> DataFrame:
    """doc_id, node_id, count: pages below each Pages node."""
    rows = tree.where("kind = 'page'").select("doc_id", F.explode("ancestors").alias("node_id"))
    counts = rows.groupBy("doc_id", "node_id").agg(F.count(F.lit(1)).alias("count"))
    return tree.where("kind <> 'page'").select("doc_id", "node_id").join(counts, ["doc_id", "node_id"], "left").fillna(0, ["count"])


def number_tree(tree: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object numbers: (nodes with object_number, resources with object_number).

    The catalog is 1. In preorder a Pages node takes one number; a page takes
    one for itself, one for its contents, then one for each font and each
    image that no page before it has used, fonts first, by first use.
    """
    names = resource_names(ops)
    placed = names.join(tree.select("doc_id", F.col("node_id").alias("page_id"), "place"), ["doc_id", "page_id"])
    order = F.struct("place", F.when(F.col("kind") == "font", 0).otherwise(1).alias("k"), F.col("first").alias("f"))
    fresh = placed.groupBy("doc_id", "kind", "res_id").agg(F.min(order).alias("o"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "o.place").orderBy("o.k", "o.f"))
    fresh = fresh.withColumn("nth", nth).select("doc_id", "kind", "res_id", F.col("o.place").alias("place"), "nth")
    cost = fresh.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("new"))
    costs = tree.join(cost, ["doc_id", "place"], "left").fillna(0, ["new"])
    costs = costs.withColumn("cost", F.when(F.col("kind") == "page", F.col("new") + 2).otherwise(F.lit(1)).cast("long"))
    numbered = prefix_sums(costs, "place", "cost", "before").withColumn("object_number", F.col("before") + 2)
    base = numbered.select("doc_id", "place", F.col("object_number").alias("page_number"))
    resources = fresh.join(base, ["doc_id", "place"]).select("doc_id", "kind", "res_id", (F.col("page_number") + 1 + F.col("nth")).alias("object_number"))
    return numbered.drop("new", "before"), resources



def lower(documents: DataFrame, page_nodes: DataFrame, ops: DataFrame, fonts: DataFrame, images: DataFrame, metadata: DataFrame, number=S.integer_text) -> DataFrame:
    """doc_id, object_number, body (binary): the serialized objects of semantic documents; see ``serialize.object_offsets`` for files.

    ``documents`` (doc_id, version), ``images`` (doc_id, image_id, width,
    height, color_space, bytes), ``metadata`` (doc_id, title .. producer,
    creation_date, modification_date).
    """
    tree = staged(preorder(page_nodes), "tree")
    nodes, resources = number_tree(tree, ops)
    nodes, resources = staged(nodes, "nodes"), staged(resources, "resources")
    ref = lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))
    text = lambda *parts: F.encode(F.concat(*parts), "UTF-8")
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("object_number").alias("parent_number"))
    catalogs = nodes.where("parent_id is null").select("doc_id", F.lit(1).cast("long").alias("object_number"), text(F.lit("<< /Type /Catalog /Pages "), ref(F.col("object_number")), F.lit(" >>")).alias("body"))
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("child_idx", "object_number"))).alias("kids"))
    inner = nodes.where("kind <> 'page'").join(kids, ["doc_id", "node_id"], "left").join(leaf_counts(tree), ["doc_id", "node_id"]).join(up, ["doc_id", "parent_id"], "left")
    listed = F.coalesce(F.array_join(F.transform("kids", lambda k: ref(k["object_number"])), " "), F.lit(""))
    parent = F.when(F.col("parent_number").isNotNull(), F.concat(F.lit(" /Parent "), ref(F.col("parent_number")))).otherwise(F.lit(""))
    pages = inner.select("doc_id", "object_number", text(F.lit("<< /Type /Pages /Kids ["), listed, F.lit("] /Count "), F.col("count").cast("string"), parent, F.lit(" >>")).alias("body"))
    names = resource_names(ops).join(resources, ["doc_id", "kind", "res_id"])
    item = F.struct("first", F.concat(F.lit("/"), "name", F.lit(" "), ref(F.col("object_number"))).alias("t"))
    groups = names.groupBy("doc_id", F.col("page_id").alias("node_id")).pivot("kind", ["font", "image"]).agg(F.array_sort(F.collect_list(item)))
    block = lambda key, c: F.when(F.size(c) > 0, F.concat(F.lit(f"/{key} << "), F.array_join(F.transform(c, lambda x: x["t"]), " "), F.lit(" >> "))).otherwise(F.lit(""))
    versions = documents.select("doc_id", "version")
    sets = procedure_sets(nodes.where("kind = 'page'").select("doc_id", F.col("node_id").alias("page_id")).join(versions, "doc_id"), resource_names(ops), images).withColumnRenamed("page_id", "node_id")
    leaf = nodes.where("kind = 'page'").join(up, ["doc_id", "parent_id"]).join(groups, ["doc_id", "node_id"], "left").join(sets, ["doc_id", "node_id"], "left")
    for i in range(4):
        leaf = leaf.withColumn(f"__{i}", number(F.get("mediabox", i)))
    proc = F.when(F.col("proc_set").isNotNull(), F.concat(F.lit("/ProcSet ["), F.array_join(F.transform("proc_set", lambda p: F.concat(F.lit("/"), p)), " "), F.lit("] "))).otherwise(F.lit(""))
    turn = F.when(F.coalesce("rotation", F.lit(0)) != 0, F.concat(F.lit(" /Rotate "), F.col("rotation").cast("string"))).otherwise(F.lit(""))
    leaves = leaf.select(
        "doc_id", "object_number",
        text(
            F.lit("<< /Type /Page /Parent "), ref(F.col("parent_number")), F.lit(" /MediaBox ["), F.concat_ws(" ", *[F.col(f"__{i}") for i in range(4)]), F.lit("] /Resources << "),
            F.coalesce(block("Font", F.col("font")), F.lit("")), F.coalesce(block("XObject", F.col("image")), F.lit("")), proc, F.lit(">> /Contents "), ref(F.col("object_number") + 1), turn, F.lit(" >>"),
        ).alias("body"),
    )
    content = page_contents(ops, number).withColumnRenamed("page_id", "node_id")
    streams = nodes.where("kind = 'page'").select("doc_id", "node_id", "object_number").join(content, ["doc_id", "node_id"], "left")
    body = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    streams = streams.select("doc_id", (F.col("object_number") + 1).alias("object_number"), F.concat(text(F.lit("<< /Length "), F.octet_length(body).cast("string"), F.lit(" >>\nstream\n")), body, text(F.lit("\nendstream"))).alias("body"))
    encoding = F.when(F.col("base_font").isin("Symbol", "ZapfDingbats"), F.lit("")).otherwise(F.lit(" /Encoding /WinAnsiEncoding"))
    font = resources.where("kind = 'font'").join(fonts.select("doc_id", F.col("font_id").alias("res_id"), "base_font"), ["doc_id", "res_id"])
    font = font.select("doc_id", "object_number", text(F.lit("<< /Type /Font /Subtype /Type1 /BaseFont "), S.pdf_name(F.col("base_font").cast("binary")), encoding, F.lit(" >>")).alias("body"))
    image = resources.where("kind = 'image'").join(images.withColumnRenamed("image_id", "res_id"), ["doc_id", "res_id"])
    head = text(
        F.lit("<< /Type /XObject /Subtype /Image /Width "), F.col("width").cast("string"), F.lit(" /Height "), F.col("height").cast("string"), F.lit(" /ColorSpace /"), F.col("color_space"),
        F.lit(" /BitsPerComponent 8 /Filter /DCTDecode /Length "), F.octet_length("bytes").cast("string"), F.lit(" >>\nstream\n"),
    )
    image = image.select("doc_id", "object_number", F.concat(head, F.col("bytes"), text(F.lit("\nendstream"))).alias("body"))
    out = catalogs
    for part in (pages, leaves, streams, font, image):
        out = out.unionByName(part)
    info = info_bodies(metadata, versions)
    last = out.groupBy("doc_id").agg((F.max("object_number") + 1).alias("object_number"))
    return out.unionByName(info.join(last, "doc_id").select("doc_id", "object_number", "body"))


def metadata_errors(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """Metadata that can't be written: doc_id, field, error. Dates need a year of four digits, texts up to version 1.1 ASCII."""
    m = metadata.join(documents.select("doc_id", "version"), "doc_id")
    old = F.col("version").isin("1.0", "1.1")
    text = [(F.col(c).isNotNull() & old & S.ascii_text_string(c).isNull(), c, "the text needs version 1.2") for c in METADATA]
    date = [(F.col(c).isNotNull() & S.date_string(c).isNull(), c, "the year must have four digits") for c in ("creation_date", "modification_date")]
    found = F.array(*[F.when(bad, F.struct(F.lit(c).alias("field"), F.lit(e).alias("error"))) for bad, c, e in [*text, *date]])
    return m.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.field", "f.error")


def record_errors(ops: DataFrame, fonts: DataFrame, images: DataFrame) -> DataFrame:
    """Fonts and images that pages use and no table holds: doc_id, page_id, kind, res_id."""
    have = fonts.select("doc_id", F.lit("font").alias("kind"), F.col("font_id").alias("res_id")).unionByName(
        images.select("doc_id", F.lit("image").alias("kind"), F.col("image_id").alias("res_id"))
    )
    return resource_names(ops).join(have, ["doc_id", "kind", "res_id"], "left_anti").select("doc_id", "page_id", "kind", "res_id")


def info_bodies(metadata: DataFrame, versions: DataFrame) -> DataFrame:
    """doc_id, body of the Info dictionaries; documents whose metadata are all null have none."""
    m = metadata.join(versions, "doc_id")
    texts = [S.optional_text(F.col(c), F.col("version")) for c in METADATA]
    dates = [S.literal_string(S.date_string(F.col(c)).cast("binary")) for c in ("creation_date", "modification_date")]
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"/{k} "), v)) for k, v in zip(INFO_KEYS, [*texts, *dates], strict=True)]
    joined = F.concat_ws(" ", *parts)
    return m.where(F.coalesce(*METADATA, F.col("creation_date").cast("string"), F.col("modification_date").cast("string")).isNotNull()).select(
        "doc_id", F.encode(F.concat(F.lit("<< "), joined, F.lit(" >>")), "UTF-8").alias("body")
    )


def lowered_files(documents: DataFrame, *tables: DataFrame, number=S.integer_text) -> DataFrame:
    """doc_id, bytes of semantic documents: ``lower``, then offsets and cross-references as for any graph."""
    from .serialize import MARKER, object_offsets, xref_table

    bodies = lower(documents, *tables, number=number)
    info = info_bodies(tables[4], documents.select("doc_id", "version")).select("doc_id", F.lit(True).alias("has_info"))
    whole = F.concat(F.encode(F.format_string("%d 0 obj\n", "object_number"), "UTF-8"), F.col("body"), F.encode(F.lit("\nendobj\n"), "UTF-8"))
    objects = bodies.select("doc_id", "object_number", F.lit(0).alias("generation"), whole.alias("bytes"), F.octet_length(whole).cast("long").alias("length"))
    objects = staged(object_offsets(objects), "objects")
    body = objects.groupBy("doc_id").agg(F.expr("listagg(bytes) within group (order by object_number)").alias("body"), F.sum("length").alias("size"), F.max("object_number").alias("top"))
    xref = xref_table(objects).groupBy("doc_id").agg(F.expr("listagg(entry) within group (order by object_number)").alias("xref"))
    rows = documents.join(body, "doc_id").join(xref, "doc_id").join(info, "doc_id", "left")
    ref = F.when(F.col("has_info"), F.concat(F.lit(" /Info "), F.col("top").cast("string"), F.lit(" 0 R"))).otherwise(F.lit(""))
    size = (F.col("top") + 1).cast("string")
    tail = F.concat(F.lit("xref\n0 "), size, F.lit("\n"), "xref", F.lit("trailer\n<< /Size "), size, F.lit(" /Root 1 0 R"), ref, F.lit(" >>\nstartxref\n"), (F.col("size") + 15).cast("string"), F.lit("\n%%EOF\n"))
    header = F.concat(F.encode(F.concat(F.lit("%PDF-"), "version", F.lit("\n")), "UTF-8"), F.unhex(F.lit(MARKER)))
    return rows.select("doc_id", F.concat(header, F.col("body"), F.encode(tail, "UTF-8")).alias("bytes"))
