"""Queries of single functions, operations, images, files and workflows over the test tables, and SQL for the same rows."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import artifacts, content, jpeg, lowering, png, references, serialize, validate, workflows
from ..sources.graphs import number_objects, read_files
from ..stages import remove_at_exit, shared_dir, staged
from .derived import ENTRIES, GRAPH, OPERATIONS, derived_graph, derived_operations, derived_tree, views
from .rules import CASES, expected_sql, graph_of_customers

_HEAD = f"WITH RECURSIVE {GRAPH}"
_DOC = "concat('r', r) AS doc_id"


def rows_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(sql)


# --- rules of documents ---------------------------------------------------------------------------------------------


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diagnostics of a document a customer, each with a fault that its key chooses."""
    return validate.validate(graph_of_customers(spark, sf_dir)).select("doc_id", "severity", "code", "path")


def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each of those documents."""
    found = validate.validate(graph_of_customers(spark, sf_dir))
    return validate.error_counts(found).select("doc_id", F.col("errors").cast("long").alias("errors"), F.col("warnings").cast("long").alias("warnings"))


def matching_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with and without an object of their number and generation."""
    graph = derived_graph(spark, sf_dir)
    uses = references.resolve_matching(references.reference_uses(graph), references.definitions(graph))
    return uses.groupBy("doc_id").agg(F.count("found_index").alias("matched"), F.count_if(F.col("found_index").isNull()).alias("unmatched"))


def owner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT concat('n', c_nationkey) AS doc_id, c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'x' WHEN c_custkey % 9 = 1 THEN NULL ELSE 'me' END AS owner_id FROM customer")
    owners = spark.sql("SELECT concat('n', n_nationkey) AS doc_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'me' END AS owner_id FROM nation")
    return references.assert_owner(rows, owners).select("doc_id", "k")


def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived page trees with pages listed twice, pages of another builder, and a document without a tree."""
    tree = derived_tree(spark, sf_dir).drop("owner_id")
    pages = rows_of(spark, sf_dir, f"WITH {GRAPH} SELECT {_DOC}, num AS node_id, c FROM g_page")
    tree = tree.join(pages, ["doc_id", "node_id"], "left").withColumn("owner_id", F.when(F.col("c") % 50 == 11, "other").otherwise("me"))
    again = tree.where("c % 50 = 9").withColumns({"parent_id": F.lit(2).cast("long"), "child_idx": (1000 + F.col("c")).cast("int")})
    documents = tree.select("doc_id").distinct().unionByName(spark.createDataFrame([("none",)], "doc_id string")).withColumn("owner_id", F.lit("me"))
    found = lowering.source_diagnostics(staged(tree.unionByName(again).drop("c"), "tree"), documents)
    return found.select("doc_id", "code", "path", F.coalesce("related", F.lit("-")).alias("related"))


# --- scalars --------------------------------------------------------------------------------------------------------


def number_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT CAST(p_partkey AS BIGINT) AS id, (p_partkey - 9) / 2D AS v, CAST(p_size AS DOUBLE) AS size FROM part")
    box = F.when(F.col("id") % 5 == 0, F.array(F.lit(0.0), F.lit(0.0), "v")).otherwise(F.array(F.lit(0.0), F.lit(0.0), "v", F.lit(10.0)))
    none = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return rows.select(
        "id", none(S.object_number("v")).alias("object_number"), none(S.generation_number(F.col("v") + 65_000)).alias("generation"), S.is_positive("v").alias("positive"), S.is_safe_integer("v").alias("safe"),
        S.is_unit_rgb(F.col("v") / 100, F.lit(0.5), F.col("size") / 25).alias("rgb"), S.is_rectangle(box).alias("box"), S.is_positive_rectangle(box).alias("positive_box"),
        F.coalesce(S.joined_numbers(F.array("size", "v", F.lit(-1.0))), F.lit("-")).alias("joined"),
    )


def name_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT conv_id, turn, text, role, CASE turn % 3 WHEN 0 THEN '' ELSE role END AS s, unhex(CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '6100' ELSE '6162' END) AS b, CASE WHEN turn % 2 = 0 THEN '1.1' ELSE '1.7' END AS version FROM conversations")
    return rows.select(
        "conv_id", "turn", S.is_name("s").alias("name"), S.is_name_bytes("b").alias("name_bytes"), S.ascii_text_string("text").isNotNull().alias("ascii"), S.optional_text("role", "version").alias("metadata"),
    )


def uint16_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT CAST(p_partkey AS BIGINT) AS id, unhex(lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) AS b FROM part")
    return rows.select("id", S.uint16("b", 0).alias("first"), S.uint16("b", 1).alias("second"), F.coalesce(S.uint16("b", 2), F.lit(-1)).alias("beyond"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT CAST(p_partkey AS BIGINT) AS id, concat(p_name, ' / ', upper(p_brand), '!') AS s, concat('../', p_brand, '//', p_type, '\\\\', p_name, '/..') AS p FROM part")
    return rows.select("id", S.slug("s").alias("slug"), S.safe_relative_path("p").alias("path"))


def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that other writers give an exponent."""
    rows = rows_of(spark, sf_dir, "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(concat(p_partkey + 1, 'e-9') AS DOUBLE) AS small, CAST(concat(p_partkey + 1, 'e20') AS DOUBLE) AS large FROM part")
    return rows.select("id", S.pdf_number("small").alias("small"), S.pdf_number("large").alias("large"))


def commit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 2 = 0 THEN concat(md5(p_name), substr(md5(p_name), 1, 8)) ELSE concat(md5(p_name), 'main') END AS ref, concat(CASE WHEN p_partkey % 3 = 0 THEN 'v' ELSE '' END, p_size, '.1') AS tag FROM part")
    v = S.semver("tag")
    return rows.select("id", S.short_commit("ref").alias("ref"), S.with_version_prefix("tag").alias("tag"), v["major"].alias("major"), v["minor"].alias("minor"), v["segments"].alias("segments"))


MODES = [(None, None), (None, ""), (None, "0"), (None, "FALSE"), (None, "no"), (None, "true"), ("update", "1"), ("verify", None), ("Verify", "1"), ("", None)]


def artifact_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mode(override, ci):
        try:
            return artifacts.default_mode({k: v for k, v in (("PDF_ARTIFACTS", override), ("CI", ci)) if v is not None})
        except ValueError:
            return "error"

    return spark.createDataFrame([(i, mode(*m)) for i, m in enumerate(MODES)], "id int, mode string")


def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that SQL gets by registration."""
    views(spark, sf_dir)
    S.register(spark)
    return spark.sql("SELECT CAST(p_partkey AS BIGINT) AS id, pdf_slug(p_name) AS slug, pdf_plain_decimal(p_partkey / 8D) AS number, pdf_safe_path(concat(p_brand, '/x')) AS path FROM part")


# --- files and images -----------------------------------------------------------------------------------------------


def builder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT concat('c', o_custkey) AS doc_id, o_orderkey AS handle, -o_orderkey AS creation_ord FROM orders")
    return number_objects(rows).select("doc_id", "handle", "object_number")


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in nested folders, put in place of a folder as a whole and read back."""
    files = rows_of(spark, sf_dir, "SELECT concat(r_name, '/', n_name, '.txt') AS path, encode(concat(n_name, ' of ', r_name), 'UTF-8') AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey")
    folder = f"{shared_dir(spark)}/docloom/folder-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for part in (files.limit(3), files):
        artifacts.replace_folder(part, folder)
    return read_files(spark, folder).select("path", F.decode("bytes", "UTF-8").alias("text"))


def artifact_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check says of equal, of other and of updated files, and whether a report is left."""
    files = rows_of(spark, sf_dir, "SELECT concat('f', n_nationkey) AS path, encode(n_name, 'UTF-8') AS bytes FROM nation")
    other = files.where("path <> 'f3'")
    base = f"{shared_dir(spark)}/docloom/golden-{uuid.uuid4().hex}"
    golden, bad = f"{base}/golden", f"{base}/bad"
    remove_at_exit(spark, base)
    steps, out = [(files, "verify"), (files, "update"), (files, "verify"), (other, "verify"), (other, "update"), (other, "verify")], []
    for i, (now, mode) in enumerate(steps):
        status = artifacts.check_artifact(staged(read_files(spark, golden), "golden"), now, golden, mode, bad)
        out.append((i, status, read_files(spark, golden).count(), read_files(spark, bad).where("path = 'report.html'").count()))
    return spark.createDataFrame(out, "step int, status string, files long, reports long")


PIXELS = """
SELECT concat('n', c_nationkey) AS doc_id, CAST(c_custkey AS INT) AS page_number, c_custkey AS c, 4 AS width, 2 AS height FROM customer
"""


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of eight pixels of which some are other, missing, added, unreadable or of another size."""
    rows = rows_of(spark, sf_dir, PIXELS)
    columns = ["doc_id", "page_number", "width", "height", "pixels"]
    white = lambda n: F.unhex(F.repeat(F.lit("FFFFFFFF"), n))
    other = (F.col("c") % 7).cast("int")
    before = rows.where("c % 13 <> 0").withColumn("pixels", F.when(F.col("c") % 17 == 1, white(F.lit(3))).otherwise(white(F.lit(8)))).select(*columns)
    low = F.col("c") % 19 == 2
    after = F.when(low, white(F.lit(4))).otherwise(F.concat(F.unhex(F.repeat(F.lit("000000FF"), other)), white(8 - other)))
    after = rows.where("c % 11 <> 0").withColumn("pixels", after).withColumn("height", F.when(low, 1).otherwise(2)).select(*columns)
    found = artifacts.page_differences(before, after)
    return found.select("doc_id", "page_number", "kind", F.coalesce("differing", F.lit(-1)).alias("differing"))


def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT c_custkey AS id, CAST(1 + c_custkey % 5 AS INT) AS w, CAST(1 + c_custkey % 3 AS INT) AS h, unhex(repeat(lpad(hex(c_custkey * 7919), 8, '0'), CAST((1 + c_custkey % 5) * (1 + c_custkey % 3) AS INT))) AS px FROM customer")

    def run(batches):
        for d in batches:
            made = [png.decode(png.encode(int(w), int(h), bytes(p))) for w, h, p in zip(d["w"], d["h"], d["px"], strict=True)]
            yield pd.DataFrame({"id": d["id"], "width": [m[0] for m in made], "height": [m[1] for m in made], "px": [m[2] for m in made]})

    return rows.mapInPandas(run, "id long, width int, height int, px binary").select("id", "width", "height", F.sha2("px", 256).alias("digest"))


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT concat('n', c_nationkey) AS doc_id, concat('<', c_custkey, '>') AS path, CASE WHEN c_custkey % 2 = 0 THEN 'added' ELSE 'changed' END AS kind FROM customer")
    return artifacts.report_html(rows, "A & B")


def picture(parts: int = 3) -> list[bytes]:
    """The segments of a small baseline image of 2 x 3 pixels."""
    seg = lambda m, p: bytes([0xFF, m]) + (len(p) + 2).to_bytes(2, "big") + p
    return [
        b"\xff\xd8",
        seg(0xDB, bytes([0]) + bytes([1] * 64)),
        seg(0xC4, bytes([0x00, 1, *[0] * 15, 0])),
        seg(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
        seg(0xC0, bytes([8, 0, 3, 0, 2, parts]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(parts))),
        seg(0xDA, bytes([parts]) + b"".join(bytes([i + 1, 0]) for i in range(parts)) + b"\x00\x3f\x00"),
        b"\x12\xff\x00\xff\xd0\x34",
        b"\xff\xd9",
    ]


def _pictures() -> list[tuple[bytes | None, str | None, str]]:
    """(image, error, color space)."""
    p = picture()
    put = lambda i, b: b"".join([*p[:i], b, *p[i + 1 :]])
    no = lambda i: b"".join(p[:i] + p[i + 1 :])
    missing = "tables, scan data or the end are missing"
    undefined = "the scan names a component or table that is not defined"
    return [
        (b"".join(p), None, "DeviceRGB"), (b"".join(picture(1)), None, "DeviceGray"), (b"".join([*p[:1], b"\xff\xfe\x00\x04hi", *p[1:]]), None, "DeviceRGB"), (put(0, b"xx"), "an image starts with an SOI marker", ""),
        (no(1), undefined, ""), (no(2), undefined, ""), (no(3), undefined, ""), (no(4), "the scan header is not valid", ""), (no(5), "bytes stand outside a marker segment", ""), (no(7), missing, ""), (no(6), missing, ""),
        (put(0, p[0] + b"zz"), "bytes stand outside a marker segment", ""), (b"".join(p)[:20], "a segment has a wrong length", ""), (b"\xff\xd8\xff\xdb\x00", "a segment has no length", ""), (None, "no bytes", ""),
        (put(4, p[4].replace(b"\xff\xc0", b"\xff\xc2")), "only baseline images are supported", ""), (put(4, p[4].replace(b"\x08\x00\x03", b"\x0c\x00\x03")), "only 8 bits a sample are supported", ""),
        (put(4, p[4].replace(b"\x00\x03\x00\x02", b"\x00\x00\x00\x02")), "the frame header is not valid", ""), (put(4, p[4][:4] + bytes([8, 0, 3, 0, 2, 2, 1, 17, 0, 2, 17, 0])[:0] + p[4][4:]), None, "DeviceRGB"),
        (put(4, p[4][:-2] + b"\x51\x00"), "the sampling factors are not valid", ""), (put(4, p[4][:-3] + b"\x02\x11\x00"), "the frame components are not valid", ""),
        (put(5, p[5][:-2] + b"\x3e\x00"), "the scan is not baseline sequential", ""), (put(1, p[1][:-1] + b"\0"), "quantization coefficients must be above zero", ""), (put(1, p[1][:4] + b"\x24" + p[1][5:]), "a quantization table is not valid", ""),
        (put(2, p[2][:5] + bytes([3, *[0] * 15, 0, 1, 2])[: len(p[2]) - 5]), "a Huffman table has more codes than bits allow", ""), (put(2, p[2][:-1] + b"\x0c"), "a DC table holds a symbol that can't be", ""), (put(3, p[3][:-1] + b"\x0b"), "an AC table holds a symbol that can't be", ""),
        (put(2, p[2][:4] + b"\x25" + p[2][5:]), "a Huffman table is not valid", ""),
    ]


def jpeg_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound and broken images, one a customer."""
    made = [(i, None if b is None else bytearray(b)) for i, (b, _, _) in enumerate(_pictures())]
    images = spark.createDataFrame(made, "k long, bytes binary")
    rows = rows_of(spark, sf_dir, f"SELECT concat('c', c_custkey) AS doc_id, 'x' AS image_id, c_custkey % {len(made)} AS k FROM customer")
    found = jpeg.inspect_images(rows.join(F.broadcast(images), "k"))  # a few images
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select("doc_id", "ok", text("error"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), text("color_space"))


def jpeg_segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function: segments of a sound image, one a nation."""
    jpeg.register_segments(spark)
    views(spark, sf_dir)
    data = b"".join(picture()).hex()
    return spark.sql(f"SELECT n_nationkey AS nation, s.offset, s.marker, s.length FROM nation, LATERAL jpeg_segments(unhex('{data}')) s")


# --- drawing operations ---------------------------------------------------------------------------------------------

#: (operation, fragment, arguments as SQL over the order key o, line as SQL).
LINES = [
    ("moveText", "text", ["o", "-14"], "o || ' -14 Td'"), ("setTextMatrix", "text", ["1", "0", "0", "1", "o", "-7"], "'1 0 0 1 ' || o || ' -7 Tm'"), ("leading", "text", ["o % 20"], "o % 20 || ' TL'"), ("nextLine", "text", [], "'T*'"),
    ("characterSpacing", "text", ["o % 3"], "o % 3 || ' Tc'"), ("wordSpacing", "text", ["o % 5"], "o % 5 || ' Tw'"), ("horizontalScale", "text", ["100"], "'100 Tz'"), ("rise", "text", ["-3"], "'-3 Ts'"),
    ("concatMatrix", "graphics", ["1", "0", "0", "-1", "0", "o"], "'1 0 0 -1 0 ' || o || ' cm'"), ("lineWidth", "graphics", ["o % 4"], "o % 4 || ' w'"), ("rgbFill", "graphics", ["0", "1", "0"], "'0 1 0 rg'"), ("rgbStroke", "graphics", ["1", "1", "0"], "'1 1 0 RG'"),
    ("moveTo", "graphics", ["o", "10"], "o || ' 10 m'"), ("lineTo", "graphics", ["o", "20"], "o || ' 20 l'"), ("rectangle", "graphics", ["o", "1", "2", "3"], "o || ' 1 2 3 re'"), ("closePath", "graphics", [], "'h'"), ("stroke", "graphics", [], "'S'"),
    ("fill", "graphics", [], "'f'"), ("fillAndStroke", "graphics", [], "'B'"), ("drawImage", "graphics", ["7", "8", "o", "9"], "'q' || chr(10) || o || ' 0 0 9 7 8 cm' || chr(10) || '/Im0 Do' || chr(10) || 'Q'"),
    ("font", "text", ["o % 30 + 1"], "'/F0 ' || (o % 30 + 1) || ' Tf'"), ("show", "text", [], "'(a\\(' || o || ') Tj'"),
]


def operation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation once for each 22 orders, a page an order."""
    views(spark, sf_dir)
    args = " ".join(f"WHEN {i} THEN array({', '.join(f'CAST({a} AS DOUBLE)' for a in args)})" if args else f"WHEN {i} THEN CAST(array() AS array<double>)" for i, (_, _, args, _) in enumerate(LINES))
    pick = lambda n: " ".join(f"WHEN {i} THEN '{x[n]}'" for i, x in enumerate(LINES))
    ops = spark.sql(
        f"SELECT 'd' AS doc_id, o AS page_id, 0 AS frag_idx, CASE o % 22 {pick(1)} END AS frag_kind, 0 AS op_idx, CASE o % 22 {pick(0)} END AS op, CASE o % 22 {args} END AS args,"
        " CASE WHEN o % 22 IN (19, 20) THEN concat('x', o % 7) END AS res_id, CASE WHEN o % 22 = 21 THEN concat('a(', o) END AS text, CAST(NULL AS BINARY) AS bytes FROM (SELECT o_orderkey AS o FROM orders)"
    )
    return content.encode_operations(ops, content.resource_names(ops)).select("page_id", "op", "line")


_NAN = "CAST('NaN' AS DOUBLE)"
#: Operations (fragment, operation, arguments, resource, text, symbols as bytes) of a fault, in one fragment, and the error.
FAULTS = [
    ([("text", "wave", [], None, None)], "unknown operation"), ([("graphics", "nextLine", [], None, None)], "operation of the other kind of fragment"), ([("text", "stroke", [], None, None)], "operation of the other kind of fragment"),
    ([("graphics", "moveTo", [1.0], None, None)], "wrong number of arguments"), ([("graphics", "lineTo", [1.0, None], None, None)], "an argument is not finite"), ([("text", "font", [9.0], "nothing", None)], "unknown font"),
    ([("text", "font", [0.0], "plain", None)], "a font size must be positive"), ([("text", "show", [], None, "x")], "text needs a font first"), ([("text", "font", [9.0], "signs", None), ("text", "show", [], None, "x")], "symbolic fonts show bytes"),
    ([("text", "font", [9.0], "plain", None), ("text", "show", [], None, "Ω")], "no Windows-1252 byte for U+03A9"), ([("graphics", "lineWidth", [-1.0], None, None)], "a line width must not be negative"),
    ([("graphics", "rgbFill", [0.0, 2.0, 0.0], None, None)], "a colour lies from 0 to 1"), ([("graphics", "rgbStroke", [0.0, 0.0, -1.0], None, None)], "a colour lies from 0 to 1"), ([("graphics", "drawImage", [0.0, 0.0, 1.0, 1.0], "none", None)], "unknown image"),
    ([("graphics", "drawImage", [0.0, 0.0, 0.0, 1.0], "photo", None)], "an image needs a positive size"), ([("text", "font", [9.0], "plain", None), ("text", "show", [], None, "fine")], None),
]


def operation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error of the drawing operations, one an order."""
    made = [(k, i, frag, op, [float("nan") if a is None else a for a in args], res, text) for k, (ops, _) in enumerate(FAULTS) for i, (frag, op, args, res, text) in enumerate(ops)]
    faults = spark.createDataFrame(made, "k long, op_idx int, frag_kind string, op string, args array<double>, res_id string, text string")
    rows = rows_of(spark, sf_dir, f"SELECT 'd' AS doc_id, o_orderkey AS page_id, 0 AS frag_idx, o_orderkey % {len(FAULTS)} AS k, CAST(NULL AS BINARY) AS bytes FROM orders")
    fonts = spark.createDataFrame([("d", "plain", "Courier"), ("d", "signs", "Symbol")], "doc_id string, font_id string, base_font string")
    images = spark.createDataFrame([("d", "photo")], "doc_id string, image_id string")
    return content.operation_errors(rows.join(F.broadcast(faults), "k"), fonts, images).select("page_id", "op", "error")  # a few faults


def font_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, sf_dir, "SELECT 'd' AS doc_id, concat('f', p_partkey) AS font_id, CASE p_partkey % 4 WHEN 0 THEN 'Courier' WHEN 1 THEN 'ZapfDingbats' WHEN 2 THEN 'courier' ELSE p_name END AS base_font FROM part")
    return content.font_errors(rows).select("font_id", "error")


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the derived documents that use the font that no table holds."""
    ops = derived_operations(spark, sf_dir)
    fonts = spark.sql("SELECT concat('r', r_regionkey) AS doc_id, concat('f', k) AS font_id FROM region CROSS JOIN (VALUES (0), (1), (2)) AS v(k)")
    return lowering.record_errors(ops, fonts, spark.createDataFrame([], "doc_id string, image_id string"))


def metadata_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(
        spark, sf_dir,
        "SELECT concat('c', c_custkey) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '1.1' ELSE '1.7' END AS version, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, 'é') ELSE c_name END AS title, CAST(NULL AS STRING) AS author, c_mktsegment AS subject,"
        " CAST(NULL AS STRING) AS keywords, CAST(NULL AS STRING) AS creator, '' AS producer, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '+12026-01-01 00:00:00' END AS creation_date, TIMESTAMP '2026-01-01 00:00:00' AS modification_date FROM customer",
    )
    return lowering.metadata_errors(rows.drop("version"), rows.select("doc_id", "version"))


def _semantic(spark: SparkSession, sf_dir: str) -> tuple:
    """Tables of the derived documents: documents, page tree, operations, fonts, images, metadata."""
    tree, ops = derived_tree(spark, sf_dir), derived_operations(spark, sf_dir)
    documents = spark.sql("SELECT concat('r', r_regionkey) AS doc_id, '1.7' AS version FROM region")
    fonts = spark.sql("SELECT concat('r', r_regionkey) AS doc_id, concat('f', k) AS font_id, f AS base_font FROM region CROSS JOIN (VALUES (0, 'Courier'), (1, 'Helvetica'), (2, 'Symbol'), (3, 'Times-Roman')) AS v(k, f)")
    images = spark.createDataFrame([], "doc_id string, image_id string, width int, height int, color_space string, bytes binary")
    meta = spark.sql(
        "SELECT concat('r', r_regionkey) AS doc_id, CASE WHEN r_regionkey <> 1 THEN 'A' END AS title, CAST(NULL AS STRING) AS author, CAST(NULL AS STRING) AS subject, CAST(NULL AS STRING) AS keywords, CAST(NULL AS STRING) AS creator, CAST(NULL AS STRING) AS producer,"
        " CASE WHEN r_regionkey <> 1 THEN TIMESTAMP '2024-01-02 03:04:05' END AS creation_date, CAST(NULL AS TIMESTAMP) AS modification_date FROM region"
    )
    return documents, tree, ops, fonts, images, meta


def lowered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of the objects that semantic documents become."""
    return lowering.lower(*_semantic(spark, sf_dir)).select("doc_id", "object_number", F.decode("body", "UTF-8").alias("body"))


def lowered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lowering.lowered_files(*_semantic(spark, sf_dir))
    return files.select("doc_id", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("digest"))


def derived_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every inner node of the logical trees, as the builder writes them."""
    return lowering.leaf_counts(lowering.preorder(derived_tree(spark, sf_dir))).select("doc_id", "node_id", "count")


# --- workflow files -------------------------------------------------------------------------------------------------

#: Three lines for each part of a brand's file: a use (two in nine aren't pinned uses), an input, a name.
WORKFLOW = """
w_part AS (
  SELECT p_brand AS brand, p_partkey AS k, concat('o', CAST(p_partkey % 3 AS STRING), '/n', CAST(p_partkey % 5 AS STRING)) AS action, concat('ref', CAST(p_partkey % 4 AS STRING)) AS ref,
         concat(CAST(p_size AS STRING), '.1.0') AS version, p_partkey % 9 AS odd, p_partkey % 4 <> 0 AS given,
         3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS ln
  FROM part
)
"""


def _workflow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return staged(
        spark.sql(
            f"WITH {WORKFLOW} SELECT concat('w/', brand, '.yml') AS path, encode(listagg(concat('      - uses: ', CASE WHEN odd = 4 THEN './local' ELSE action END, '@', ref, CASE WHEN odd = 7 THEN '' ELSE concat(' # v', version) END, '\\n',"
            " '          ', CASE WHEN given THEN concat('version: 1.2.', k) ELSE 'with: none' END, '\\n          name: x'), '\\n') WITHIN GROUP (ORDER BY k), 'UTF-8') AS bytes FROM w_part GROUP BY brand"
            " UNION ALL SELECT 'w/readme.md', encode('      - uses: a/b@c # v1', 'UTF-8')"
        ),
        "workflows",
    )


def _uses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = workflows.workflow_lines(_workflow_files(spark, sf_dir))
    return lines, workflows.used_actions(lines)


def workflow_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uses(spark, sf_dir)[1].select("path", F.col("line_index").cast("long").alias("line_index"), "action", "ref", "version")


def workflow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = workflows.action_groups(_uses(spark, sf_dir)[1])
    return groups.select("action", "version", "ref", F.size("occurrences").cast("long").alias("occurrences"))


def workflow_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, uses = _uses(spark, sf_dir)
    found = workflows.input_lines(lines, uses, "version")
    return found.select("path", "action", F.col("use_line").cast("long").alias("use_line"), F.col("line_index").cast("long").alias("line_index"), "value")


TAGS = "SELECT concat('o', CAST(a % 3 AS STRING), '/n', CAST(b % 5 AS STRING)) AS action, t AS tag, c AS commit FROM (VALUES (0), (1)) AS x(a) CROSS JOIN (VALUES (0), (1), (2), (3)) AS y(b) CROSS JOIN (VALUES ('v9.0.0', 'old'), ('10.2', 'ref2'), ('v11.0.0-rc.1', 'early')) AS z(t, c)"


def workflow_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _uses(spark, sf_dir)[1]
    new = workflows.rewritten_lines(uses, workflows.newest_tags(spark.sql(TAGS)))
    return new.select("path", F.col("line_index").cast("long").alias("line_index"), "line")


def workflow_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _uses(spark, sf_dir)[1]
    none = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return workflows.update_report(uses, workflows.newest_tags(spark.sql(TAGS))).select("action", "version", "ref", none("newest"), none("commit"), "has_update")


QUERIES = {
    f.__name__: f
    for f in (
        rule_findings, rule_totals, matching_targets, owner_checks, source_rules, number_guards, name_guards, uint16_values, slugs, plain_numbers, commit_versions, artifact_modes, registered_functions, builder_numbers, folder_files,
        artifact_statuses, page_pixels, png_round_trip, change_report, jpeg_images, jpeg_segment_rows, operation_lines, operation_faults, font_checks, record_checks, metadata_checks, lowered_objects, lowered_files, derived_page_counts,
        workflow_uses, workflow_groups, workflow_inputs, workflow_rewrites, workflow_report,
    )
}

_SLUG = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({s}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 100), ''), 'pdf')"
_Q = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_USES = f"WITH {WORKFLOW}, w_use AS (SELECT concat('w/', brand, '.yml') AS path, ln, action, ref, version, k FROM w_part WHERE odd NOT IN (4, 7))"
_NEWEST = "w_new AS (SELECT concat('o', a, '/n', b) AS action FROM range(2) x(a), range(4) y(b))"
#: Numbers of the objects of semantic documents, their fonts and what is written into each.
_LOWERED = f"""{_HEAD}, {OPERATIONS},
g_first AS (SELECT r, page, res, min(seq) AS first FROM g_op WHERE op = 'font' GROUP BY r, page, res),
g_name AS (SELECT r, page, res, first, 'F' || CAST(row_number() OVER (PARTITION BY r, page ORDER BY first) - 1 AS STRING) AS name FROM g_first),
g_walk AS (SELECT r, num AS node, num AS a, CAST(0 AS BIGINT) AS b, 1 AS base FROM g_nation UNION ALL SELECT r, num, up, kid + 1, 2 FROM g_page),
g_pos AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY a, b) AS place FROM g_walk),
g_new AS (SELECT f.r, f.res, p.place, row_number() OVER (PARTITION BY f.r, f.res ORDER BY p.place) AS nth, f.first FROM g_first f JOIN g_pos p ON p.r = f.r AND p.node = f.page),
g_fresh AS (SELECT r, res, place, row_number() OVER (PARTITION BY r, place ORDER BY first) AS k FROM g_new WHERE nth = 1),
g_cost AS (SELECT p.*, p.base + (SELECT count(*) FROM g_fresh f WHERE f.r = p.r AND f.place = p.place) AS cost FROM g_pos p),
g_num AS (SELECT *, 3 + coalesce(sum(cost) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM g_cost),
g_font AS (SELECT f.r, f.res, CAST(n.number + 1 + f.k AS BIGINT) AS number FROM g_fresh f JOIN g_num n ON n.r = f.r AND n.place = f.place),
g_out AS (
  SELECT o.r, o.page, o.frag, o.seq, CASE o.op WHEN 'font' THEN '/' || n.name || ' ' || CAST(CAST(o.a AS INT) AS STRING) || ' Tf' WHEN 'moveText' THEN '0 -14 Td' WHEN 'show' THEN '(\\(' || substr(o.t, 2, length(o.t) - 2) || '\\)) Tj'
    WHEN 'moveTo' THEN CAST(CAST(o.a AS INT) AS STRING) || ' 10 m' ELSE CAST(CAST(o.a AS INT) AS STRING) || ' ' || CAST(CAST(o.b AS INT) AS STRING) || ' l' END || chr(10) AS line
  FROM g_op o LEFT JOIN g_name n ON o.op = 'font' AND n.r = o.r AND n.page = o.page AND n.res = o.res
), g_frag AS (SELECT r, page, frag, CASE WHEN frag = 0 THEN 'BT' ELSE 'q' END || chr(10) || string_agg(line, '' ORDER BY seq) || CASE WHEN frag = 0 THEN 'ET' ELSE 'Q' END || chr(10) AS t FROM g_out GROUP BY r, page, frag),
g_content AS (SELECT r, page, string_agg(t, '' ORDER BY frag) AS content FROM g_frag GROUP BY r, page),
g_uses AS (SELECT n.r, n.page, '/Font << ' || string_agg('/' || n.name || ' ' || f.number || ' 0 R', ' ' ORDER BY n.first) || ' >> ' AS t FROM g_name n JOIN g_font f ON f.r = n.r AND f.res = n.res GROUP BY n.r, n.page),
g_made AS (
  SELECT r, CAST(1 AS BIGINT) AS n, '<< /Type /Catalog /Pages 2 0 R >>' AS body FROM g_size
  UNION ALL SELECT z.r, 2, '<< /Type /Pages /Kids [' || (SELECT string_agg(CAST(number AS BIGINT) || ' 0 R', ' ' ORDER BY number) FROM g_num x WHERE x.r = z.r AND x.base = 1) || '] /Count ' || z.np || ' >>' FROM g_size z
  UNION ALL SELECT x.r, CAST(x.number AS BIGINT), '<< /Type /Pages /Kids [' || coalesce((SELECT string_agg(CAST(y.number AS BIGINT) || ' 0 R', ' ' ORDER BY y.number) FROM g_num y WHERE y.r = x.r AND y.base = 2 AND y.a = x.a), '') || '] /Count '
    || (SELECT count(*) FROM g_num y WHERE y.r = x.r AND y.base = 2 AND y.a = x.a) || ' /Parent 2 0 R >>' FROM g_num x WHERE x.base = 1
  UNION ALL SELECT x.r, CAST(x.number AS BIGINT), '<< /Type /Page /Parent ' || CAST(p.number AS BIGINT) || ' 0 R /MediaBox [0 0 612 792] /Resources << ' || coalesce(u.t, '') || '>> /Contents ' || CAST(x.number + 1 AS BIGINT) || ' 0 R >>'
    FROM g_num x JOIN g_num p ON p.r = x.r AND p.base = 1 AND p.a = x.a LEFT JOIN g_uses u ON u.r = x.r AND u.page = x.node WHERE x.base = 2
  UNION ALL SELECT x.r, CAST(x.number + 1 AS BIGINT), '<< /Length ' || octet_length(encode(coalesce(c.content, ''))) || ' >>' || chr(10) || 'stream' || chr(10) || coalesce(c.content, '') || chr(10) || 'endstream'
    FROM g_num x LEFT JOIN g_content c ON c.r = x.r AND c.page = x.node WHERE x.base = 2
  UNION ALL SELECT r, number, '<< /Type /Font /Subtype /Type1 /BaseFont /' || CASE res WHEN 'f0' THEN 'Courier /Encoding /WinAnsiEncoding' WHEN 'f1' THEN 'Helvetica /Encoding /WinAnsiEncoding' WHEN 'f2' THEN 'Symbol' ELSE 'Times-Roman /Encoding /WinAnsiEncoding' END || ' >>' FROM g_font
), g_all AS (
  SELECT * FROM g_made UNION ALL SELECT r, max(n) + 1, '<< /Title <FEFF0041> /CreationDate (D:20240102030405Z) >>' FROM g_made WHERE r <> 1 GROUP BY r
)"""

ORACLES = {
    "rule_findings": f"WITH rules(k, severity, code, path) AS ({expected_sql()}) SELECT concat('c', c_custkey) AS doc_id, severity, code, path FROM customer JOIN rules ON c_custkey % {len(CASES)} = k",
    "rule_totals": f"WITH rules(k, severity, code, path) AS ({expected_sql()}) SELECT concat('c', c_custkey) AS doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM customer JOIN rules ON c_custkey % {len(CASES)} = k GROUP BY c_custkey",
    "matching_targets": f"{_HEAD}, {ENTRIES}, g_ref AS (SELECT r, dst, gen FROM g_entry WHERE dst IS NOT NULL UNION ALL SELECT r, dst, 0 FROM g_item WHERE dst IS NOT NULL UNION ALL SELECT r, 1, 0 FROM g_size)"
    f" SELECT {_DOC}, count(*) FILTER (dst <> 9999990 AND gen = 0) AS matched, count(*) FILTER (dst = 9999990 OR gen <> 0) AS unmatched FROM g_ref GROUP BY r",
    "owner_checks": "SELECT concat('n', c_nationkey) AS doc_id, c_custkey AS k FROM customer WHERE CASE WHEN c_custkey % 9 = 0 THEN 'x' WHEN c_custkey % 9 = 1 THEN NULL ELSE 'me' END IS DISTINCT FROM CASE WHEN c_nationkey % 5 <> 0 THEN 'me' END",
    "source_rules": f"{_HEAD} SELECT 'none' AS doc_id, 'missing-page-tree' AS code, 'pages' AS path, '-' AS related UNION ALL SELECT {_DOC}, 'page-node-reused', concat('pages[', 1000 + c, ']'), concat('pages[', up - 3, '].children[', kid, ']') FROM g_page WHERE c % 50 = 9"
    f" UNION ALL SELECT {_DOC}, 'foreign-source', concat('pages[', up - 3, '].children[', kid, ']'), '-' FROM g_page WHERE c % 50 = 11",
    "number_guards": "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, (p_partkey - 9) / 2.0::DOUBLE AS v, p_size AS s FROM part) SELECT id, CASE WHEN v = floor(v) AND v BETWEEN 1 AND 9999999999 THEN CAST(v AS BIGINT) ELSE -1 END AS object_number,"
    " CASE WHEN v = floor(v) AND v + 65000 BETWEEN 0 AND 65534 THEN CAST(v + 65000 AS BIGINT) ELSE -1 END AS generation, v > 0 AS positive, v = floor(v) AS safe, v BETWEEN 0 AND 100 AND s <= 25 AS rgb, id % 5 <> 0 AS box, id % 5 <> 0 AND v > 0 AS positive_box,"
    " CASE WHEN v = floor(v) THEN concat(s, ' ', CAST(v AS BIGINT), ' -1') ELSE '-' END AS joined FROM p",
    "name_guards": "SELECT conv_id, turn, turn % 3 <> 0 AS name, turn % 3 = 2 AS name_bytes, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii,"
    " CASE WHEN turn % 2 = 0 THEN '(' || role || ')' ELSE '<FEFF' || array_to_string(['00' || printf('%X', unicode(c)) for c in regexp_extract_all(role, '.')], '') || '>' END AS metadata FROM conversations",
    "uint16_values": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey * 7919 % 16777216 // 256 AS INT) AS first, CAST(p_partkey * 7919 % 65536 AS INT) AS second, -1 AS beyond FROM part",
    "slugs": f"SELECT CAST(p_partkey AS BIGINT) AS id, {_SLUG.format(s=chr(40) + 'p_name || chr(47) || p_brand || chr(33)' + chr(41))} AS slug, {_SLUG.format(s='p_brand')} || '/' || {_SLUG.format(s='p_type')} || '/' || {_SLUG.format(s='p_name')} AS path FROM part",
    "plain_numbers": "SELECT CAST(p_partkey AS BIGINT) AS id, rtrim('0.' || lpad(CAST(p_partkey + 1 AS STRING), 9, '0'), '0') AS small, CAST(p_partkey + 1 AS STRING) || '00000000000000000000' AS large FROM part",
    "commit_versions": "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 2 = 0 THEN substr(md5(p_name), 1, 8) ELSE md5(p_name) || 'main' END AS ref, 'v' || CAST(p_size AS STRING) || '.1' AS tag, CAST(p_size AS INT) AS major, 1 AS minor, 2 AS segments FROM part",
    "artifact_modes": "WITH m(id, o, ci) AS (VALUES " + ", ".join(f"({i}, {_Q(o)}, {_Q(ci)})" for i, (o, ci) in enumerate(MODES)) + ") SELECT id, CASE WHEN o IN ('update', 'verify') THEN o WHEN o IS NOT NULL THEN 'error' WHEN lower(coalesce(ci, '')) IN ('', '0', 'false') THEN 'update' ELSE 'verify' END AS mode FROM m",
    "registered_functions": f"SELECT CAST(p_partkey AS BIGINT) AS id, {_SLUG.format(s='p_name')} AS slug, rtrim(rtrim(printf('%.3f', p_partkey / 8.0), '0'), '.') AS number, {_SLUG.format(s='p_brand')} || '/x' AS path FROM part",
    "builder_numbers": "SELECT concat('c', o_custkey) AS doc_id, o_orderkey AS handle, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS object_number FROM orders",
    "folder_files": "SELECT concat(r_name, '/', n_name, '.txt') AS path, concat(n_name, ' of ', r_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "artifact_statuses": "SELECT step, status, files * (SELECT count(*) FROM nation) - less AS files, CAST(reports AS BIGINT) AS reports FROM (VALUES (0, 'mismatched', 0, 0, 1), (1, 'updated', 1, 0, 0), (2, 'matched', 1, 0, 0), (3, 'mismatched', 1, 0, 1), (4, 'updated', 1, 1, 0), (5, 'matched', 1, 1, 0)) AS v(step, status, files, less, reports)",
    "page_pixels": "SELECT concat('n', c_nationkey) AS doc_id, CAST(c AS INT) AS page_number, kind, CASE WHEN kind = 'pixels' THEN c % 7 ELSE -1 END AS differing FROM (SELECT c_nationkey, c_custkey AS c, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'removed' WHEN c_custkey % 13 = 0 THEN 'added'"
    " WHEN c_custkey % 17 = 1 THEN 'corrupt' WHEN c_custkey % 19 = 2 THEN 'size' WHEN c_custkey % 7 > 0 THEN 'pixels' END AS kind FROM customer) WHERE kind IS NOT NULL",
    "png_round_trip": "SELECT c_custkey AS id, CAST(1 + c_custkey % 5 AS INT) AS width, CAST(1 + c_custkey % 3 AS INT) AS height, sha256(unhex(repeat(lpad(printf('%X', c_custkey * 7919), 8, '0'), (1 + c_custkey % 5) * (1 + c_custkey % 3)))) AS digest FROM customer",
    "change_report": "SELECT concat('n', c_nationkey) AS doc_id, '<!DOCTYPE html><title>A &amp; B</title><table>' || chr(10) || string_agg(cell, chr(10) ORDER BY cell) || chr(10) || '</table>' || chr(10) AS html"
    " FROM (SELECT c_nationkey, '<tr><td>&lt;' || c_custkey || '&gt;</td><td>' || CASE WHEN c_custkey % 2 = 0 THEN 'added' ELSE 'changed' END || '</td></tr>' AS cell FROM customer) GROUP BY c_nationkey",
    "jpeg_images": "WITH v(k, error, space) AS (VALUES " + ", ".join(f"({i}, {_Q(e)}, {_Q(c)})" for i, (_, e, c) in enumerate(_pictures())) + f") SELECT concat('c', c_custkey) AS doc_id, error IS NULL AS ok, coalesce(error, '') AS error, CASE WHEN error IS NULL THEN 2 ELSE 0 END AS width, CASE WHEN error IS NULL THEN 3 ELSE 0 END AS height, space AS color_space FROM customer JOIN v ON c_custkey % {len(_pictures())} = k",
    "jpeg_segment_rows": "SELECT n_nationkey AS nation, o AS \"offset\", m AS marker, l AS length FROM nation CROSS JOIN (VALUES (2, 219, 65), (71, 196, 18), (93, 196, 18), (115, 192, 15), (134, 218, 10), (154, 217, 0)) AS v(o, m, l)",
    "operation_lines": "SELECT o AS page_id, CASE o % 22 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, *_) in enumerate(LINES)) + " END AS op, CASE o % 22 " + " ".join(f"WHEN {i} THEN {line}" for i, (*_, line) in enumerate(LINES)) + " END || chr(10) AS line FROM (SELECT o_orderkey AS o FROM orders)",
    "operation_faults": "WITH v(k, op, error) AS (VALUES " + ", ".join(f"({k}, {_Q(ops[-1][1])}, {_Q(e)})" for k, (ops, e) in enumerate(FAULTS) if e) + f") SELECT o_orderkey AS page_id, op, error FROM orders JOIN v ON o_orderkey % {len(FAULTS)} = k",
    "font_checks": "SELECT concat('f', p_partkey) AS font_id, 'not a standard font: ' || CASE p_partkey % 4 WHEN 2 THEN 'courier' ELSE p_name END AS error FROM part WHERE p_partkey % 4 >= 2",
    "record_checks": f"{_HEAD}, {OPERATIONS} SELECT DISTINCT {_DOC}, page AS page_id, 'font' AS kind, res AS res_id FROM g_op WHERE op = 'font' AND res = 'f3'",
    "metadata_checks": "SELECT concat('c', c_custkey) AS doc_id, 'title' AS field, 'the text needs version 1.2' AS error FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT concat('c', c_custkey), 'creation_date', 'the year must have four digits' FROM customer WHERE c_custkey % 5 = 0",
    "lowered_objects": f"{_LOWERED} SELECT {_DOC}, n AS object_number, body FROM g_all",
    "lowered_files": f"{_LOWERED}, g_whole AS (SELECT r, n, n || ' 0 obj' || chr(10) || body || chr(10) || 'endobj' || chr(10) AS t FROM g_all), g_at AS (SELECT r, n, t, 15 + coalesce(sum(octet_length(encode(t))) OVER (PARTITION BY r ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM g_whole),"
    " g_file AS (SELECT r, encode('%PDF-1.7' || chr(10)) || unhex('25E2E3CFD30A') || encode(string_agg(t, '' ORDER BY n) || 'xref' || chr(10) || '0 ' || max(n) + 1 || chr(10) || '0000000000 65535 f ' || chr(10) || string_agg(printf('%010d 00000 n ', CAST(pos AS BIGINT)) || chr(10), '' ORDER BY n)"
    " || 'trailer' || chr(10) || '<< /Size ' || max(n) + 1 || ' /Root 1 0 R' || CASE WHEN r <> 1 THEN ' /Info ' || max(n) || ' 0 R' ELSE '' END || ' >>' || chr(10) || 'startxref' || chr(10) || CAST(15 + sum(octet_length(encode(t))) AS BIGINT) || chr(10) || '%%EOF' || chr(10)) AS f FROM g_at GROUP BY r)"
    f" SELECT {_DOC}, octet_length(f) AS size, sha256(f) AS digest FROM g_file",
    "derived_page_counts": f"{_HEAD} SELECT {_DOC}, CAST(2 AS BIGINT) AS node_id, np AS count FROM g_size UNION ALL SELECT concat('r', a.r), a.num, count(p.c) FROM g_nation a LEFT JOIN g_page p ON p.n = a.n GROUP BY a.r, a.num",
    "workflow_uses": f"{_USES} SELECT path, ln AS line_index, action, ref, version FROM w_use",
    "workflow_groups": f"{_USES} SELECT action, version, arg_min(ref, (path, ln)) AS ref, count(*) AS occurrences FROM w_use GROUP BY action, version",
    "workflow_inputs": f"WITH {WORKFLOW}, w_next AS (SELECT *, min(CASE WHEN given THEN ln + 1 END) OVER w AS line, arg_min(k, ln) FILTER (given) OVER w AS nk FROM w_part WINDOW w AS (PARTITION BY brand ORDER BY ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
    " SELECT concat('w/', brand, '.yml') AS path, action, ln AS use_line, line AS line_index, concat('1.2.', nk) AS value FROM w_next WHERE odd NOT IN (4, 7) AND line IS NOT NULL",
    "workflow_rewrites": f"{_USES}, {_NEWEST} SELECT path, ln AS line_index, '      - uses: ' || u.action || '@ref2 # v10.2' AS line FROM w_use u JOIN w_new n ON u.action = n.action WHERE ref <> 'ref2'",
    "workflow_report": f"{_USES}, {_NEWEST}, w_group AS (SELECT action, version, arg_min(ref, (path, ln)) AS ref FROM w_use GROUP BY action, version) SELECT g.action, version, ref, CASE WHEN n.action IS NULL THEN '-' ELSE '10.2' END AS newest, CASE WHEN n.action IS NULL THEN '-' ELSE 'ref2' END AS commit, n.action IS NOT NULL AND ref <> 'ref2' AS has_update FROM w_group g LEFT JOIN w_new n ON g.action = n.action",
}
