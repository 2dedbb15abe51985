"""Queries over the derived graphs, and SQL for the same rows from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import artifacts, content, lowering, page_tree, references, serialize, validate
from ..sources.graphs import Dict, Document, Graph, Name, Obj, Ref, graph_from_literals
from . import more
from .derived import EDGES, ENTRIES, GRAPH, OPERATIONS, derived_graph, derived_operations, derived_tree, views


def name_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    names = spark.sql("SELECT 'part' AS src, CAST(p_partkey AS BIGINT) AS id, p_name AS s FROM part UNION ALL SELECT 'url', page_id, url FROM pages")
    return names.select("src", "id", S.pdf_name(F.encode("s", "UTF-8")).alias("name"))


def literal_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", S.literal_string(F.encode("text", "UTF-8")).alias("literal"))


def hex_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", S.hex_string(F.encode("text", "UTF-8")).alias("hex"))


def utf16_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", S.hex_string(S.text_string("text")).alias("hex"))


def winansi_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    points = spark.range(0x20, 0x2123).select(F.col("id").alias("point"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("s"))
    points = points.where("point not between 55296 and 57343").withColumn("w", S.win_ansi("s"))
    return points.select("point", F.hex("w.bytes").alias("code"), F.col("w.error").isNotNull().alias("failed"))


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SELECT o_orderkey, o_orderdate FROM orders").select("o_orderkey", S.date_string("o_orderdate").alias("date_text"))


VARIANTS = """
SELECT o_orderkey, CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN 'D:2024' WHEN 1 THEN 'D:20240229010203Z' WHEN 2 THEN 'D:20230229' WHEN 3 THEN 'D:20261301'
  WHEN 4 THEN concat('D:', CAST(1990 + o_orderkey % 50 AS STRING), '0630235959+08''30''') WHEN 5 THEN 'D:20240101000000+24''00'
  WHEN 6 THEN 'D:20240431' ELSE concat('D:', CAST(o_orderkey AS STRING), 'x') END AS text FROM orders
"""


def date_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(VARIANTS.replace("''30''", "\\'30\\'").replace("''00", "\\'00")).select("o_orderkey", S.valid_date(F.col("text").cast("binary")).alias("valid"))


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.sql("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) - 25 AS whole, CAST(p_partkey AS DOUBLE) / 4 AS part FROM part")
    return rows.select("id", S.pdf_number("whole").alias("whole"), S.pdf_number("part").alias("part"))


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.missing_targets(derived_graph(spark, sf_dir))


def generation_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.generation_mismatches(derived_graph(spark, sf_dir))


def duplicate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.duplicate_numbers(derived_graph(spark, sf_dir)).select("doc_id", "object_number")


def unreachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.unreachable_objects(derived_graph(spark, sf_dir))


def garbage_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = references.collect_garbage(derived_graph(spark, sf_dir)).objects
    return kept.groupBy("doc_id").agg(F.countDistinct("object_number").alias("objects"), F.max("object_number").alias("highest"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived_graph(spark, sf_dir)
    view = page_tree._with_targets(page_tree.typed_view(graph))
    roots, _ = page_tree.tree_roots(graph, view)
    return page_tree.tree_levels(view, roots)


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    counts = page_tree.subtree_counts(levels)
    said = levels.where("type = 'Pages'").select("doc_id", "obj", F.col("count").cast("long").alias("said"))
    return counts.join(said, ["doc_id", "obj"]).select("doc_id", F.col("obj").alias("object_number"), F.col("leaves").cast("long").alias("leaves"), "said")


def page_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_tree.level_diagnostics(_levels(spark, sf_dir)).where("code = 'incorrect-page-parent'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("wrong_parents"))


def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_tree.level_diagnostics(_levels(spark, sf_dir)).where("code = 'missing-page-attribute'")
    return found.groupBy("doc_id", F.element_at(F.split("path", r"\."), -1).alias("attribute")).agg(F.count(F.lit(1)).alias("pages"))


def object_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = derived_graph(spark, sf_dir)
    body = serialize.object_bytes(graph, any_number=False)
    return body.select("doc_id", "object_number", F.col("bytes").cast("string").alias("body"))


def object_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = serialize.object_offsets(serialize.object_bytes(derived_graph(spark, sf_dir), any_number=False))
    return placed.select("doc_id", "object_number", "length", F.col("offset").cast("long").alias("offset"))


def xref_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = serialize.object_offsets(serialize.object_bytes(derived_graph(spark, sf_dir), any_number=False))
    return serialize.xref_table(placed).select("doc_id", "object_number", "entry")


def serialized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = serialize.serialize(derived_graph(spark, sf_dir), any_number=False)
    return files.select("doc_id", F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("digest"))


def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.resource_names(derived_operations(spark, sf_dir)).select("doc_id", "page_id", "kind", "res_id", "name")


def object_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = lowering.preorder(derived_tree(spark, sf_dir))
    nodes, resources = lowering.number_tree(tree, derived_operations(spark, sf_dir))
    pages = nodes.where("kind <> 'root'").select("doc_id", F.col("node_id").cast("string").alias("what"), F.col("object_number").cast("long").alias("object_number"))
    return pages.unionByName(resources.select("doc_id", F.col("res_id").alias("what"), F.col("object_number").cast("long").alias("object_number")))


def content_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_contents(derived_operations(spark, sf_dir))


def operation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations with the font of some lines taken away, checked as the builder does."""
    ops = derived_operations(spark, sf_dir).where("not (op = 'font' and op_idx = 4 and page_id % 5 = 0)")
    fonts = spark.sql("SELECT DISTINCT concat('r', r_regionkey) AS doc_id, concat('f', k) AS font_id, 'Courier' AS base_font FROM region CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)")
    images = spark.createDataFrame([], "doc_id string, image_id string")
    return content.operation_errors(ops, fonts, images).groupBy("doc_id", "error").agg(F.count(F.lit(1)).alias("operations"))


def artifact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.sql("SELECT concat('page-', c_custkey) AS path, c_custkey AS k, encode(c_name, 'UTF-8') AS bytes FROM customer")
    before = rows.where("k % 11 <> 0").select("path", "bytes")
    after = rows.where("k % 13 <> 0").select("path", F.when(F.col("k") % 17 == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("bytes")).alias("bytes"))
    return artifacts.changes(before, after)


def raster_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.sql("SELECT concat('n', c_nationkey) AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS page_number, array(0D, 0D, CAST(300 + c_custkey % 400 AS DOUBLE), CAST(400 + c_custkey % 500 AS DOUBLE)) AS mediabox, CAST(90 * (c_custkey % 4) AS INT) AS rotation FROM customer")
    return artifacts.manifests(artifacts.raster_sizes(rows, 96.0), 96)


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql("SELECT page_id, html FROM pages").select("page_id", S.escape_html("html").alias("escaped"))


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    rows = spark.sql("SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('#', lpad(hex(p_partkey % 4096), 3, '0')) WHEN p_partkey % 3 = 1 THEN concat('#', lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) ELSE 'white' END AS s FROM part")
    return rows.select("id", F.coalesce(S.background("s"), F.lit(-1)).alias("colour"))


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest version of each brand's parts; tags that aren't plain versions are left out."""
    views(spark, sf_dir)
    rows = spark.sql("SELECT p_brand AS brand, concat('v', p_size, '.', p_partkey % 7, CASE WHEN p_partkey % 5 = 0 THEN '-beta' ELSE concat('.', p_partkey % 11) END) AS tag FROM part")
    rows = rows.withColumn("version", S.semver("tag")).where("version is not null")
    return rows.groupBy("brand").agg(F.max(F.struct("version", "tag")).alias("m")).select("brand", "m.tag")


def diagnostics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.validate(derived_graph(spark, sf_dir))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("findings"))


def info_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of conversations as metadata bytes: UTF-16 with every fifth one cut by a byte."""
    views(spark, sf_dir)
    rows = spark.sql("SELECT conv_id, turn, text FROM conversations").withColumn("b", S.text_string("text"))
    cut = F.when(F.col("turn") % 5 == 4, F.unhex(F.expr("substring(hex(b), 1, length(hex(b)) - 2)"))).otherwise(F.col("b"))
    return rows.select("conv_id", "turn", S.valid_unicode_encoding(cut).alias("valid"))


def page_tree_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a supplier whose page tree runs in circles and shares nodes."""
    kids = lambda *n: Dict({"Type": Name("Pages"), "Kids": [Ref(i) for i in n], "Count": len(n)})
    leaf = Dict({"Type": Name("Page"), "Parent": Ref(2)})
    two = {str(i): Document(Ref(1), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2)})), Obj(2, kids(3, 3 + i, 4)), Obj(3, leaf), Obj(4, kids(2, 3))]) for i in (0, 1)}
    cases = graph_from_literals(spark, two)
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), (F.col("s_suppkey") % 2).cast("string").alias("doc_id"))
    spread = lambda df: keys.join(F.broadcast(df), "doc_id").drop("doc_id").withColumnRenamed("doc", "doc_id").select(*df.columns)  # noqa: E731  two documents
    graph = Graph(*(spread(getattr(cases, n)) for n in ("documents", "objects", "nodes", "flags")))
    return page_tree.page_tree_diagnostics(graph).select("doc_id", "code", "path")


QUERIES = {
    f.__name__: f
    for f in (
        diagnostics_summary, name_encode, literal_escape, hex_strings, utf16_text, winansi_encode, date_strings, date_valid, number_text, missing_targets,
        generation_mismatch, duplicate_numbers, unreachable_objects, garbage_collected, page_counts, page_parents, inherited_attributes, object_bodies,
        object_offsets, xref_table, serialized_files, resource_names, object_numbering, content_stream, operation_errors, artifact_changes, raster_manifest,
        html_escape, backgrounds, newest_versions, info_rules, page_tree_dirty,
    )
}

_BYTES = "[substr(hex(encode({s})), CAST(2 * i - 1 AS INT), 2) for i in range(1, octet_length(encode({s})) + 1)]"
_NAME = (
    "'/' || array_to_string([CASE WHEN b >= '21' AND b <= '7E' AND b NOT IN ('28','29','3C','3E','5B','5D','7B','7D','2F','25','23') THEN chr(CAST('0x' || b AS INT)) ELSE '#' || b END"
    f" for b in {_BYTES}], '')"
)
_LITERAL = (
    "'(' || array_to_string([CASE b WHEN '08' THEN '\\b' WHEN '09' THEN '\\t' WHEN '0A' THEN '\\n' WHEN '0C' THEN '\\f' WHEN '0D' THEN '\\r' WHEN '28' THEN '\\(' WHEN '29' THEN '\\)' WHEN '5C' THEN '\\\\'"
    " ELSE CASE WHEN b >= '20' AND b <= '7E' THEN chr(CAST('0x' || b AS INT)) ELSE '\\' || CAST(CAST('0x' || b AS INT) // 64 AS STRING) || CAST(CAST('0x' || b AS INT) // 8 % 8 AS STRING) || CAST(CAST('0x' || b AS INT) % 8 AS STRING) END END"
    f" for b in {_BYTES}], '') || ')'"
)
_BODY = """
g_kids AS (SELECT r, num, ord, string_agg(CASE WHEN dst IS NULL THEN CAST(CAST(v AS BIGINT) AS STRING) ELSE CAST(dst AS STRING) || ' 0 R' END, ' ' ORDER BY i) AS t FROM g_item GROUP BY r, num, ord),
g_text AS (
  SELECT e.r, e.num, string_agg('/' || e.k || ' ' || CASE e.kind WHEN 'name' THEN '/' || e.t WHEN 'reference' THEN CAST(e.dst AS STRING) || ' ' || CAST(e.gen AS STRING) || ' R'
    WHEN 'number' THEN CAST(CAST(e.v AS BIGINT) AS STRING) WHEN 'dictionary' THEN '<< >>' WHEN 'array' THEN '[' || coalesce(x.t, '') || ']' ELSE '(' || e.t || ')' END, ' ' ORDER BY e.ord) AS t
  FROM g_entry e LEFT JOIN g_kids x ON e.r = x.r AND e.num = x.num AND e.ord = x.ord GROUP BY e.r, e.num
), g_body AS (
  SELECT o.r, o.num, CAST(o.num AS STRING) || ' 0 obj' || chr(10) || CASE WHEN o.what = 'stream'
      THEN '<< /Length ' || CAST(6 + length(CAST(o.num AS STRING)) AS STRING) || ' >>' || chr(10) || 'stream' || chr(10) || 'q' || chr(10) || '% ' || CAST(o.num AS STRING) || chr(10) || 'Q' || chr(10) || 'endstream'
      WHEN o.r = 3 AND o.num = 2 THEN 'null' ELSE '<< ' || t.t || ' >>' END || chr(10) || 'endobj' || chr(10) AS body
  FROM g_object o LEFT JOIN g_text t ON o.r = t.r AND o.num = t.num
), g_place AS (
  SELECT r, num, octet_length(encode(body)) AS len, 15 + coalesce(sum(octet_length(encode(body))) OVER (PARTITION BY r ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM g_body
)
"""
_XREF = """
g_top AS (SELECT r, max(num) AS top FROM g_object GROUP BY r),
g_free AS (
  SELECT r, n, lead(n, 1, 0) OVER (PARTITION BY r ORDER BY n) AS nxt FROM (SELECT r, unnest(range(1, top + 1)) AS n FROM g_top) x
  WHERE NOT EXISTS (SELECT 1 FROM g_object o WHERE o.r = x.r AND o.num = x.n)
), g_xref AS (
  SELECT r, CAST(0 AS BIGINT) AS n, printf('%010d 65535 f ', coalesce((SELECT min(n) FROM g_free f WHERE f.r = g_top.r), 0)) || chr(10) AS entry FROM g_top
  UNION ALL SELECT r, n, printf('%010d 00000 f ', nxt) || chr(10) FROM g_free
  UNION ALL SELECT r, num, printf('%010d 00000 n ', CAST(pos AS BIGINT)) || chr(10) FROM g_place
)
"""
_HEAD = f"WITH RECURSIVE {GRAPH}"
_DOC = "concat('r', r) AS doc_id"
_REACH = """
g_seen AS (
  SELECT r, CAST(1 AS BIGINT) AS n FROM g_size
  UNION SELECT e.r, e.dst FROM g_seen s JOIN g_edge e ON e.r = s.r AND e.src = s.n JOIN g_object o ON o.r = e.r AND o.num = e.dst
)
"""
_USED = """
g_first AS (SELECT r, page, res, min(seq) AS first FROM g_op WHERE op = 'font' GROUP BY r, page, res),
g_name AS (SELECT r, page, res, first, 'F' || CAST(row_number() OVER (PARTITION BY r, page ORDER BY first) - 1 AS STRING) AS name FROM g_first)
"""

ORACLES = {
    "name_encode": f"SELECT 'part' AS src, CAST(p_partkey AS BIGINT) AS id, {_NAME.format(s='p_name')} AS name FROM part UNION ALL SELECT 'url', page_id, {_NAME.format(s='url')} FROM pages",
    "literal_escape": f"SELECT conv_id, turn, {_LITERAL.format(s='text')} AS literal FROM conversations",
    "hex_strings": "SELECT conv_id, turn, '<' || hex(encode(text)) || '>' AS hex FROM conversations",
    "utf16_text": "SELECT conv_id, turn, '<FEFF' || array_to_string([lpad(printf('%X', unicode(c)), 4, '0') for c in regexp_extract_all(text, '(?s).')], '') || '>' AS hex FROM conversations",
    "winansi_encode": "WITH special(point, code) AS (VALUES "
    + ", ".join(f"({k}, '{v:02X}')" for k, v in S.WINDOWS_1252.items())
    + ") SELECT p.point, CASE WHEN p.point < 128 OR p.point BETWEEN 160 AND 255 THEN printf('%02X', p.point) ELSE s.code END AS code,"
    " NOT (p.point < 128 OR p.point BETWEEN 160 AND 255 OR s.code IS NOT NULL) AS failed FROM (SELECT unnest(range(32, 8483)) AS point) p LEFT JOIN special s ON p.point = s.point",
    "date_strings": "SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%SZ') AS date_text FROM orders",
    "date_valid": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 4) THEN true ELSE false END AS valid FROM orders",
    "number_text": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CAST(p_size AS BIGINT) - 25 AS STRING) AS whole, CAST(CAST(p_partkey AS BIGINT) // 4 AS STRING) || CASE CAST(p_partkey AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS part FROM part",
    "missing_targets": f"{_HEAD} SELECT {_DOC}, concat('objects[', num, '].value.Contents') AS path, CAST(9999990 AS BIGINT) AS ref_obj, CASE WHEN stale THEN 1 ELSE 0 END AS ref_gen FROM g_page WHERE lost",
    "generation_mismatch": f"{_HEAD} SELECT {_DOC}, concat('objects[', num, '].value.Contents') AS path, body AS ref_obj, 1 AS ref_gen, 0 AS found_gen FROM g_page WHERE stale AND NOT lost",
    "duplicate_numbers": "SELECT 'r3' AS doc_id, CAST(2 AS BIGINT) AS object_number",
    "unreachable_objects": f"{_HEAD}, {EDGES}, {_REACH} SELECT DISTINCT concat('r', o.r) AS doc_id, o.num AS object_number FROM g_object o WHERE NOT EXISTS (SELECT 1 FROM (SELECT s.r, s.n FROM g_seen s WHERE s.r <> 3 OR s.n <= 2) s WHERE s.r = o.r AND s.n = o.num)",
    "garbage_collected": f"{_HEAD}, {EDGES}, {_REACH} SELECT {_DOC}, count(DISTINCT n) AS objects, max(n) AS highest FROM g_seen WHERE r <> 3 OR n <= 2 GROUP BY r",
    "page_counts": f"{_HEAD} SELECT concat('r', a.r) AS doc_id, a.num AS object_number, count(p.c) AS leaves, count(p.c) + CASE WHEN a.bad_count THEN 1 ELSE 0 END AS said FROM g_nation a LEFT JOIN g_page p ON p.n = a.n WHERE a.r <> 3 GROUP BY a.r, a.num, a.bad_count"
    " UNION ALL SELECT concat('r', r), 2, np, np FROM g_size WHERE r <> 3",
    "page_parents": f"{_HEAD} SELECT {_DOC}, count(*) AS wrong_parents FROM g_page WHERE bad_parent AND r <> 3 GROUP BY r",
    "inherited_attributes": f"{_HEAD} SELECT {_DOC}, 'MediaBox' AS attribute, count(*) AS pages FROM g_page WHERE NOT has_box AND NOT up_box AND r <> 3 GROUP BY r"
    f" UNION ALL SELECT {_DOC}, 'Resources', count(*) FROM g_page WHERE NOT has_res AND NOT up_res AND r <> 3 GROUP BY r",
    "object_bodies": f"{_HEAD}, {ENTRIES}, {_BODY} SELECT {_DOC}, num AS object_number, body FROM g_body",
    "object_offsets": f"{_HEAD}, {ENTRIES}, {_BODY} SELECT {_DOC}, num AS object_number, len AS length, CAST(pos AS BIGINT) AS offset FROM g_place".replace(" AS offset", ' AS "offset"'),
    "xref_table": f"{_HEAD}, {ENTRIES}, {_BODY}, {_XREF} SELECT {_DOC}, n AS object_number, entry FROM g_xref",
    "serialized_files": f"{_HEAD}, {ENTRIES}, {_BODY}, {_XREF}, g_file AS ("
    "SELECT t.r, encode('%PDF-1.7' || chr(10)) || unhex('25E2E3CFD30A') || encode((SELECT string_agg(body, '' ORDER BY num) FROM g_body b WHERE b.r = t.r) || 'xref' || chr(10) || '0 ' || CAST(t.top + 1 AS STRING) || chr(10)"
    " || (SELECT string_agg(entry, '' ORDER BY n) FROM g_xref x WHERE x.r = t.r) || 'trailer' || chr(10) || '<< /Size ' || CAST(t.top + 1 AS STRING) || ' /Root 1 0 R >>' || chr(10) || 'startxref' || chr(10)"
    " || CAST((SELECT 15 + sum(len) FROM g_place p WHERE p.r = t.r) AS STRING) || chr(10) || '%%EOF' || chr(10)) AS f FROM g_top t) SELECT " + _DOC + ", octet_length(f) AS size, sha256(f) AS digest FROM g_file",
    "resource_names": f"{_HEAD}, {OPERATIONS}, {_USED} SELECT {_DOC}, page AS page_id, 'font' AS kind, res AS res_id, name FROM g_name",
    "object_numbering": f"{_HEAD}, {OPERATIONS}, {_USED}, g_walk AS ("
    "SELECT r, num AS node, num AS a, CAST(0 AS BIGINT) AS b, 1 AS base FROM g_nation UNION ALL SELECT r, num, up, kid + 1, 2 FROM g_page), g_pos AS ("
    "SELECT *, row_number() OVER (PARTITION BY r ORDER BY a, b) AS place FROM g_walk), g_new AS ("
    "SELECT f.r, f.res, p.place, row_number() OVER (PARTITION BY f.r, f.res ORDER BY p.place) AS nth, f.first FROM g_first f JOIN g_pos p ON p.r = f.r AND p.node = f.page), g_fresh AS ("
    "SELECT r, res, place, row_number() OVER (PARTITION BY r, place ORDER BY first) AS k FROM g_new WHERE nth = 1), g_cost AS ("
    "SELECT p.*, p.base + (SELECT count(*) FROM g_fresh f WHERE f.r = p.r AND f.place = p.place) AS cost FROM g_pos p), g_num AS ("
    "SELECT *, 3 + coalesce(sum(cost) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM g_cost) "
    f"SELECT {_DOC}, CAST(node AS STRING) AS what, CAST(number AS BIGINT) AS object_number FROM g_num UNION ALL SELECT concat('r', f.r), f.res, CAST(n.number + 1 + f.k AS BIGINT) FROM g_fresh f JOIN g_num n ON n.r = f.r AND n.place = f.place",
    "content_stream": f"{_HEAD}, {OPERATIONS}, {_USED}, g_out AS (SELECT o.r, o.page, o.frag, o.seq, CASE o.op WHEN 'font' THEN '/' || n.name || ' ' || CAST(CAST(o.a AS INT) AS STRING) || ' Tf' WHEN 'moveText' THEN '0 -14 Td'"
    " WHEN 'show' THEN '(\\(' || substr(o.t, 2, length(o.t) - 2) || '\\)) Tj' WHEN 'moveTo' THEN CAST(CAST(o.a AS INT) AS STRING) || ' 10 m' ELSE CAST(CAST(o.a AS INT) AS STRING) || ' ' || CAST(CAST(o.b AS INT) AS STRING) || ' l' END || chr(10) AS line"
    " FROM g_op o LEFT JOIN g_name n ON o.op = 'font' AND n.r = o.r AND n.page = o.page AND n.res = o.res), g_frag AS ("
    "SELECT r, page, frag, CASE WHEN frag = 0 THEN 'BT' ELSE 'q' END || chr(10) || string_agg(line, '' ORDER BY seq) || CASE WHEN frag = 0 THEN 'ET' ELSE 'Q' END || chr(10) AS t FROM g_out GROUP BY r, page, frag)"
    f" SELECT {_DOC}, page AS page_id, string_agg(t, '' ORDER BY frag) AS content FROM g_frag GROUP BY r, page",
    "operation_errors": f"{_HEAD}, {OPERATIONS} SELECT {_DOC}, 'text needs a font first' AS error, count(*) AS operations FROM g_op WHERE op = 'show' AND seq = 6 AND page % 5 = 0 GROUP BY r",
    "artifact_changes": "SELECT concat('page-', c_custkey) AS path, CASE WHEN c_custkey % 11 = 0 THEN 'added' WHEN c_custkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS kind FROM customer"
    " WHERE (c_custkey % 11 = 0) <> (c_custkey % 13 = 0) OR (c_custkey % 17 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)",
    "raster_manifest": "WITH p AS (SELECT c_nationkey AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS total, ceil((300 + c_custkey % 400) * 96.0 / 72) AS w, ceil((400 + c_custkey % 500) * 96.0 / 72) AS h, c_custkey % 2 = 1 AS turned FROM customer), "
    "t AS (SELECT n, string_agg(chr(9) || chr(9) || '{' || chr(10) || chr(9) || chr(9) || chr(9) || '\"file\": \"page-' || lpad(CAST(k AS STRING), CAST(greatest(3, length(CAST(total AS STRING))) AS INT), '0') || '.png\",' || chr(10) || chr(9) || chr(9) || chr(9) || '\"width\": ' || CAST(CAST(CASE WHEN turned THEN h ELSE w END AS INT) AS STRING) || ',' || chr(10)"
    " || chr(9) || chr(9) || chr(9) || '\"height\": ' || CAST(CAST(CASE WHEN turned THEN w ELSE h END AS INT) AS STRING) || chr(10) || chr(9) || chr(9) || '}', ',' || chr(10) ORDER BY k) AS s FROM p GROUP BY n)"
    " SELECT concat('n', n) AS doc_id, '{' || chr(10) || chr(9) || '\"resolution\": 96,' || chr(10) || chr(9) || '\"background\": \"#ffffff\",' || chr(10) || chr(9) || '\"pages\": [' || chr(10) || s || chr(10) || chr(9) || ']' || chr(10) || '}' || chr(10) AS manifest FROM t",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
    "backgrounds": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 4278190080 + (p_partkey % 16) * 17 * 65536 + (p_partkey // 16 % 16) * 17 * 256 + (p_partkey // 256 % 16) * 17"
    " WHEN p_partkey % 3 = 1 THEN 4278190080 + (p_partkey * 7919 % 256) * 65536 + (p_partkey * 7919 // 256 % 256) * 256 + (p_partkey * 7919 // 65536 % 256) ELSE -1 END AS BIGINT) AS colour FROM part",
    "newest_versions": "SELECT p_brand AS brand, arg_max(concat('v', p_size, '.', p_partkey % 7, '.', p_partkey % 11), p_size * 1000 + (p_partkey % 7) * 20 + p_partkey % 11) AS tag FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_brand",
    "info_rules": "SELECT conv_id, turn, turn % 5 <> 4 AS valid FROM conversations",
    "diagnostics_summary": f"{_HEAD} SELECT 'error' AS severity, 'duplicate-object-number' AS code, CAST(1 AS BIGINT) AS findings"
    " UNION ALL SELECT 'error', 'invalid-reference', count(*) FROM g_page WHERE lost"
    " UNION ALL SELECT 'error', 'reference-generation-mismatch', count(*) FROM g_page WHERE stale AND NOT lost"
    " UNION ALL SELECT 'error', 'incorrect-page-parent', count(*) FROM g_page WHERE bad_parent AND r <> 3"
    " UNION ALL SELECT 'error', 'missing-page-attribute', count(*) FROM (SELECT 1 FROM g_page WHERE NOT has_box AND NOT up_box AND r <> 3 UNION ALL SELECT 1 FROM g_page WHERE NOT has_res AND NOT up_res AND r <> 3) x"
    " UNION ALL SELECT 'error', 'invalid-page-tree', count(*) + 1 FROM g_page WHERE bad_turn AND r <> 3"
    " UNION ALL SELECT 'error', 'incorrect-page-count', count(*) FROM g_nation WHERE bad_count AND r <> 3"
    " UNION ALL SELECT 'warning', 'unreachable-object', (SELECT count(*) FROM g_supplier) + (SELECT count(*) FROM g_page WHERE lost AND r <> 3) + (SELECT count(*) - 2 FROM (SELECT DISTINCT num FROM g_object WHERE r = 3) y) - (SELECT count(*) FROM g_supplier WHERE r = 3)",
    "page_tree_dirty": "WITH v(k, code, path) AS (VALUES (0, 'missing-page-attribute', 'pages.Kids[0].MediaBox'), (0, 'missing-page-attribute', 'pages.Kids[0].Resources'), (1, 'missing-page-attribute', 'pages.Kids[0].MediaBox'),"
    " (1, 'missing-page-attribute', 'pages.Kids[0].Resources'), (0, 'page-tree-node-reused', 'pages.Kids[1]'), (0, 'incorrect-page-parent', 'pages.Kids[2].Parent'), (0, 'page-tree-cycle', 'pages.Kids[2].Kids[0]'), (0, 'page-tree-node-reused', 'pages.Kids[2].Kids[1]'),"
    " (1, 'incorrect-page-parent', 'pages.Kids[1].Parent'), (1, 'page-tree-cycle', 'pages.Kids[1].Kids[0]'), (1, 'page-tree-node-reused', 'pages.Kids[1].Kids[1]'), (1, 'page-tree-node-reused', 'pages.Kids[2]')) SELECT concat('s', s_suppkey) AS doc_id, code, path FROM supplier JOIN v ON s_suppkey % 2 = k",
}

QUERIES |= more.QUERIES
ORACLES |= more.ORACLES
