"""Object graphs derived from the relational test tables, in SQL that Spark and other engines read alike.

One document per region: catalog 1, page tree 2, a Pages node per nation, a
Page and a content stream per customer, and an object per supplier that
nothing leads to. Faults are put in by the keys, so that every rule has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graphs import DOCUMENTS, FLAGS, NODES, OBJECTS, Graph
from ..stages import staged

TABLES = "region nation customer supplier part orders conversations documents pages".split()

#: Nations and pages with their numbers and faults. Each text is a list of common table expressions.
PAGES = """
g_nation AS (
  SELECT n_regionkey AS r, n_nationkey AS n, 2 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS num,
         count(*) OVER (PARTITION BY n_regionkey) AS nn, n_nationkey % 3 = 0 AS has_box, n_nationkey % 2 = 0 AS has_res,
         n_nationkey % 7 = 2 AS bad_count
  FROM nation
), g_customer AS (
  SELECT a.r, a.n, a.num AS up, a.nn, a.has_box AS up_box, a.has_res AS up_res, c.c_custkey AS c,
         row_number() OVER (PARTITION BY a.r ORDER BY c.c_custkey) AS pn, count(*) OVER (PARTITION BY a.r) AS np,
         row_number() OVER (PARTITION BY a.r, a.n ORDER BY c.c_custkey) - 1 AS kid,
         c.c_name AS c_name, c.c_mktsegment AS segment
  FROM customer c JOIN g_nation a ON c.c_nationkey = a.n
), g_page AS (
  SELECT r, n, up, up_box, up_res, c, c_name, segment, kid, nn, np, pn, 2 + nn + pn AS num, 2 + nn + np + pn AS body,
         c % 97 = 5 AS bad_parent, c % 53 = 7 AS lost, c % 71 = 3 AS stale, c % 61 <> 11 AS has_box, c % 89 <> 4 AS has_res,
         c % 101 = 1 AS bad_turn
  FROM g_customer
)"""
#: Numbers of each document, of the suppliers' objects, and of all objects.
_SIZES = """g_size AS (
  SELECT r, max(nn) AS nn, max(np) AS np FROM g_page GROUP BY r
)"""
_SUPPLIERS = """g_supplier AS (
  SELECT z.r, s.s_suppkey AS s, s.s_name AS s_name,
         2 + z.nn + 2 * z.np + 2 * row_number() OVER (PARTITION BY z.r ORDER BY s.s_suppkey) AS num
  FROM supplier s JOIN nation t ON s.s_nationkey = t.n_nationkey JOIN g_size z ON t.n_regionkey = z.r
)"""
_OBJECTS = """g_object AS (
  SELECT r, CAST(1 AS BIGINT) AS num, 'catalog' AS what FROM g_size
  UNION ALL SELECT r, 2, 'root' FROM g_size
  UNION ALL SELECT r, num, 'nation' FROM g_nation
  UNION ALL SELECT r, num, 'page' FROM g_page
  UNION ALL SELECT r, body, 'stream' FROM g_page
  UNION ALL SELECT r, num, 'supplier' FROM g_supplier
)
"""

NUMBERED = _OBJECTS
GRAPH = f"{PAGES}, {_SIZES}, {_SUPPLIERS}, {_OBJECTS}"

#: Edges between numbers: g_edge (r, src, dst, gen, key).
EDGES = """
g_edge AS (
  SELECT r, 1 AS src, CAST(2 AS BIGINT) AS dst, 0 AS gen, 'Pages' AS k FROM g_size
  UNION ALL SELECT r, 2, num, 0, 'Kids' FROM g_nation
  UNION ALL SELECT r, num, 2, 0, 'Parent' FROM g_nation
  UNION ALL SELECT r, up, num, 0, 'Kids' FROM g_page
  UNION ALL SELECT r, num, CASE WHEN bad_parent THEN 2 ELSE up END, 0, 'Parent' FROM g_page
  UNION ALL SELECT r, num, CASE WHEN lost THEN 9999990 ELSE body END, CASE WHEN stale THEN 1 ELSE 0 END, 'Contents' FROM g_page
  UNION ALL SELECT r, num, 2, 0, 'Next' FROM g_supplier
)
"""


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def page_views(spark: SparkSession, sf_dir: str) -> None:
    """The tables, and nations, pages, sizes and suppliers computed once, as views: what is derived from them reads them often."""
    views(spark, sf_dir)
    for t, made in (("g_nation", PAGES), ("g_page", PAGES), ("g_size", _SIZES), ("g_supplier", _SUPPLIERS)):
        staged(spark.sql(f"WITH {made} SELECT * FROM {t}"), t).createOrReplaceTempView(t)


#: Entries of all dictionaries: place among the entries, key, kind and values; arrays have their items in g_item.
ENTRIES = """
g_entry AS (
  SELECT r, CAST(1 AS BIGINT) AS num, 0 AS ord, 'Type' AS k, 'name' AS kind, 'Catalog' AS t, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS BIGINT) AS dst, 0 AS gen FROM g_size
  UNION ALL SELECT r, 1, 1, 'Pages', 'reference', NULL, NULL, 2, 0 FROM g_size
  UNION ALL SELECT r, 2, 0, 'Type', 'name', 'Pages', NULL, NULL, 0 FROM g_size
  UNION ALL SELECT r, 2, 1, 'Kids', 'array', NULL, NULL, NULL, 0 FROM g_size
  UNION ALL SELECT r, 2, 2, 'Count', 'number', NULL, np, NULL, 0 FROM g_size
  UNION ALL SELECT r, num, 0, 'Type', 'name', 'Pages', NULL, NULL, 0 FROM g_nation
  UNION ALL SELECT r, num, 1, 'Kids', 'array', NULL, NULL, NULL, 0 FROM g_nation
  UNION ALL SELECT a.r, a.num, 2, 'Count', 'number', NULL, (SELECT count(*) FROM g_page p WHERE p.n = a.n) + CASE WHEN a.bad_count THEN 1 ELSE 0 END, NULL, 0 FROM g_nation a
  UNION ALL SELECT r, num, 3, 'Parent', 'reference', NULL, NULL, 2, 0 FROM g_nation
  UNION ALL SELECT r, num, 4, 'MediaBox', 'array', NULL, NULL, NULL, 0 FROM g_nation WHERE has_box
  UNION ALL SELECT r, num, 5, 'Resources', 'dictionary', NULL, NULL, NULL, 0 FROM g_nation WHERE has_res
  UNION ALL SELECT r, num, 0, 'Type', 'name', 'Page', NULL, NULL, 0 FROM g_page
  UNION ALL SELECT r, num, 1, 'Parent', 'reference', NULL, NULL, CASE WHEN bad_parent THEN 2 ELSE up END, 0 FROM g_page
  UNION ALL SELECT r, num, 2, 'MediaBox', 'array', NULL, NULL, NULL, 0 FROM g_page WHERE has_box
  UNION ALL SELECT r, num, 3, 'Resources', 'dictionary', NULL, NULL, NULL, 0 FROM g_page WHERE has_res
  UNION ALL SELECT r, num, 4, 'Contents', 'reference', NULL, NULL, CASE WHEN lost THEN 9999990 ELSE body END, CASE WHEN stale THEN 1 ELSE 0 END FROM g_page
  UNION ALL SELECT r, num, 5, 'Rotate', 'number', NULL, CASE WHEN bad_turn THEN 45 ELSE 90 END, NULL, 0 FROM g_page
  UNION ALL SELECT r, num, 0, 'Name', 'literal-string', s_name, NULL, NULL, 0 FROM g_supplier
  UNION ALL SELECT r, num, 1, 'Next', 'reference', NULL, NULL, 2, 0 FROM g_supplier
), g_item AS (
  SELECT r, CAST(2 AS BIGINT) AS num, 1 AS ord, row_number() OVER (PARTITION BY r ORDER BY num) - 1 AS i, 'reference' AS kind, CAST(NULL AS DOUBLE) AS v, num AS dst FROM g_nation
  UNION ALL SELECT r, up, 1, kid, 'reference', NULL, num FROM g_page
  UNION ALL SELECT a.r, a.num, 4, b.i, 'number', b.v, NULL FROM g_nation a CROSS JOIN (VALUES (0, 0.0), (1, 0.0), (2, 612.0), (3, 792.0)) AS b(i, v) WHERE a.has_box
  UNION ALL SELECT a.r, a.num, 2, b.i, 'number', b.v, NULL FROM g_page a CROSS JOIN (VALUES (0, 0.0), (1, 0.0), (2, 612.0), (3, 792.0)) AS b(i, v) WHERE a.has_box
)
"""


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of all regions. The objects of region 3 have a second definition of number 1."""
    page_views(spark, sf_dir)
    head = f"WITH {NUMBERED}, {ENTRIES} "
    doc = "concat('r', r) AS doc_id"
    objects = spark.sql(
        head + f"SELECT {doc}, CAST(num AS INT) AS obj_index, num AS object_number, 0 AS generation, true AS generation_ok, what FROM g_object"
        " UNION ALL SELECT 'r3', 0, 2, 0, true, 'again'"
    )
    roots = objects.selectExpr(
        "doc_id", "obj_index", "0 AS node_id", "CAST(NULL AS INT) AS parent_node", "0 AS depth", "0 AS ord", "CAST(NULL AS STRING) AS entry_side",
        "CAST(NULL AS STRING) AS key_kind", "CAST(NULL AS STRING) AS key_text", "concat('objects[', obj_index, '].value') AS path",
        "CASE what WHEN 'stream' THEN 'stream' WHEN 'again' THEN 'null' ELSE 'dictionary' END AS kind", "CAST(NULL AS DOUBLE) AS num_val",
        "CAST(NULL AS STRING) AS text_val", "CASE WHEN what = 'stream' THEN encode(concat('q\\n% ', obj_index, '\\nQ'), 'UTF-8') END AS bytes_val", "CAST(NULL AS BIGINT) AS ref_obj", "CAST(NULL AS INT) AS ref_gen",
    )
    entries = spark.sql(
        head + f"SELECT {doc}, CAST(num AS INT) AS obj_index, ord + 1 AS node_id, 0 AS parent_node, 1 AS depth, ord, 'entries' AS entry_side, 'name' AS key_kind, k AS key_text,"
        " concat('objects[', num, '].value.', k) AS path, kind, v AS num_val, CASE WHEN kind = 'name' THEN t END AS text_val,"
        " CASE WHEN kind = 'literal-string' THEN encode(t, 'UTF-8') END AS bytes_val, dst AS ref_obj, CASE WHEN dst IS NOT NULL THEN gen END AS ref_gen FROM g_entry"
    )
    items = spark.sql(
        head + f"SELECT {doc}, CAST(num AS INT) AS obj_index, CAST((ord + 1) * 10000000 + i AS INT) AS node_id, ord + 1 AS parent_node, 2 AS depth, CAST(i AS INT) AS ord, CAST(NULL AS STRING) AS entry_side,"
        " 'index' AS key_kind, CAST(NULL AS STRING) AS key_text, concat('objects[', num, '].value.', CASE WHEN kind = 'reference' THEN 'Kids' ELSE 'MediaBox' END, '[', i, ']') AS path, kind, v AS num_val, CAST(NULL AS STRING) AS text_val,"
        " CAST(NULL AS BINARY) AS bytes_val, dst AS ref_obj, CASE WHEN dst IS NOT NULL THEN 0 END AS ref_gen FROM g_item"
    )
    nodes = roots.unionByName(entries).unionByName(items).withColumns(
        {
            "key_bytes": F.lit(None).cast("binary"), "bool_val": F.lit(None).cast("boolean"), "ref_owner": F.lit(None).cast("string"),
            "ref_ok": F.when(F.col("kind") == "reference", F.lit(True)), "gen_ok": F.when(F.col("kind") == "reference", F.lit(True)),
        }
    )
    documents = spark.sql(
        head + f"SELECT {doc}, '1.7' AS version, named_struct('obj', 1L, 'gen', 0) AS root, true AS root_ok, CAST(NULL AS struct<obj:bigint,gen:int>) AS info,"
        " 'absent' AS info_state, CAST(NULL AS array<binary>) AS id, 'absent' AS id_state, CAST(NULL AS STRING) AS owner_id FROM g_size"
    )
    to = lambda df, ddl: df.select(*[F.col(f.name).cast(f.dataType) for f in _schema(ddl)])
    whole = lambda df, ddl, name: staged(to(df, ddl), name)  # noqa: E731  every rule reads these
    return Graph(whole(documents, DOCUMENTS, "documents"), whole(objects, OBJECTS, "objects"), whole(nodes, NODES, "nodes"), spark.createDataFrame([], FLAGS))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


#: Drawing operations of every page: the customer's orders, four fonts by segment, text and lines.
OPERATIONS = """
g_line AS (
  SELECT p.r, p.num AS page, p.segment, o.o_orderkey AS o, o.o_orderpriority AS priority,
         row_number() OVER (PARTITION BY p.r, p.num ORDER BY o.o_orderkey) AS k
  FROM g_page p JOIN orders o ON o.o_custkey = p.c
), g_op AS (
  SELECT r, page, 0 AS frag, 'text' AS fk, 4 * k AS seq, 'font' AS op, CAST(8 + o % 5 AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, concat('f', o % 4) AS res, CAST(NULL AS STRING) AS t FROM g_line
  UNION ALL SELECT r, page, 0, 'text', 4 * k + 1, 'moveText', 0, -14, NULL, NULL FROM g_line
  UNION ALL SELECT r, page, 0, 'text', 4 * k + 2, 'show', NULL, NULL, NULL, concat('(', priority, ')') FROM g_line
  UNION ALL SELECT r, page, 1, 'graphics', 2 * k, 'moveTo', k, 10, NULL, NULL FROM g_line WHERE o % 3 = 0
  UNION ALL SELECT r, page, 1, 'graphics', 2 * k + 1, 'lineTo', k, 20 + o % 7, NULL, NULL FROM g_line WHERE o % 3 = 0
)
"""


def derived_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    page_views(spark, sf_dir)
    ops = spark.sql(
        f"WITH {NUMBERED}, {OPERATIONS} SELECT concat('r', r) AS doc_id, page AS page_id, frag AS frag_idx, fk AS frag_kind, CAST(seq AS INT) AS op_idx, op,"
        " filter(array(a, b), x -> x IS NOT NULL) AS args, res AS res_id, t AS text, CAST(NULL AS BINARY) AS bytes FROM g_op"
    )
    return staged(ops, "operations")


def derived_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical page trees of the same documents: root, nations, customers."""
    page_views(spark, sf_dir)
    tree = spark.sql(
        f"WITH {NUMBERED} SELECT concat('r', r) AS doc_id, CAST(2 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS child_idx, 'root' AS kind, CAST(NULL AS array<double>) AS mediabox, 0 AS rotation, CAST(NULL AS STRING) AS owner_id FROM g_size"
        " UNION ALL SELECT concat('r', r), num, 2, CAST(num - 3 AS INT), 'pages', NULL, 0, NULL FROM g_nation"
        " UNION ALL SELECT concat('r', r), num, up, CAST(kid AS INT), 'page', array(0D, 0D, 612D, 792D), 0, NULL FROM g_page"
    )
    return staged(tree, "tree")
