"""Small documents with one fault each, and a document of that kind for every customer of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graphs import UNSET, ByteName, Dict, Document, Graph, Hex, Literal, Name, Obj, Ref, Stream, graph_from_literals
from ..stages import staged

NAN = float("nan")


def page(parent=2, **more):
    entries = {"Type": Name("Page"), "Parent": Ref(parent), "MediaBox": [0, 0, 612, 792], "Resources": Dict({}), "Contents": Ref(4)}
    return Dict({k: v for k, v in (entries | more).items() if v is not ...})


def tree(*kids, count, **more):
    return Dict({"Type": Name("Pages"), "Kids": [Ref(i) for i in kids], "Count": count, **more})


def minimal(pages=None, leaf=None, more=(), content=None, **k):
    objects = [
        Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2)})),
        Obj(2, pages or tree(3, count=1)),
        Obj(3, leaf or page()),
        Obj(4, content or Stream({}, b"BT\nET")),
        *more,
    ]
    return Document(Ref(1), objects, **k)


def info(entries, version="1.7", **k):
    return minimal(info=Ref(5), more=[Obj(5, Dict(entries, **k))], version=version)


def own(number: int, value, **k) -> Document:
    """A document whose page holds a reference to one more object, so that the object is reached."""
    return minimal(leaf=page(Extra=Ref(number)), more=[Obj(number, value)], **k)


LOOP: list = []
LOOP.append(LOOP)

#: (document, its diagnostics as (code, path); warnings are told by their code).
CASES = [
    (minimal(), []),
    (minimal(version="3.0"), [("invalid-version", "version")]),
    (Document(None, []), [("invalid-root", "root")]),
    (Document(Ref(2), minimal().objects), [("invalid-root", "root"), ("unreachable-object", "object 1")]),
    (Document(Ref(1), [Obj(1, Dict({"Type": Name("Catalog")}))]), [("invalid-root", "root.Pages")]),
    (minimal(info=7), [("invalid-reference", "info")]),
    (minimal(id=[Hex(b"1")]), [("invalid-document-id", "id")]),
    (minimal(version="2.0"), [("invalid-document-id", "id")]),
    (minimal(version="2.0", id=[Hex(b"1"), Hex(b"2")]), [("invalid-document-id", "id")]),
    (minimal(version="2.0", id=[Hex(b"1" * 16), Hex(b"2" * 16)]), []),
    (minimal(version="1.0", id=[Hex(b"1"), Hex(b"2")]), [("unsupported-version-feature", "id")]),
    (minimal(id=[Hex(None), Hex(b"2")]), [("invalid-byte-string", "id[0].bytes")]),
    (minimal(more=[Obj(0, Name("x"))]), [("invalid-object-number", "objects[4].objectNumber")]),
    (own(6, Name("x")), []),
    (minimal(leaf=page(Extra=Ref(6)), more=[Obj(6, None, 70000)]), [("invalid-generation-number", "objects[4].generation"), ("reference-generation-mismatch", "objects[2].value.Extra")]),
    (minimal(more=[Obj(4, None)]), [("duplicate-object-number", "objects[4].objectNumber")]),
    (minimal(more=[Obj(1_000_006, None)]), [("excessive-xref-gaps", "objects"), ("unreachable-object", "object 1000006")]),
    (minimal(leaf=page(Contents=Ref(99))), [("invalid-reference", "objects[2].value.Contents"), ("unreachable-object", "object 4")]),
    (minimal(leaf=page(Contents=Ref(4, 2))), [("reference-generation-mismatch", "objects[2].value.Contents")]),
    (minimal(leaf=page(Extra=Ref(0, -1))), [("invalid-object-number", "objects[2].value.Extra.objectNumber"), ("invalid-generation-number", "objects[2].value.Extra.generation"), ("invalid-reference", "objects[2].value.Extra")]),
    (Document(Ref(1, 0, "a"), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2, 0, "b")})), Obj(2, Dict({"Type": Name("Pages"), "Kids": [], "Count": 0}))], owner="a"), [("foreign-reference", "objects[0].value.Pages")]),
    (own(6, [1, 2**60, NAN, 0.5]), [("invalid-number", "objects[4].value[1]"), ("invalid-number", "objects[4].value[2]")]),
    (own(6, [Name(""), ByteName(b""), ByteName(b"a\0"), Name("ok")]), [("invalid-name", f"objects[4].value[{i}]") for i in range(3)]),
    (own(6, [Literal(None), Hex(b"x")]), [("invalid-byte-string", "objects[4].value[0].bytes")]),
    (own(6, [Stream({}, b"")]), [("stream-must-be-indirect", "objects[4].value[0]")]),
    (own(6, Dict({"": 1}, [(5, 1)])), [("invalid-dictionary-key", "objects[4].value."), ("invalid-name", "objects[4].value.byteEntries[0].key")]),
    (own(6, Dict({"a b": Name("c d"), "x": ByteName(b"\xff")}), version="1.1"), [("unsupported-version-feature", "objects[4].value.a b"), ("unsupported-version-feature", "objects[4].value.a b"), ("unsupported-version-feature", "objects[4].value.x")]),
    (Document(Ref(1), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2)}, [(ByteName(b"Type"), Name("Catalog"))])), *minimal().objects[1:]]), [("duplicate-dictionary-key", "objects[0].value.byteEntries[0]")]),
    (minimal(content=Stream({"Length": 3}, b"abc")), [("stream-length-is-derived", "objects[3].value.Length")]),
    (own(6, Stream({}, "text")), [("invalid-stream", "objects[4].value.data")]),
    (own(6, Dict(7)), [("invalid-dictionary", "objects[4].value.entries")]),
    (own(6, Dict({}, 8)), [("invalid-dictionary", "objects[4].value.byteEntries")]),
    (own(6, Dict({}, [9])), [("invalid-dictionary", "objects[4].value.byteEntries[0]")]),
    (own(6, object()), [("invalid-object", "objects[4].value")]),
    (Document(Ref(1), [*minimal().objects, 5]), [("invalid-object", "objects[4]")]),
    (own(6, LOOP), [("direct-object-cycle", "objects[4].value[0]")]),
    (info({"Trapped": Name("Maybe"), "Title": 5, "CreationDate": Literal(b"D:20230229"), "Author": Hex(b"\xfe\xff\xd8\x00"), "Subject": Literal(b"fine"), "Keywords": UNSET}), [("invalid-info", f"info.{k}") for k in ("Trapped", "Title", "CreationDate", "Author")]),
    (info({"Title": Hex(b"\xfe\xff\x00A")}, version="1.1"), [("unsupported-version-feature", "info.Title")]),
    (minimal(info=Ref(4)), [("incorrect-reference-target", "info")]),
    (minimal(leaf=page(Resources=Ref(4), Contents=Ref(1))), [("incorrect-reference-target", "pages.Kids[0].Resources"), ("incorrect-reference-target", "pages.Kids[0].Contents")]),
    (minimal(leaf=page(MediaBox=[0, 1, 2], Resources=42, Contents=[42], Rotate=45)), [*(("invalid-page-tree", f"pages.Kids[0].{k}") for k in ("MediaBox", "Resources", "Contents[0]", "Rotate")), ("unreachable-object", "object 4")]),
    (minimal(pages=tree(3, count=2), leaf=page(parent=1)), [("incorrect-page-parent", "pages.Kids[0].Parent"), ("incorrect-page-count", "pages.Count")]),
    (minimal(leaf=page(MediaBox=..., Resources=...)), [("missing-page-attribute", "pages.Kids[0].MediaBox"), ("missing-page-attribute", "pages.Kids[0].Resources")]),
    (minimal(pages=tree(3, count=1, MediaBox=[0, 0, 1, 1], Resources=Dict({})), leaf=page(MediaBox=..., Resources=...)), []),
    (minimal(pages=tree(3, 6, count=1), more=[Obj(6, tree(2, count=0, Parent=Ref(2)))]), [("page-tree-cycle", "pages.Kids[1].Kids[0]")]),
    (minimal(pages=tree(3, 3, count=2)), [("page-tree-node-reused", "pages.Kids[1]")]),
    (minimal(pages=tree(3, 6, 6, count=3), more=[Obj(6, tree(2, 3, count=2))]), [("incorrect-page-parent", "pages.Kids[1].Parent"), ("page-tree-cycle", "pages.Kids[1].Kids[0]"), ("page-tree-node-reused", "pages.Kids[1].Kids[1]"), ("page-tree-node-reused", "pages.Kids[2]")]),
]
WARNINGS = {"unreachable-object"}


def graph_of_customers(spark: SparkSession, sf_dir: str) -> Graph:
    """For every customer the document of CASES that its key chooses. The cases are few rows, and broadcast."""
    cases = graph_from_literals(spark, {str(i): d for i, (d, _) in enumerate(CASES)})
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc"), F.pmod("c_custkey", F.lit(len(CASES))).cast("string").alias("doc_id")
    )

    def spread(df: DataFrame, name: str) -> DataFrame:
        rows = keys.join(F.broadcast(df), "doc_id").drop("doc_id").withColumnRenamed("doc", "doc_id")
        return staged(rows.select(*df.columns), name)

    return Graph(*(spread(getattr(cases, n), n) for n in ("documents", "objects", "nodes", "flags")))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def expected_sql() -> str:
    """A VALUES list of (k, severity, code, path)."""
    rows = [(i, "warning" if c in WARNINGS else "error", c, p) for i, (_, found) in enumerate(CASES) for c, p in found]
    return "VALUES " + ", ".join(f"({i}, {_text(s)}, {_text(c)}, {_text(p)})" for i, s, c, p in rows)
