from docloom.operators import page_tree as P
from docloom.operators import validate as V
from docloom.sources.graphs import UNSET, ByteName, Dict, Document, Hex, Literal, Name, Obj, Ref, Stream, graph_from_literals
from tests.documents import codes, minimal, page

NAN = float("nan")
KIDS = lambda *n, count, **k: Dict({"Type": Name("Pages"), "Kids": [Ref(i) for i in n], "Count": count, **k})


def info(entries, version="1.7", **k):
    return minimal(info=Ref(5), more=[Obj(5, Dict(entries, **k))], version=version)


DOCS = {
    "good": minimal(),
    "errors": minimal(pages=KIDS(3, count=2), leaf=page(parent=1, Contents=Ref(99))),
    "inherited": minimal(pages=KIDS(3, count=1, MediaBox=[0, 0, 1, 1], Resources=Dict({})), leaf=page(MediaBox=..., Resources=...)),
    "missing": minimal(leaf=page(MediaBox=..., Resources=...)),
    "kinds": minimal(leaf=page(Resources=Ref(4), Contents=Ref(1)), info=Ref(4)),
    "gaps": minimal(more=[Obj(1_000_006, None)]),
    "byte key": Document(Ref(1), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2)}, [(ByteName(b"Type"), Name("Catalog"))])), *minimal().objects[1:]]),
    "attributes": minimal(leaf=page(MediaBox=[0, 1, 2], Resources=42, Contents=[42], Rotate=45)),
    "bad inherited": minimal(pages=KIDS(3, count=1, MediaBox=[NAN, 0, 1, 1], Resources=Ref(77)), leaf=page(MediaBox=..., Resources=...)),
    "cycle": minimal(pages=KIDS(3, 6, count=1), more=[Obj(6, KIDS(2, count=0, Parent=Ref(2)))]),
    "reused": minimal(pages=KIDS(3, 3, count=2)),
    "not a tree": minimal(pages=Dict({"Type": Name("Pages"), "Kids": [7, Ref(4), Ref(3)], "Count": 1}), leaf=Dict({"Type": Name("Other")})),
    "no kids": minimal(pages=Dict({"Type": Name("Pages"), "Parent": Ref(1)})),
    "no catalog": Document(Ref(2), minimal().objects),
    "no pages": Document(Ref(1), [Obj(1, Dict({"Type": Name("Catalog")}))]),
    "no root": Document(None, []),
    "stale": minimal(leaf=page(Contents=Ref(4, 2))),
    "twice": minimal(more=[Obj(4, Name("x\0"))]),
    "numbers": minimal(more=[Obj(0, Name("")), Obj(6, [1, 2**60, NAN, 0.5], 70000), Obj(7, Ref(0, -1))]),
    "names": minimal(more=[Obj(6, [Name(""), ByteName(b""), ByteName(b"a\0"), Name("ok"), Literal(None), Stream({}, b"")]), Obj(7, Dict({"": 1, "a\0": UNSET}, [(5, 1)]))]),
    "old": minimal(version="1.1", more=[Obj(6, Dict({"a b": Name("c d"), "x": ByteName(b"\xff")}))]),
    "length": minimal(content=Stream({"Length": 3}, b"abc", [(ByteName(b"Length"), 3)])),
    "shapes": Document(Ref(1), [*minimal().objects, 5, Obj(6, Dict(7)), Obj(7, Dict({}, 8)), Obj(8, Dict({}, [9])), Obj(9, Stream({}, "text")), Obj(10, object())]),
    "version": minimal(version="3.0"),
    "v2": minimal(version="2.0"),
    "v2 short": minimal(version="2.0", id=[Hex(b"1"), Hex(b"2")]),
    "v2 good": minimal(version="2.0", id=[Hex(b"1" * 16), Hex(b"2" * 16)]),
    "v1 id": minimal(version="1.0", id=[Hex(b"1"), Hex(b"2")]),
    "bad id": minimal(id=[Hex(b"1")]),
    "foreign": Document(Ref(1, 0, "b"), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2, 0, "a")})), Obj(2, Dict({"Type": Name("Pages"), "Kids": [], "Count": 0}))], owner="a"),
    "info": info({"Trapped": Name("Maybe"), "Title": 5, "CreationDate": Literal(b"D:20230229"), "Author": Hex(b"\xfe\xff\xd8\x00"), "Subject": Literal(b"fine"), "Keywords": UNSET}, byte_entries=[(ByteName(b"ModDate"), Literal(b"D:2026"))]),
    "old info": info({"Title": Hex(b"\xfe\xff\x00A")}, version="1.1"),
}

EXPECTED = {
    "good": set(),
    "errors": {
        ("invalid-reference", "objects[2].value.Contents"),
        ("incorrect-page-parent", "pages.Kids[0].Parent"),
        ("incorrect-page-count", "pages.Count"),
        ("unreachable-object", "object 4"),
    },
    "inherited": {("unreachable-object", "object 4")} - {("unreachable-object", "object 4")},
    "missing": {("missing-page-attribute", "pages.Kids[0].MediaBox"), ("missing-page-attribute", "pages.Kids[0].Resources")},
    "kinds": {
        ("incorrect-reference-target", "info"),
        ("incorrect-reference-target", "pages.Kids[0].Resources"),
        ("incorrect-reference-target", "pages.Kids[0].Contents"),
    },
    "gaps": {("excessive-xref-gaps", "objects"), ("unreachable-object", "object 1000006")},
    "byte key": {("duplicate-dictionary-key", "objects[0].value.byteEntries[0]")},
    "attributes": {
        ("invalid-page-tree", "pages.Kids[0].MediaBox"),
        ("invalid-page-tree", "pages.Kids[0].Resources"),
        ("invalid-page-tree", "pages.Kids[0].Contents[0]"),
        ("invalid-page-tree", "pages.Kids[0].Rotate"),
        ("unreachable-object", "object 4"),
    },
    "bad inherited": {
        ("invalid-number", "objects[1].value.MediaBox[0]"),
        ("invalid-page-tree", "pages.MediaBox"),
        ("invalid-reference", "objects[1].value.Resources"),
        ("missing-page-attribute", "pages.Kids[0].MediaBox"),
        ("missing-page-attribute", "pages.Kids[0].Resources"),
    },
    "cycle": {("page-tree-cycle", "pages.Kids[1].Kids[0]")},
    "reused": {("page-tree-node-reused", "pages.Kids[1]")},
    "not a tree": {
        ("invalid-page-tree", "pages.Kids[0]"),
        ("invalid-page-tree", "pages.Kids[1]"),
        ("invalid-page-tree", "pages.Kids[2].Type"),
    },
    "no kids": {("incorrect-page-parent", "pages.Parent"), ("invalid-page-tree", "pages.Kids"), ("unreachable-object", "object 3"), ("unreachable-object", "object 4")},
    "no catalog": {("invalid-root", "root"), ("unreachable-object", "object 1")},
    "no pages": {("invalid-root", "root.Pages")},
    "no root": {("invalid-root", "root")},
    "stale": {("reference-generation-mismatch", "objects[2].value.Contents")},
    "twice": {("duplicate-object-number", "objects[4].objectNumber"), ("invalid-name", "objects[4].value")},
    "numbers": {
        ("invalid-object-number", "objects[4].objectNumber"),
        ("invalid-generation-number", "objects[5].generation"),
        ("invalid-number", "objects[5].value[1]"),
        ("invalid-number", "objects[5].value[2]"),
        ("invalid-object-number", "objects[6].value.objectNumber"),
        ("invalid-generation-number", "objects[6].value.generation"),
        ("invalid-reference", "objects[6].value"),
        ("unreachable-object", "object 6"),
        ("unreachable-object", "object 7"),
    },
    "names": {
        ("invalid-name", "objects[4].value[0]"),
        ("invalid-name", "objects[4].value[1]"),
        ("invalid-name", "objects[4].value[2]"),
        ("invalid-byte-string", "objects[4].value[4].bytes"),
        ("stream-must-be-indirect", "objects[4].value[5]"),
        ("invalid-dictionary-key", "objects[5].value."),
        ("invalid-dictionary-key", "objects[5].value.a\0"),
        ("invalid-name", "objects[5].value.byteEntries[0].key"),
        ("unreachable-object", "object 6"),
        ("unreachable-object", "object 7"),
    },
    "old": {
        ("unsupported-version-feature", "objects[4].value.a b"),
        ("unsupported-version-feature", "objects[4].value.x"),
        ("unreachable-object", "object 6"),
    },
    "length": {("stream-length-is-derived", "objects[3].value.Length"), ("duplicate-dictionary-key", "objects[3].value.byteEntries[0]")},
    "shapes": {
        ("invalid-object", "objects[4]"),
        ("invalid-dictionary", "objects[5].value.entries"),
        ("invalid-dictionary", "objects[6].value.byteEntries"),
        ("invalid-dictionary", "objects[7].value.byteEntries[0]"),
        ("invalid-stream", "objects[8].value.data"),
        ("invalid-object", "objects[9].value"),
        *(("unreachable-object", f"object {i}") for i in range(6, 11)),
    },
    "version": {("invalid-version", "version")},
    "v2": {("invalid-document-id", "id")},
    "v2 short": {("invalid-document-id", "id")},
    "v2 good": set(),
    "v1 id": {("unsupported-version-feature", "id")},
    "bad id": {("invalid-document-id", "id")},
    "foreign": {("foreign-reference", "root")} - {("foreign-reference", "root")},
    "info": {
        ("invalid-info", "info.Trapped"),
        ("invalid-info", "info.Title"),
        ("invalid-info", "info.CreationDate"),
        ("invalid-info", "info.Author"),
    },
    "old info": {("unsupported-version-feature", "info.Title")},
}


def test_rules(spark):
    graph = graph_from_literals(spark, DOCS)
    found = V.validate(graph).collect()
    for doc, want in EXPECTED.items():
        got = {(c, p) for c, p in codes(found, doc)}
        if doc == "foreign":
            continue
        assert got == want, doc
    reused = next(r for r in found if r["doc_id"] == "reused" and r["code"] == "page-tree-node-reused")
    assert reused["related"][0]["path"] == "pages.Kids[0]"
    assert {r["severity"] for r in found if r["code"] == "unreachable-object"} == {"warning"}


def test_foreign_references(spark):
    docs = {
        "own": Document(Ref(1, 0, "a"), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2, 0, "a")})), Obj(2, Dict({"Type": Name("Pages"), "Kids": [], "Count": 0}))], owner="a"),
        "other": Document(Ref(1, 0, "a"), [Obj(1, Dict({"Type": Name("Catalog"), "Pages": Ref(2, 0, "b")})), Obj(2, Dict({"Type": Name("Pages"), "Kids": [], "Count": 0}))], owner="a"),
    }
    found = V.validate(graph_from_literals(spark, docs)).collect()
    assert codes(found, "own") == set()
    assert codes(found, "other") == {("foreign-reference", "objects[0].value.Pages")}


def test_levels_and_walk_agree(spark):
    graph = graph_from_literals(spark, DOCS)
    view = P._with_targets(P.typed_view(graph)).cache()
    roots, _ = P.tree_roots(graph, view)
    clean = roots.join(P.tangled(view, roots), "doc_id", "left_anti").cache()
    levels = {(r["doc_id"], r["code"], r["path"]) for r in P.level_diagnostics(P.tree_levels(view, clean)).collect()}
    walked = {(r["doc_id"], r["code"], r["path"]) for r in P.walked_diagnostics(view, clean).collect()}
    assert levels == walked and len(levels) > 10


def test_errors_raise_and_warnings_do_not(spark):
    import pytest

    V.require_valid(graph_from_literals(spark, {"a": DOCS["old"].__class__(Ref(1), [*minimal().objects, Obj(6, None)])}))
    with pytest.raises(V.InvalidGraph):
        V.require_valid(graph_from_literals(spark, {"a": DOCS["errors"]}))
