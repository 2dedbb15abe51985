import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import artifacts, content, jpeg, lowering, png, references, serialize
from docloom.sources.graphs import UNSET, ByteName, Dict, Document, Hex, Literal, Name, Obj, Ref, graph_from_literals, key_order, number_objects, read_files, read_graph
from docloom.streaming.diagnostics import stream_value_rules
from tests.documents import minimal

GOLDEN = (
    b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"
    b"2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
    b"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << >> /Contents 4 0 R >>\nendobj\n"
    b"4 0 obj\n<< /Length 5 >>\nstream\nBT\nET\nendstream\nendobj\n"
    b"xref\n0 5\n0000000000 65535 f \n0000000015 00000 n \n0000000064 00000 n \n0000000121 00000 n \n0000000225 00000 n \n"
    b"trailer\n<< /Size 5 /Root 1 0 R >>\nstartxref\n279\n%%EOF\n"
)


def test_golden_file_and_gaps(spark, tmp_path):
    extra = Obj(6, [1.5, True, None, Name("n"), Dict({"B": 2, "Missing": UNSET, "A A": Literal(b"x")}, [(ByteName(b"\xff"), Ref(1))])])
    graph = graph_from_literals(spark, {"m": minimal(), "x": minimal(id=[Hex(b"\x01\x02"), Hex(b"\xab")], more=[extra])})
    files = {r["doc_id"]: bytes(r["bytes"]) for r in serialize.serialize(graph).collect()}
    assert files["m"] == GOLDEN
    assert b"6 0 obj\n[1.5 true null /n << /B 2 /A#20A (x) /#FF 1 0 R >>]\nendobj\n" in files["x"]
    assert b"xref\n0 7\n0000000005 65535 f \n" in files["x"] and b"\n0000000000 00000 f \n0000000279 00000 n \n" in files["x"]
    assert b"/ID [<0102> <AB>] >>" in files["x"]
    graph.write(str(tmp_path / "g"))
    again = serialize.serialize(read_graph(spark, str(tmp_path / "g")))
    assert {r["doc_id"]: bytes(r["bytes"]) for r in again.collect()} == files
    serialize.write_files(again, str(tmp_path / "out"))
    assert (tmp_path / "out" / "m.pdf").read_bytes() == GOLDEN
    assert sorted(r["path"] for r in read_files(spark, str(tmp_path / "out")).collect()) == ["m.pdf", "x.pdf"]
    assert read_files(spark, str(tmp_path / "none")).count() == 0


def test_prefix_sums_do_not_depend_on_buckets(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("doc_id"), "id", (F.col("id") % 17).alias("v"))
    get = lambda n: {r["id"]: r["s"] for r in serialize.prefix_sums(rows, "id", "v", "s", n).collect()}
    assert get(7) == get(1 << 20)


def test_garbage_collection(spark):
    docs = {"a": minimal(more=[Obj(9, None)]), "b": Document(Ref(1), [Obj(1, Dict({"x": Ref(2, 0, "other")})), Obj(2, None)], owner="me")}
    kept = references.collect_garbage(graph_from_literals(spark, docs)).objects.collect()
    assert {(r["doc_id"], r["object_number"]) for r in kept} == {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1)}
    made = spark.createDataFrame([("a", "x", 5), ("a", "y", 2), ("b", "z", 1)], "doc_id string, handle string, creation_ord int")
    assert {r["handle"]: r["object_number"] for r in number_objects(made).collect()} == {"y": 1, "x": 2, "z": 1}
    assert [k for k, _ in key_order({"b": 1, "10": 2, "2": 3, "01": 4})] == ["2", "10", "b", "01"]


OPS = [
    ("d", 10, 0, "text", 0, "font", [12.0], "h", None), ("d", 10, 0, "text", 1, "moveText", [72.0, 720.0], None, None), ("d", 10, 0, "text", 2, "show", [], None, "Hello (PDF)"),
    ("d", 10, 1, "graphics", 0, "drawImage", [30.0, 40.0, 20.0, 10.0], "g", None), ("d", 10, 1, "graphics", 1, "drawImage", [0.0, 0.0, 1.0, 1.0], "c", None),
    ("d", 11, 0, "text", 0, "font", [9.0], "h", None), ("d", 11, 0, "text", 1, "font", [9.0], "z", None),
]
OP_COLUMNS = "doc_id string, page_id bigint, frag_idx int, frag_kind string, op_idx int, op string, args array<double>, res_id string, text string"


def _tables(spark):
    ops = spark.createDataFrame(OPS, OP_COLUMNS).withColumn("bytes", F.lit(None).cast("binary"))
    fonts = spark.createDataFrame([("d", "h", "Helvetica"), ("d", "z", "ZapfDingbats")], "doc_id string, font_id string, base_font string")
    images = spark.createDataFrame([("d", "g", 2, 3, "DeviceGray", bytearray(b"GG")), ("d", "c", 4, 5, "DeviceRGB", bytearray(b"RGB"))], "doc_id string, image_id string, width int, height int, color_space string, bytes binary")
    return ops, fonts, images


def test_content_and_resources(spark):
    ops, fonts, images = _tables(spark)
    pages = {r["page_id"]: r["content"] for r in content.page_contents(ops).collect()}
    assert pages[10].startswith("BT\n/F0 12 Tf\n72 720 Td\n(Hello \\(PDF\\)) Tj\nET\nq\nq\n20 0 0 10 30 40 cm\n/Im0 Do\nQ\n")
    names = {(r["page_id"], r["res_id"]): r["name"] for r in content.resource_names(ops).collect()}
    assert names == {(10, "h"): "F0", (10, "g"): "Im0", (10, "c"): "Im1", (11, "h"): "F0", (11, "z"): "F1"}
    versions = spark.createDataFrame([("d", 10, "1.1"), ("d", 11, "1.1")], "doc_id string, page_id bigint, version string")
    sets = {r["page_id"]: r["proc_set"] for r in content.procedure_sets(versions, content.resource_names(ops), images).collect()}
    assert sets == {10: ["PDF", "Text", "ImageB", "ImageC"], 11: ["PDF", "Text"]}


def test_operation_errors(spark):
    _, fonts, images = _tables(spark)
    bad = [
        ("d", 1, 0, "text", 0, "show", [], None, "x"), ("d", 1, 0, "text", 1, "font", [0.0], "h", None), ("d", 1, 0, "text", 2, "font", [1.0], "?", None),
        ("d", 1, 1, "graphics", 0, "lineWidth", [-1.0], None, None), ("d", 1, 1, "graphics", 1, "rgbFill", [0.0, 2.0, 0.0], None, None), ("d", 1, 1, "graphics", 2, "moveTo", [1.0], None, None),
        ("d", 1, 1, "graphics", 3, "drawImage", [0.0, 0.0, 0.0, 1.0], "g", None), ("d", 1, 1, "graphics", 4, "show", [], None, "x"), ("d", 1, 1, "graphics", 5, "lineTo", [1.0, float("inf")], None, None),
        ("d", 2, 0, "text", 0, "font", [1.0], "z", None), ("d", 2, 0, "text", 1, "show", [], None, "x"), ("d", 3, 0, "text", 0, "font", [1.0], "h", None), ("d", 3, 0, "text", 1, "show", [], None, "Ω"),
    ]
    ops = spark.createDataFrame(bad, OP_COLUMNS).withColumn("bytes", F.lit(None).cast("binary"))
    found = content.operation_errors(ops, fonts, images).collect()
    assert len(found) == 11 and len({r["error"] for r in found}) == 11


def test_lowering(spark):
    ops, fonts, images = _tables(spark)
    tree = [("d", 1, None, 0, "root", None), ("d", 10, 1, 0, "page", [0.0, 0.0, 612.0, 792.0]), ("d", 5, 1, 1, "pages", None), ("d", 11, 5, 0, "page", [0.0, 0.0, 595.0, 842.0])]
    nodes = spark.createDataFrame([(*t, 90 if t[1] == 11 else 0, None) for t in tree], "doc_id string, node_id bigint, parent_id bigint, child_idx int, kind string, mediabox array<double>, rotation int, owner_id string")
    documents = spark.createDataFrame([("d", "1.7")], "doc_id string, version string")
    meta = spark.createDataFrame([("d", "AΩ", None, None, None, None, None, None, None)], "doc_id string, title string, author string, subject string, keywords string, creator string, producer string, creation_date timestamp, modification_date timestamp")
    data = bytes(lowering.lowered_files(documents, nodes, ops, fonts, images, meta).first()["bytes"])
    for part in (
        b"2 0 obj\n<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 >>", b"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F0 5 0 R >> /XObject << /Im0 6 0 R /Im1 7 0 R >> >> /Contents 4 0 R >>",
        b"5 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"8 0 obj\n<< /Type /Pages /Kids [9 0 R] /Count 1 /Parent 2 0 R >>",
        b"9 0 obj\n<< /Type /Page /Parent 8 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F0 5 0 R /F1 11 0 R >> >> /Contents 10 0 R /Rotate 90 >>",
        b"11 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /ZapfDingbats >>", b"/Width 2 /Height 3 /ColorSpace /DeviceGray", b"12 0 obj\n<< /Title <FEFF004103A9> >>", b"/Size 13 /Root 1 0 R /Info 12 0 R >>",
    ):
        assert part in data, part
    reused = nodes.union(nodes.where("node_id = 10").withColumn("child_idx", F.lit(2)))
    found = lowering.source_diagnostics(reused, spark.createDataFrame([("d", None), ("e", None)], "doc_id string, owner_id string")).collect()
    assert {(r["doc_id"], r["code"], r["path"], r["related"]) for r in found} == {("d", "page-node-reused", "pages[2]", "pages[0]"), ("e", "missing-page-tree", "pages", None)}


def picture(parts=3):
    seg = lambda m, p: bytes([0xFF, m]) + (len(p) + 2).to_bytes(2, "big") + p
    quant = seg(0xDB, bytes([0]) + bytes([1] * 64))
    dc = seg(0xC4, bytes([0x00, 1, *[0] * 15, 0]))
    ac = seg(0xC4, bytes([0x10, 1, *[0] * 15, 0]))
    frame = seg(0xC0, bytes([8, 0, 3, 0, 2, parts]) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(parts)))
    scan = seg(0xDA, bytes([parts]) + b"".join(bytes([i + 1, 0]) for i in range(parts)) + b"\x00\x3f\x00")
    return [b"\xff\xd8", quant, dc, ac, frame, scan, b"\x12\xff\x00\xff\xd0\x34", b"\xff\xd9"]


def test_jpeg(spark):
    p, grey = picture(), picture(1)
    cases = {
        "rgb": (p, True), "grey": (grey, True), "no start": ([b"xx", *p[1:]], False), "no quant": ([p[0], *p[2:]], False), "late table": ([*p[:2], *p[3:6], p[6], p[2], p[7]], False),
        "no end": (p[:-1], False), "no data": ([*p[:6], p[7]], False), "progressive": ([*p[:4], p[4].replace(b"\xff\xc0", b"\xff\xc2"), *p[5:]], False), "zero": ([p[0], p[1][:-1] + b"\0", *p[2:]], False),
        "no frame": ([*p[:4], *p[5:]], False), "garbage": ([p[0], b"zz", *p[1:]], False), "cut": ([b"".join(p)[:20]], False), "12 bits": ([*p[:4], p[4].replace(b"\x08\x00\x03", b"\x0c\x00\x03"), *p[5:]], False),
        "spectral": ([*p[:5], p[5][:-2] + b"\x3e\x00", *p[6:]], False), "oversubscribed": ([*p[:2], p[2][:5] + bytes([3, *[0] * 15, 0, 1, 2]), *p[3:]], False),
    }
    rows = [("d", k, bytearray(b"".join(v))) for k, (v, _) in cases.items()] + [("d", "null", None)]
    found = {r["image_id"]: r for r in jpeg.inspect_images(spark.createDataFrame(rows, "doc_id string, image_id string, bytes binary")).collect()}
    assert {k for k, r in found.items() if r["ok"]} == {k for k, (_, ok) in cases.items() if ok}
    assert (found["rgb"]["width"], found["rgb"]["height"], found["rgb"]["color_space"], found["grey"]["color_space"]) == (2, 3, "DeviceRGB", "DeviceGray")
    jpeg.register_segments(spark)
    spark.createDataFrame([(bytearray(b"".join(p)),)], "b binary").createOrReplaceTempView("jpegs")
    marks = spark.sql("SELECT s.marker FROM jpegs, LATERAL jpeg_segments(b) s ORDER BY s.offset").collect()
    assert [m[0] for m in marks] == [0xDB, 0xC4, 0xC4, 0xC0, 0xDA, 0xD9]


def test_artifacts(spark, tmp_path):
    make = lambda d: spark.createDataFrame([(k, bytearray(v)) for k, v in d.items()], "path string, bytes binary")
    before, after = make({"a": b"1", "b": b"2", "n/c": b"3"}), make({"a": b"1", "b": b"x", "d": b"4"})
    assert {(r["path"], r["kind"]) for r in artifacts.changes(before, after).collect()} == {("b", "changed"), ("n/c", "removed"), ("d", "added")}
    golden = str(tmp_path / "golden")
    assert artifacts.check_artifact(make({"a": b"1"}), make({"a": b"1"}), golden, "verify") == "matched"
    assert artifacts.check_artifact(read_files(spark, golden), after, golden, "update") == "updated"
    assert sorted(os.listdir(golden)) == ["a", "b", "d"]
    assert artifacts.check_artifact(before, after, golden, "verify", str(tmp_path / "bad")) == "mismatched"
    assert os.path.exists(tmp_path / "bad" / "report.html") and os.path.exists(tmp_path / "bad" / "expected" / "n" / "c")
    (tmp_path / "bad" / "old").write_bytes(b"stale")
    assert artifacts.check_artifact(before, before, golden, "verify", str(tmp_path / "bad")) == "matched" and not os.path.exists(tmp_path / "bad")
    modes = [({"CI": "true"}, "verify"), ({"CI": "0"}, "update"), ({"CI": "False"}, "update"), ({"CI": "no"}, "verify"), ({}, "update"), ({"CI": "1", "PDF_ARTIFACTS": "update"}, "update")]
    assert all(artifacts.default_mode(env) == mode for env, mode in modes)
    with pytest.raises(ValueError):
        artifacts.default_mode({"PDF_ARTIFACTS": "Verify"})
    with pytest.raises(ValueError):
        artifacts.replace_folder(make({"../x": b"1"}), golden)
    image = lambda c: png.encode(2, 1, bytes(c * 4 + [9] * 4))
    e, a = make({"page-001.png": image([1]), "page-002.png": b"junk", "m": b"1"}), make({"page-001.png": image([2]), "page-002.png": image([3]), "m": b"1"})
    assert artifacts.check_artifact(e, a, golden, "verify", str(tmp_path / "bad"), b"%PDF") == "mismatched"
    assert (tmp_path / "bad" / "actual.pdf").read_bytes() == b"%PDF" and os.listdir(tmp_path / "bad" / "diff") == ["page-001.png"]
    assert png.decode((tmp_path / "bad" / "diff" / "page-001.png").read_bytes())[2][:4] == bytes(artifacts.MARK)
    white, one = bytes([255] * 16), bytes([255] * 12 + [0, 0, 0, 255])
    page = lambda n, px, w=2, h=2: ("d", n, w, h, bytearray(px) if px is not None else None)
    e = spark.createDataFrame([page(1, white), page(2, white), page(3, white), page(4, white[:8], 2, 1), page(5, b"x")], artifacts.PAGES)
    a = spark.createDataFrame([page(1, white), page(2, one), page(4, white), page(5, white), page(6, white)], artifacts.PAGES)
    found = {r["page_number"]: (r["kind"], r["differing"]) for r in artifacts.page_differences(e, a).collect()}
    assert found == {2: ("pixels", 1), 3: ("removed", None), 4: ("size", None), 5: ("corrupt", None), 6: ("added", None)}
    pages = spark.createDataFrame([("d", 1, [0.0, 0.0, 612.0, 792.0], 0), ("d", 2, [0.0, 0.0, 612.0, 792.0], 90), ("d", 3, [0.0, 0.0, 400.0, 240.0], 0)], "doc_id string, page_number int, mediabox array<double>, rotation int")
    sizes = [(r["width"], r["height"]) for r in artifacts.raster_sizes(pages, 96).orderBy("page_number").collect()]
    assert sizes == [(816, 1056), (1056, 816), (534, 320)]


def _filtered(px, kinds, colour, extra=()):
    """A PNG of (height, width, samples) pixels whose rows use these filters, made by the definition of the filters."""
    h, w, n = px.shape
    out = b""
    for y in range(h):
        kind, row = kinds[y % len(kinds)], b""
        for x in range(w):
            for k in range(n):
                a, b, c = (int(px[j, i, k]) if i >= 0 and j >= 0 else 0 for j, i in ((y, x - 1), (y - 1, x), (y - 1, x - 1)))
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row += bytes([(int(px[y, x, k]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255])
        out += bytes([kind]) + row
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(out)[:7]), (b"IDAT", zlib.compress(out)[7:]), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(png._chunk(k, d) for k, d in parts)


def test_png():
    r = np.random.default_rng(1)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        px = r.integers(0, 256, (11, 7, n), np.uint8)
        w, h, got = png.decode(_filtered(px, (0, 1, 2, 3, 4), colour))
        got = np.frombuffer(got, np.uint8).reshape(h, w, 4)
        grey = n < 3
        assert (w, h) == (7, 11) and (got[..., :3] == (px[..., :1] if grey else px[..., :3])).all()
        assert (got[..., 3] == (px[..., -1] if n in (2, 4) else 255)).all()
    px = r.integers(0, 3, (4, 5, 1), np.uint8)
    colours = bytes(range(9))
    _, _, got = png.decode(_filtered(px, (4,), 3, [(b"PLTE", colours), (b"tRNS", b"\x07")]))
    assert got[:4] == bytes([*colours[3 * px[0, 0, 0] : 3 * px[0, 0, 0] + 3], 7 if px[0, 0, 0] == 0 else 255])
    data = png.encode(3, 2, bytes(range(24)))
    assert png.decode(data) == (3, 2, bytes(range(24)))
    for bad in (b"", b"x" + data, data[:-12], data[:-20], data.replace(b"IDAT", b"IDAX"), _filtered(px, (4,), 3)):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_reachable_over_long_chains(spark):
    """A chain of 20,000 whose nodes lead back too, a circle, and a comb."""
    n = 20_000
    chain = spark.range(n).selectExpr("'a' AS doc_id", "id AS src", "id + 1 AS dst")
    back = spark.range(1, n, 3).selectExpr("'a' AS doc_id", "id AS src", "0L AS dst")
    circle = spark.range(300).selectExpr("'b' AS doc_id", "id AS src", "(id + 1) % 300 AS dst")
    comb = spark.range(200).selectExpr("'c' AS doc_id", "id AS src", "explode(array(id + 1, id + 1000)) AS dst")
    start = spark.createDataFrame([("a", 5), ("b", 7), ("c", 0), ("d", 9)], "doc_id string, n long")
    got = references.reachable(start, chain.union(back).union(circle).union(comb)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {"a": n + 1, "b": 300, "c": 401, "d": 1}


def test_metadata_and_records(spark):
    meta = spark.sql("SELECT 'd' AS doc_id, 'AΩ' AS title, 'x' AS author, '' AS subject, '' AS keywords, '' AS creator, '' AS producer, TIMESTAMP '+12026-01-01 00:00:00' AS creation_date, TIMESTAMP '2026-01-01 00:00:00' AS modification_date")
    for version, want in (("1.1", {("title",), ("creation_date",)}), ("1.4", {("creation_date",)})):
        documents = spark.createDataFrame([("d", version)], "doc_id string, version string")
        assert {(r["field"],) for r in lowering.metadata_errors(meta, documents).collect()} == want
    ops, fonts, images = _tables(spark)
    lost = lowering.record_errors(ops, fonts.where("font_id = 'h'"), images.limit(0)).collect()
    assert {(r["page_id"], r["res_id"]) for r in lost} == {(10, "g"), (10, "c"), (11, "z")}
    odd = fonts.union(spark.createDataFrame([("d", "q", "Comic")], "doc_id string, font_id string, base_font string"))
    assert [r["font_id"] for r in content.font_errors(odd).collect()] == ["q"]
    with pytest.raises(Exception, match="no name on its page"):
        content.encode_operations(ops, content.resource_names(ops).where("res_id <> 'c'")).collect()


def test_streamed_rules(spark, tmp_path):
    nodes = graph_from_literals(spark, {"a": minimal(more=[Obj(6, [Name(""), float("nan")])])}).nodes
    nodes.write.parquet(str(tmp_path / "in"))
    stream = stream_value_rules(spark.readStream.schema(nodes.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("rules").start()
    query.processAllAvailable()
    query.stop()
    assert {r["code"] for r in spark.sql("SELECT * FROM rules").collect()} == {"invalid-name", "invalid-number"}
