import datetime as dt

from pyspark.sql import functions as F

from docloom.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def b(*x):
    return F.unhex(F.lit(bytes(x).hex()))


def test_numbers(spark):
    values = [42.0, -0.0, 1e-7, 1e21, 2.0**60, 0.1, -1.5, 8.41e21, 5e-324]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(S.pdf_number("v").alias("t")).collect()
    assert [r["t"] for r in rows][:7] == ["42", "0", "0.0000001", "1" + "0" * 21, "1152921504606847000", "0.1", "-1.5"]
    assert rows[7]["t"] == "8410000000000000000000"
    assert all(float(r["t"]) == v for r, v in zip(rows, values, strict=True))
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(S.pdf_number("v").alias("t")).collect()
    assert [r["t"] for r in bad] == [None] * 3


def test_names_and_strings(spark):
    r = one(
        spark,
        a=S.pdf_name(F.encode(F.lit("sp ace/#é"), "UTF-8")),
        c=S.pdf_name(F.encode(F.lit("€😀"), "UTF-8")),
        d=S.literal_string(b(0x28, 0x29, 0x5C, 10, 0, 255, 0x41)),
        e=S.literal_string(b()),
        f=S.hex_string(b(0, 0xAF, 0xE1)),
        g=S.hex_string(S.text_string(F.lit("AΩ"))),
        h=S.is_name(F.lit("")),
        i=S.is_name(F.lit("a\0")),
        j=S.is_name_bytes(b(1, 2)),
        k=S.is_name_bytes(b(0x10, 0x01, 0)),
        l=S.ascii_text_string(F.lit("é")),
    )
    assert r["a"] == "/sp#20ace#2F#23#C3#A9" and r["c"] == "/#E2#82#AC#F0#9F#98#80"
    assert r["d"] == "(\\(\\)\\\\\\n\\000\\377A)" and r["e"] == "()"
    assert r["f"] == "<00AFE1>" and r["g"] == "<FEFF004103A9>"
    assert (r["h"], r["i"], r["j"], r["k"], r["l"]) == (False, False, True, False, None)


def test_object_numbers(spark):
    r = one(spark, a=S.object_number(F.lit(0)), c=S.object_number(F.lit(9_999_999_999)), d=S.object_number(F.lit(1.5)), e=S.generation_number(F.lit(65_535)), f=S.generation_number(F.lit(0)))
    assert tuple(r) == (None, 9_999_999_999, None, None, 0)


def test_win_ansi(spark):
    r = one(spark, a=S.win_ansi(F.lit("A€é…")), c=S.win_ansi(F.lit("aΩ\x81")), d=S.win_ansi(F.lit("")))
    assert bytes(r["a"]["bytes"]) == "A€é…".encode("cp1252") and r["a"]["error"] is None
    assert r["c"]["bytes"] is None and "U+03A9" in r["c"]["error"]
    assert bytes(r["d"]["bytes"]) == b""


def test_dates(spark):
    good = ["D:2024", "D:202402", "D:20240229010203Z", "D:20240229010203+08'30'", "D:20240229010203-08'30", "D:00000229"]
    bad = ["2024", "D:20230229", "D:20261301", "D:20260431240000Z", "D:20260101000000+08'60'", "D:2024Zx", "D:2024\n", "D:２０２４"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "s string").select(S.valid_date(F.col("s").cast("binary")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True] * len(good) + [False] * len(bad)
    r = one(spark, a=S.date_string(F.lit(dt.datetime(2026, 7, 9, 3, 0, 0)).cast("timestamp_ntz")))
    assert r["a"] == "D:20260709030000Z"


def test_unicode_marks(spark):
    cases = {b"": True, b"\xfe\xff\x00A": True, b"\xff\xfeA\x00": False, b"\xfe\xff\x00": False, b"\xfe\xff\xd8\x00": False, b"\xfe\xff\xdc\x00\xd8\x00": False, b"\xfe\xff\xd8\x00\xdc\x00": True, b"\x80": True}
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "b binary").select(S.valid_unicode_encoding("b").alias("v")).collect()
    assert [r["v"] for r in rows] == list(cases.values())


def test_small_helpers(spark):
    r = one(
        spark,
        a=S.background(F.lit("#fff")),
        c=S.background(F.lit("#102030")),
        d=S.background(F.lit("red")),
        e=S.page_file(F.lit(7), F.lit(12)),
        f=S.page_file(F.lit(1234), F.lit(1234)),
        g=S.escape_html(F.lit('<a href="x">&</a>')),
        h=S.xref_entry(F.lit(15), F.lit(0), F.lit(True)),
        i=S.xref_entry(F.lit(10_000_000_000), F.lit(0), F.lit(True)),
        j=S.raster_size(F.lit(612.0), 96.0),
        k=S.semver(F.lit("v1.2"))["minor"],
        m=S.semver(F.lit("v1.2.3-rc1")),
        n=S.uint16(b(1, 2, 3), 1),
        o=S.joined_numbers(F.array(F.lit(1.0), F.lit(-0.0), F.lit(72.0))),
        p=S.optional_text(F.lit("Ω"), F.lit("1.1")),
        q=S.optional_text(F.lit("a"), F.lit("1.1")),
    )
    assert r["a"] == 0xFFFFFFFF and r["c"] == 0xFF302010 and r["d"] is None
    assert r["e"] == "page-007.png" and r["f"] == "page-1234.png"
    assert r["g"] == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert r["h"] == "0000000015 00000 n \n" and r["i"] is None
    assert r["j"] == 816 and r["k"] == 2 and r["m"] is None and r["n"] == 0x0203 and r["o"] == "1 0 72"
    assert r["p"] is None and r["q"] == "(a)"
    assert S.slug_of("  Ａbc — Déf! ") == "abc-de-f" and S.slug_of("!!") == "pdf"


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, a=S.is_rectangle(box(0, 0, 0, 0)), c=S.is_rectangle(box(0, 0, 1)), d=S.is_rectangle(box(0, 0, 1, "nan")), e=S.is_positive_rectangle(box(0, 0, 0, 1)), f=S.is_positive_rectangle(box(0, 0, 1, 1)))
    assert tuple(r) == (True, False, False, False, True)


def test_escapes_are_linear_and_whole(spark):
    import time

    every = bytes(range(256)) * 3
    row = spark.createDataFrame([(bytearray(every), bytearray(b""), None)], "b binary, none binary, null binary").select(
        S.literal_string("b").alias("l"), S.pdf_name("b").alias("n"), S.literal_string("none"), S.literal_string("null"), S.pdf_name("none")
    ).first()
    literal, name = S._literal_table(), S._name_table()
    assert row["l"] == "(" + "".join(literal[i] for i in every) + ")" and row["n"] == "/" + "".join(name[i] for i in every) and tuple(row)[2:] == ("()", None, "/")
    took = []
    for n in (1 << 17, 1 << 20):
        texts = spark.createDataFrame([(bytearray((b"some (text) \xe9" * n)[:n]),)], "b binary")
        start = time.time()
        assert texts.select(F.length(S.literal_string("b"))).first()[0] > n
        took.append(time.time() - start)
    assert took[1] < 20 * took[0] + 5
