"""Drawing operations: checks, font state, resource names and encoding as window and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Operations with the number of their arguments and their operator: fixed values.
TEXT_OPS = {
    "font": (1, "Tf"), "moveText": (2, "Td"), "setTextMatrix": (6, "Tm"), "leading": (1, "TL"), "nextLine": (0, "T*"), "show": (0, "Tj"),
    "characterSpacing": (1, "Tc"), "wordSpacing": (1, "Tw"), "horizontalScale": (1, "Tz"), "rise": (1, "Ts"),
}
GRAPHICS_OPS = {
    "concatMatrix": (6, "cm"), "lineWidth": (1, "w"), "rgbFill": (3, "rg"), "rgbStroke": (3, "RG"), "moveTo": (2, "m"), "lineTo": (2, "l"),
    "rectangle": (4, "re"), "closePath": (0, "h"), "stroke": (0, "S"), "fill": (0, "f"), "fillAndStroke": (0, "B"), "drawImage": (4, "Do"),
}
OPS = TEXT_OPS | GRAPHICS_OPS
CONTENT_OPS = (
    "doc_id string, page_id bigint, frag_idx int, frag_kind string, op_idx int, op string, args array<double>, res_id string, text string, bytes binary"
)
PAGE = ("doc_id", "page_id")
ORDER = ("frag_idx", "op_idx")


def current_fonts(ops: DataFrame, fonts: DataFrame) -> DataFrame:
    """``ops`` with the font in force at each operation of a text fragment: font_now, base_font."""
    upto = Window.partitionBy(*PAGE, "frag_idx").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, 0)
    ops = ops.withColumn("font_now", F.last(F.when(F.col("op") == "font", F.col("res_id")), ignorenulls=True).over(upto))
    return ops.join(fonts.select("doc_id", F.col("font_id").alias("font_now"), "base_font"), ["doc_id", "font_now"], "left")


def operation_errors(ops: DataFrame, fonts: DataFrame, images: DataFrame) -> DataFrame:
    """Operations that the builder would refuse: the key columns, op and error."""
    ops = current_fonts(ops, fonts)
    known = images.select("doc_id", F.col("image_id").alias("res_id"), F.lit(True).alias("is_image"))
    ops = ops.join(known, ["doc_id", "res_id"], "left")
    op, a = F.col("op"), lambda i: F.get("args", i)
    arity = F.create_map(*[F.lit(x) for k, (n, _) in OPS.items() for x in (k, n)])
    text, drawn = op.isin(*TEXT_OPS), op.isin(*GRAPHICS_OPS)
    symbolic = F.col("base_font").isin("Symbol", "ZapfDingbats")
    error = (
        F.when(~(text | drawn), "unknown operation")
        .when((text & (F.col("frag_kind") != "text")) | (drawn & (F.col("frag_kind") != "graphics")), "operation of the other kind of fragment")
        .when(F.size(F.coalesce("args", F.array().cast("array<double>"))) != F.try_element_at(arity, op), "wrong number of arguments")
        .when(F.exists("args", lambda x: ~S.is_finite(x)), "an argument is not finite")
        .when((op == "font") & F.col("base_font").isNull(), "unknown font")
        .when((op == "font") & ~S.is_positive(a(0)), "a font size must be positive")
        .when((op == "show") & F.col("font_now").isNull(), "text needs a font first")
        .when((op == "show") & F.col("bytes").isNull() & symbolic, "symbolic fonts show bytes")
        .when((op == "show") & F.col("bytes").isNull(), S.win_ansi("text")["error"])
        .when((op == "lineWidth") & (a(0) < 0), "a line width must not be negative")
        .when(op.isin("rgbFill", "rgbStroke") & ~S.is_unit_rgb(a(0), a(1), a(2)), "a colour lies from 0 to 1")
        .when((op == "drawImage") & F.col("is_image").isNull(), "unknown image")
        .when((op == "drawImage") & ~(S.is_positive(a(2)) & S.is_positive(a(3))), "an image needs a positive size")
    )
    return ops.select(*PAGE, *ORDER, "op", error.alias("error")).where("error is not null")


def font_errors(fonts: DataFrame) -> DataFrame:
    """Fonts (doc_id, font_id, base_font) that aren't standard fonts: doc_id, font_id, error."""
    bad = fonts.where(~S.is_standard_font("base_font"))
    return bad.select("doc_id", "font_id", F.concat(F.lit("not a standard font: "), F.coalesce("base_font", F.lit("null"))).alias("error"))


def resource_names(ops: DataFrame) -> DataFrame:
    """Names of fonts and images on each page by first use: doc_id, page_id, kind, res_id, first (struct of the place), name."""
    used = ops.where("op in ('font', 'drawImage')").withColumn("kind", F.when(F.col("op") == "font", "font").otherwise("image"))
    first = used.groupBy(*PAGE, "kind", "res_id").agg(F.min(F.struct(*ORDER)).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "kind").orderBy("first")) - 1
    return first.withColumn("name", F.concat(F.when(F.col("kind") == "font", "F").otherwise("Im"), nth.cast("string")))


def encode_operations(ops: DataFrame, names: DataFrame, number=S.integer_text) -> DataFrame:
    """``ops`` with the line of each operation. ``number`` writes a number; ``scalars.pdf_number`` writes any, in Python.

    A font or image without a name among ``names`` is an error."""
    kind = F.when(F.col("op") == "font", "font").when(F.col("op") == "drawImage", "image")
    ops = ops.withColumn("kind", kind).join(names.select(*PAGE, "kind", "res_id", "name"), [*PAGE, "kind", "res_id"], "left")
    unnamed = F.raise_error(F.concat(F.lit("no name on its page for "), F.coalesce("res_id", F.lit("null"))))
    ops = ops.withColumn("name", F.when(F.col("kind").isNull() | F.col("name").isNotNull(), F.col("name")).otherwise(unnamed))
    operator = F.create_map(*[F.lit(x) for k, (_, s) in OPS.items() for x in (k, s)])
    if number is not S.integer_text:
        for i in range(6):
            ops = ops.withColumn(f"__{i}", number(F.get("args", i)))
        n = lambda i: F.col(f"__{i}")
    else:
        n = lambda i: number(F.get("args", i))
    shown = F.coalesce("bytes", S.win_ansi("text")["bytes"])
    line = F.when(F.col("op") == "font", F.concat(F.lit("/"), "name", F.lit(" "), n(0), F.lit(" Tf")))
    line = line.when(F.col("op") == "show", F.concat(S.literal_string(shown), F.lit(" Tj")))
    line = line.when(
        F.col("op") == "drawImage",
        F.concat(F.lit("q\n"), n(2), F.lit(" 0 0 "), n(3), F.lit(" "), n(0), F.lit(" "), n(1), F.lit(" cm\n/"), "name", F.lit(" Do\nQ")),
    )
    for count in (0, 1, 2, 3, 4, 6):
        names_of = [k for k, (c, _) in OPS.items() if c == count and k not in ("font", "show", "drawImage")]
        parts = [x for i in range(count) for x in (n(i), F.lit(" "))]
        line = line.when(F.col("op").isin(*names_of), F.concat(*parts, F.try_element_at(operator, F.col("op"))))
    return ops.withColumn("line", F.concat(line, F.lit("\n")))


def page_contents(ops: DataFrame, number=S.integer_text) -> DataFrame:
    """doc_id, page_id, content: fragments in order, text between BT and ET, graphics between q and Q."""
    lines = encode_operations(ops, resource_names(ops), number)
    joined = lines.groupBy(*PAGE, "frag_idx", "frag_kind").agg(F.array_sort(F.collect_list(F.struct("op_idx", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    text = F.col("frag_kind") == "text"
    framed = F.concat(F.when(text, "BT\n").otherwise("q\n"), body, F.when(text, "ET\n").otherwise("Q\n"))
    pages = joined.select(*PAGE, "frag_idx", framed.alias("part")).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("frag_idx", "part"))).alias("parts"))
    return pages.select(*PAGE, F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("content"))


def procedure_sets(pages: DataFrame, names: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page_id, proc_set of pages in versions up to 1.3: PDF, Text, then ImageB and ImageC in the order of first use.

    ``pages`` (doc_id, page_id, version), ``images`` (doc_id, image_id, color_space).
    """
    shown = names.where("kind = 'image'").join(images.select("doc_id", F.col("image_id").alias("res_id"), "color_space"), ["doc_id", "res_id"])
    shown = shown.withColumn("proc", F.when(F.col("color_space") == "DeviceGray", "ImageB").otherwise("ImageC"))
    shown = shown.groupBy(*PAGE, "proc").agg(F.min("first").alias("first"))
    shown = shown.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "proc"))), lambda x: x["proc"]).alias("shown"))
    fonts = names.where("kind = 'font'").select(*PAGE).distinct().withColumn("text", F.array(F.lit("Text")))
    none = F.array().cast("array<string>")
    early = pages.where(F.col("version").isin("1.0", "1.1", "1.2", "1.3")).select(*PAGE)
    rows = early.join(fonts, [*PAGE], "left").join(shown, [*PAGE], "left")
    return rows.select(*PAGE, F.concat(F.array(F.lit("PDF")), F.coalesce("text", none), F.coalesce("shown", none)).alias("proc_set"))


def font_dictionary(base_font: Column) -> Column:
    """Entries of a font's dictionary as an array of (key, name); symbolic fonts have no Encoding."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("name"))
    plain = F.array(entry("Type", F.lit("Font")), entry("Subtype", F.lit("Type1")), entry("BaseFont", base_font))
    return F.when(base_font.isin("Symbol", "ZapfDingbats"), plain).otherwise(
        F.concat(plain, F.array(entry("Encoding", F.lit("WinAnsiEncoding"))))
    )
