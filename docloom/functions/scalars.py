"""Scalar functions of the object syntax as column expressions. All run in the JVM but those that say otherwise."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_OBJECT = 9_999_999_999
MAX_GENERATION = 65_534
MAX_SAFE = 9_007_199_254_740_991
# Fixed values.
VERSIONS = ["1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "1.7", "2.0"]
STANDARD_FONTS = [
    "Courier", "Courier-Bold", "Courier-BoldOblique", "Courier-Oblique",
    "Helvetica", "Helvetica-Bold", "Helvetica-BoldOblique", "Helvetica-Oblique",
    "Symbol", "Times-Bold", "Times-BoldItalic", "Times-Italic", "Times-Roman", "ZapfDingbats",
]
PAGE_SIZES = {"letter": (0.0, 0.0, 612.0, 792.0), "legal": (0.0, 0.0, 612.0, 1008.0), "a4": (0.0, 0.0, 595.0, 842.0)}
# Windows-1252 beyond Latin-1: code points of the bytes 80 to 9F, without the five that stand for nothing.
WINDOWS_1252 = {ord(c): i for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "ignore"))}
# Well-formed UTF-16BE after its mark, as hex.
UTF16_HEX = r"^FEFF(?:[0-9A-CE-F][0-9A-F]{3}|D[0-7][0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*+\z"
DATE_TEXT = (
    r"^D:([0-9]{4})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:([0-9]{2}))?)?)?)?)?"
    r"(?:Z|[+-]([0-9]{2})'([0-9]{2})'?)?\z"
)


def _named(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _per_byte(b: Column, table: list[str]) -> Column:
    """Text of each byte of a binary by a table of 256, joined; empty for no bytes.

    Bytes that stand for themselves are taken in runs, so the work is linear in
    the bytes and small where few are written otherwise.
    """
    plain = "".join(f"\\x{i:02X}" for i, x in enumerate(table) if x == chr(i))
    other = F.array(*[F.lit(None).cast("string") if x == chr(i) else F.lit(x) for i, x in enumerate(table)])
    runs = F.regexp_extract_all(F.decode(b, "ISO-8859-1"), F.lit(f"(?s)[{plain}]++|."), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.coalesce(F.get(other, F.ascii(r)), r)), "")


def object_number(v: Column) -> Column:
    """The number if it is an object number, else null."""
    v = _named(v)
    return F.when((v == F.floor(v)) & v.between(1, MAX_OBJECT), v.cast("long"))


def generation_number(v: Column) -> Column:
    """The number if it is a generation, else null."""
    v = _named(v)
    return F.when((v == F.floor(v)) & v.between(0, MAX_GENERATION), v.cast("int"))


def is_name(s: Column) -> Column:
    """Not empty and without NUL. A string column holds well-formed text only."""
    s = _named(s)
    return F.coalesce((F.length(s) > 0) & ~F.contains(s, F.lit("\0")), F.lit(False))


def is_name_bytes(b: Column) -> Column:
    """Not empty and without a zero byte."""
    b = _named(b)
    return F.coalesce(F.hex(b).rlike(r"^(?:(?!00)[0-9A-F]{2})++\z"), F.lit(False))


def text_string(s: Column) -> Column:
    """Bytes of a text string: the mark FE FF, then UTF-16BE."""
    return F.concat(F.unhex(F.lit("FEFF")), F.encode(_named(s), "UTF-16BE"))


def ascii_text_string(s: Column) -> Column:
    """The bytes of an ASCII text, null for others."""
    s = _named(s)
    return F.when(~s.rlike(r"[^\x00-\x7F]"), s.cast("binary"))


def date_string(ts: Column) -> Column:
    """``D:YYYYMMDDHHmmSSZ`` of a UTC timestamp; null outside the years 0 to 9999."""
    ts = _named(ts)
    return F.when(F.year(ts).between(0, 9999), F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'"))


def optional_text(s: Column, version: Column) -> Column:
    """Serialized metadata text: an ASCII literal up to version 1.1 (null if it isn't ASCII), else UTF-16BE as hex."""
    s, version = _named(s), _named(version)
    return F.when(version.isin("1.0", "1.1"), literal_string(ascii_text_string(s))).otherwise(hex_string(text_string(s)))


@F.pandas_udf(T.StringType())
def _plain_decimal(v: pd.Series) -> pd.Series:
    """Shortest digits that read back as the same double, without an exponent. Python: Java's digits may be longer."""
    text = lambda x: format(Decimal(repr(float(x))), "f").removesuffix(".0")
    return v.map(lambda x: None if pd.isna(x) or x in (float("inf"), float("-inf")) else "0" if x == 0 else text(x))


def is_safe_integer(v: Column) -> Column:
    v = _named(v)
    return F.coalesce((v == F.rint(v)) & (F.abs(v) <= MAX_SAFE), F.lit(False))


def is_finite(v: Column) -> Column:
    v = _named(v)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def pdf_number(v: Column) -> Column:
    """Plain decimal text of a double; null if not finite. Safe integers stay in the JVM, other numbers go through Arrow."""
    v = _named(v).cast("double")
    safe = is_safe_integer(v)
    return F.when(safe, v.cast("long").cast("string")).otherwise(_plain_decimal(F.when(~safe, v)))


def integer_text(v: Column) -> Column:
    """``pdf_number`` of safe integers, null for others: without any Python in the plan."""
    v = _named(v).cast("double")
    return F.when(is_safe_integer(v), v.cast("long").cast("string"))


def _name_table() -> list[str]:
    plain = set(range(0x21, 0x7F)) - set(b"()<>[]{}/%#")
    return [chr(i) if i in plain else f"#{i:02X}" for i in range(256)]


def pdf_name(b: Column) -> Column:
    """A name from its bytes: a slash, and irregular bytes as # and two hex digits."""
    return F.concat(F.lit("/"), _per_byte(_named(b), _name_table()))


def _literal_table() -> list[str]:
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 40: "\\(", 41: "\\)", 92: "\\\\"}
    return [short.get(i) or (chr(i) if 0x20 <= i <= 0x7E else f"\\{i:03o}") for i in range(256)]


def literal_string(b: Column) -> Column:
    """A literal string: in parentheses, with escapes and octal codes."""
    return F.concat(F.lit("("), _per_byte(_named(b), _literal_table()), F.lit(")"))


def hex_string(b: Column) -> Column:
    return F.concat(F.lit("<"), F.hex(_named(b)), F.lit(">"))


def win_ansi(s: Column) -> Column:
    """Struct of the Windows-1252 bytes and, where a character has none, null bytes and an error naming the first such."""
    s = _named(s)
    known = F.create_map(*[F.lit(x) for k, v in WINDOWS_1252.items() for x in (k, f"{v:02X}")])

    def code(ch: Column) -> Column:
        point = F.ascii(ch)
        same = (point < 0x80) | point.between(0xA0, 0xFF)
        return F.struct(point.alias("point"), F.when(same, F.lpad(F.hex(point), 2, "0")).otherwise(F.try_element_at(known, point)).alias("code"))

    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), code)
    bad = F.get(F.filter(codes, lambda c: c["code"].isNull()), 0)["point"]
    text = F.array_join(F.transform(codes, lambda c: c["code"]), "")
    name = F.concat(F.lit("no Windows-1252 byte for U+"), F.lpad(F.hex(bad), F.greatest(F.length(F.hex(bad)), F.lit(4)), F.lit("0")))
    return F.struct(F.when(bad.isNull(), F.unhex(text)).alias("bytes"), F.when(bad.isNotNull(), name).alias("error"))


def valid_unicode_encoding(b: Column) -> Column:
    """Whether bytes that claim UTF-16 by a mark are well-formed UTF-16BE; other bytes always are right."""
    h = F.hex(_named(b))
    return F.when(h.startswith("FEFF"), h.rlike(UTF16_HEX)).otherwise(~h.startswith("FFFE"))


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def valid_date(b: Column) -> Column:
    """Whether bytes are a date string with a calendar date, a time of day and an offset that exist."""
    b = _named(b)
    text = F.when(F.hex(b).rlike(r"^(?:[0-7][0-9A-F])*+\z"), F.try_validate_utf8(b.cast("string")))
    part = lambda i: F.nullif(F.regexp_extract(text, DATE_TEXT, i), F.lit("")).cast("int")
    year, month, day, hour, minute, second, off_h, off_m = map(part, range(1, 9))
    inside = lambda v, low, high: F.coalesce(v.between(low, high), F.lit(True))
    ok = text.rlike(DATE_TEXT) & inside(month, 1, 12) & inside(hour, 0, 23) & inside(minute, 0, 59) & inside(second, 0, 59)
    ok = ok & inside(off_h, 0, 23) & inside(off_m, 0, 59)
    ok = ok & inside(day, F.lit(1), days_in_month(year, F.coalesce(month, F.lit(1))))
    return F.coalesce(ok, F.lit(False))


def uint16(b: Column, offset: int | Column) -> Column:
    """Big-endian 16-bit number at a 0-based offset; null beyond the end."""
    at = 2 * (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    part = F.substring(F.hex(_named(b)), at, F.lit(4))
    return F.when(F.length(part) == 4, F.conv(part, 16, 10).cast("int"))


def joined_numbers(values: Column) -> Column:
    """Numbers of an array as text with spaces between; null if one isn't a safe integer (see ``pdf_number``)."""
    values = _named(values)
    texts = F.transform(values, integer_text)
    return F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, " "))


def is_rectangle(box: Column) -> Column:
    """Four finite numbers: what the validator asks of a box."""
    box = _named(box)
    return F.coalesce((F.size(box) == 4) & F.forall(box, is_finite), F.lit(False))


def is_positive_rectangle(box: Column) -> Column:
    """Four finite numbers with a width and a height: what the builder asks of a box."""
    box = _named(box)
    return is_rectangle(box) & F.coalesce((F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1)), F.lit(False))


def is_positive(v: Column) -> Column:
    return is_finite(v) & F.coalesce(_named(v) > 0, F.lit(False))


def is_unit_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.coalesce(_named(r).between(0, 1) & _named(g).between(0, 1) & _named(b).between(0, 1), F.lit(False))


def background(s: Column) -> Column:
    """0xAABBGGRR of ``#RGB`` or ``#RRGGBB``, opaque; null for other text."""
    s = _named(s)
    wide = F.when(s.rlike(r"^#[0-9a-fA-F]{6}\z"), F.substring(s, 2, 6)).when(
        s.rlike(r"^#[0-9a-fA-F]{3}\z"), F.regexp_replace(F.substring(s, 2, 3), "(.)", "$1$1")
    )
    part = lambda i: F.substring(wide, i, 2)
    return F.conv(F.concat(F.lit("FF"), part(5), part(3), part(1)), 16, 10).cast("long")


def page_file(n: Column, pages: Column) -> Column:
    """``page-001.png``: at least three digits, more for documents of more pages."""
    n = _named(n).cast("string")
    width = F.greatest(F.lit(3), F.length(_named(pages).cast("string")), F.length(n))
    return F.concat(F.lit("page-"), F.lpad(n, width, F.lit("0")), F.lit(".png"))


def escape_html(s: Column) -> Column:
    out = _named(s)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def slug_of(s: str | None) -> str:
    """Lower-case letters and digits with single dashes between; compatibility forms are taken apart first."""
    import re
    import unicodedata

    text = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", s or "").lower())
    return re.sub(r"^-|-$", "", text)[:100] or "pdf"


@F.pandas_udf(T.StringType())
def slug(s: pd.Series) -> pd.Series:
    return s.map(slug_of)


@F.pandas_udf(T.StringType())
def safe_relative_path(s: pd.Series) -> pd.Series:
    """Path of slugs, without empty parts and parents."""
    return s.map(lambda p: "/".join(slug_of(x) for x in (p or "").replace("\\", "/").split("/") if x not in ("", "..")))


def xref_entry(field: Column, generation: Column, in_use: Column) -> Column:
    """A 20-byte cross-reference entry; null if the field has more than ten digits."""
    field, generation, in_use = map(_named, (field, generation, in_use))
    kind = F.when(in_use, F.lit("n")).otherwise(F.lit("f"))
    entry = F.format_string("%010d %05d %s \n", field.cast("long"), generation.cast("int"), kind)
    return F.when(field.between(0, MAX_OBJECT), entry)


def raster_size(points: Column, resolution: float) -> Column:
    return F.ceil(_named(points) * resolution / 72).cast("long")


def semver(s: Column) -> Column:
    """Struct (major, minor, patch, segments) of ``v1``, ``1.2`` or ``v1.2.3``; null for others, prereleases among them."""
    s = _named(s)
    pattern = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?\z"
    part = lambda i: F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    segments = 1 + part(2).isNotNull().cast("int") + part(3).isNotNull().cast("int")
    version = F.struct(part(1).alias("major"), zero(part(2)).alias("minor"), zero(part(3)).alias("patch"), segments.alias("segments"))
    return F.when(s.rlike(pattern), version)


def short_commit(s: Column) -> Column:
    """The first eight digits of a commit of forty hex digits; other text as it is."""
    s = _named(s)
    return F.when(s.rlike(r"^(?i:[0-9a-f]{40})\z"), F.substring(s, 1, 8)).otherwise(s)


def with_version_prefix(s: Column) -> Column:
    """The version with a ``v`` in front."""
    s = _named(s)
    return F.when(s.startswith("v"), s).otherwise(F.concat(F.lit("v"), s))


def is_standard_font(s: Column) -> Column:
    return F.coalesce(_named(s).isin(STANDARD_FONTS), F.lit(False))


def register(spark) -> None:
    """Make the functions that need Python known to SQL."""
    spark.udf.register("pdf_plain_decimal", _plain_decimal)
    spark.udf.register("pdf_slug", slug)
    spark.udf.register("pdf_safe_path", safe_relative_path)
