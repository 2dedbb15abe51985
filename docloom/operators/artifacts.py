"""Golden files: changes as a full outer join, page differences by pixels, manifest, report and update."""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..stages import staged
from . import png

PAGES = "doc_id string, page_number int, width int, height int, pixels binary"
DIFFERENCES = "doc_id string, page_number int, kind string, differing bigint, error string, diff binary"
#: Colour of differing pixels and opacity of the grey that stands for equal ones.
MARK, FADED = (255, 0, 80, 255), 96


def changes(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Added, removed and changed files of two tables (keys, bytes) by their keys: keys, kind. Equal files give no row."""
    e = expected.select(*keys, F.col("bytes").alias("before"), F.lit(True).alias("was"))
    a = actual.select(*keys, F.col("bytes").alias("after"), F.lit(True).alias("is"))
    both = e.join(a, list(keys), "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*keys, kind.alias("kind")).where("kind is not null").orderBy(*keys)


def _compare(row) -> tuple[str | None, int | None, str | None, bytes | None]:
    if row.pixels_e is None or row.pixels_a is None:
        return ("removed" if row.pixels_a is None else "added"), None, None, None
    shapes = [(int(row.height_e), int(row.width_e)), (int(row.height_a), int(row.width_a))]
    try:
        e, a = (np.frombuffer(bytes(b), np.uint8).reshape(*shape, 4) for b, shape in zip((row.pixels_e, row.pixels_a), shapes, strict=True))
    except ValueError as x:
        return "corrupt", None, str(x)[:200], None
    if e.shape != a.shape:
        return "size", None, None, None
    other = (e != a).any(axis=2)
    if not other.any():
        return None, None, None, None
    grey = (e[..., :3].astype(np.uint16).sum(axis=2) // 3).astype(np.uint8)
    out = np.dstack([grey, grey, grey, np.full_like(grey, FADED)])
    out[other] = MARK
    return "pixels", int(other.sum()), None, out.tobytes()


def page_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, width, height, pixels as RGBA) that differ: kind, number of pixels, error, diff image.

    Pages that can't be read differ, with the error. Pages are joined, then
    compared a page at a time.
    """
    side = lambda d, s: d.select("doc_id", "page_number", *(F.col(c).alias(c + s) for c in ("width", "height", "pixels")))
    both = side(expected, "_e").join(side(actual, "_a"), ["doc_id", "page_number"], "full_outer")

    def run(batches):
        for d in batches:
            found = [(*k, *_compare(r)) for k, r in zip(zip(d["doc_id"], d["page_number"], strict=True), d.itertuples(index=False), strict=True)]
            out = pd.DataFrame(found, columns=["doc_id", "page_number", "kind", "differing", "error", "diff"])
            yield out[out["kind"].notna()].astype({"differing": "Int64"})

    return both.mapInPandas(run, DIFFERENCES)


def raster_sizes(pages: DataFrame, resolution: float = 144.0) -> DataFrame:
    """``pages`` (mediabox, rotation) with width and height in pixels; quarter turns swap them."""
    box = lambda i: F.get("mediabox", i)
    w, h = S.raster_size(box(2) - box(0), resolution), S.raster_size(box(3) - box(1), resolution)
    turned = F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(180)) == 90
    return pages.withColumns({"width": F.when(turned, h).otherwise(w), "height": F.when(turned, w).otherwise(h)})


def manifests(pages: DataFrame, resolution: int = 144, background: str = "#ffffff") -> DataFrame:
    """doc_id, manifest: JSON of the pages (page_number, width, height), indented by tabs, with a newline at the end."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = pages.join(total, "doc_id")
    item = F.format_string('\t\t{\n\t\t\t"file": "%s",\n\t\t\t"width": %d,\n\t\t\t"height": %d\n\t\t}', S.page_file(F.col("page_number"), F.col("n")), "width", "height")
    listed = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", item.alias("t")))), lambda x: x["t"]), ",\n").alias("t"))
    text = F.concat(F.lit(f'{{\n\t"resolution": {resolution},\n\t"background": "{background}",\n\t"pages": [\n'), "t", F.lit("\n\t]\n}\n"))
    return listed.select("doc_id", text.alias("manifest"))


def report_html(found: DataFrame, title: Column | str = "Differences") -> DataFrame:
    """doc_id, html: a table of changes (doc_id, path, kind) for each document."""
    cell = F.concat(F.lit("<tr><td>"), S.escape_html(F.col("path")), F.lit("</td><td>"), S.escape_html(F.col("kind")), F.lit("</td></tr>"))
    rows = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(cell)), "\n").alias("t"))
    head = title if isinstance(title, Column) else F.lit(title)
    return rows.select("doc_id", F.concat(F.lit("<!DOCTYPE html><title>"), S.escape_html(head), F.lit("</title><table>\n"), "t", F.lit("\n</table>\n")).alias("html"))


def _store(spark: SparkSession, folder: str):
    """The folder as a path of its file system, and that file system."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.Path(folder)
    path = path.getFileSystem(conf).makeQualified(path)
    fs = hadoop.FileSystem.newInstance(path.toUri(), conf)
    fs.setWriteChecksum(False)  # no files beside the folder's own
    return path, fs


def replace_folder(files: DataFrame, folder: str) -> None:
    """Put ``files`` (path, bytes) in place of a folder as a whole: written beside it, then swapped; on failure the old one stays.

    For golden folders of one document, in any store that Spark reaches; the
    rows are read one partition at a time.
    """
    spark = files.sparkSession
    place, fs = _store(spark, folder)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name = lambda kind: make(place.getParent(), f".{place.getName()}-{kind}-{uuid.uuid4().hex}")
    fresh, old = name("fresh"), name("old")
    try:
        fs.mkdirs(fresh)
        for r in files.select("path", "bytes").toLocalIterator():
            at = posixpath.normpath(r["path"])
            if at.startswith(("../", "/")) or at in ("..", "."):
                raise ValueError(f"{r['path']} leads out of the folder")
            out = fs.create(make(fresh, at), True)
            out.write(bytes(r["bytes"]))
            out.close()
        if had := fs.exists(place):
            fs.rename(place, old)
        try:
            moved = fs.rename(fresh, place)
        except Exception:
            moved = False
        if not moved:
            if had:
                fs.rename(old, place)
            raise OSError(f"{folder} could not be replaced")
        fs.delete(old, True)
    finally:
        fs.delete(fresh, True)


def remove_folder(spark: SparkSession, folder: str | None) -> None:
    if folder:
        place, fs = _store(spark, folder)
        fs.delete(place, True)


def default_mode(env: dict[str, str]) -> str:
    """``update`` or ``verify``: as PDF_ARTIFACTS says (another value is an error), else verify where CI is set to anything
    but nothing, 0 and false."""
    chosen = env.get("PDF_ARTIFACTS")
    if chosen is not None:
        if chosen not in ("update", "verify"):
            raise ValueError("PDF_ARTIFACTS must be update or verify")
        return chosen
    return "verify" if env.get("CI", "").lower() not in ("", "0", "false") else "update"


def is_page_file(path: Column) -> Column:
    return path.rlike(r"^page-[0-9]{3,}\.png\z")


def page_images(files: DataFrame) -> DataFrame:
    """The page files among ``files`` (path, bytes) as pages of the document "": doc_id, page_number, width, height, pixels.
    A file that isn't a readable PNG has null width and an error in place of its pixels."""

    def run(batches):
        for d in batches:
            rows = []
            for p, b in zip(d["path"], d["bytes"], strict=True):
                try:
                    width, height, pixels = png.decode(bytes(b))
                except ValueError:
                    width, height, pixels = 1, 1, b""  # no pixels for one: corrupt
                rows.append(("", int(p[5:-4]), width, height, pixels))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "width", "height", "pixels"])

    return files.where(is_page_file(F.col("path"))).select("path", "bytes").mapInPandas(run, PAGES)


def failure_report(expected: DataFrame, actual: DataFrame, found: DataFrame, document: bytes | None = None) -> DataFrame:
    """Files (path, bytes) of a report: expected/, actual/ and diff/ pages, the document, and an HTML overview."""
    spark = found.sparkSession
    put = lambda d, n: d.select(F.concat(F.lit(n + "/"), "path").alias("path"), "bytes")
    html = report_html(found.withColumn("doc_id", F.lit("")))
    out = put(expected, "expected").unionByName(put(actual, "actual"))
    out = out.unionByName(html.select(F.lit("report.html").alias("path"), F.encode("html", "UTF-8").alias("bytes")))
    changed = found.where(is_page_file(F.col("path"))).select("path")
    pages = [page_images(d.join(changed, "path", "left_semi")) for d in (expected, actual)]
    total = F.lit(0)  # names as the pages': at least three digits
    size = pages[1].select("page_number", "width", "height")
    diff = page_differences(*pages).where("diff is not null").join(size, "page_number")

    def encode(batches):
        for d in batches:
            yield pd.DataFrame({"path": d["path"], "bytes": [png.encode(int(w), int(h), bytes(b)) for w, h, b in zip(d["width"], d["height"], d["diff"], strict=True)]})

    diff = diff.select(S.page_file(F.col("page_number"), total).alias("path"), "width", "height", "diff").mapInPandas(encode, "path string, bytes binary")
    out = out.unionByName(put(diff, "diff"))
    if document is not None:
        out = out.unionByName(spark.createDataFrame([("actual.pdf", bytearray(document))], "path string, bytes binary"))
    return out


def check_artifact(expected: DataFrame, actual: DataFrame, folder: str, mode: str, failures: str | None = None, document: bytes | None = None) -> str:
    """``matched``, ``updated`` or ``mismatched`` of two file tables (path, bytes); updates replace ``folder``, mismatches are
    reported to ``failures`` with the ``document``; a report of an earlier run goes once nothing differs.

    ``failures`` must not lie inside ``folder`` nor hold it.
    """
    if failures:
        a, b = (posixpath.normpath(x) + "/" for x in (folder, failures))
        if a.startswith(b) or b.startswith(a):
            raise ValueError("the expected and the failure folder must not hold each other")
    found = staged(changes(expected, actual), "changes")
    if not found.limit(1).count():
        remove_folder(found.sparkSession, failures)
        return "matched"
    if mode == "update":
        replace_folder(actual, folder)
        remove_folder(found.sparkSession, failures)
        return "updated"
    if failures:
        replace_folder(failure_report(expected, actual, found, document), failures)
    return "mismatched"
