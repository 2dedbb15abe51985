"""Inspection of baseline JPEG images: framing into segments, then rules over the segments in file order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SEGMENTS = "offset int, marker int, length int"
RESULT = "ok boolean, error string, width int, height int, color_space string"
BARE = {0x01, 0xD8, *range(0xD0, 0xD8)}
END, SCAN, FRAME, QUANT, HUFF = 0xD9, 0xDA, 0xC0, 0xDB, 0xC4
OTHER_FRAMES = set(range(0xC1, 0xD0)) - {0xC4, 0xC8, 0xCC}


class BadImage(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise BadImage(message)


@dataclass
class Segment:
    """A marker with its payload; a scan also has the number of entropy-coded bytes after it."""

    offset: int
    marker: int
    payload: bytes
    entropy: int = 0


def _entropy(data: bytes, at: int) -> tuple[int, int]:
    """Number of coded bytes from ``at`` on, and where the next marker that ends them starts."""
    coded, n = 0, len(data)
    while True:
        stop = data.find(b"\xff", at)
        if stop < 0:
            return coded + n - at, n
        coded += stop - at
        code = stop
        while code < n and data[code] == 0xFF:
            code += 1
        if code >= n:
            return coded, n
        if data[code] == 0x00:
            coded += 1
        elif data[code] not in BARE:
            return coded, stop
        at = code + 1


def segments(data: bytes) -> Iterator[Segment]:
    """Segments up to and with the end marker. Framing errors are raised where they are met."""
    need(data[:2] == b"\xff\xd8" and len(data) >= 4, "an image starts with an SOI marker")
    at, n = 2, len(data)
    while at < n:
        need(data[at] == 0xFF, "bytes stand outside a marker segment")
        begin = at
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            return
        marker = data[at]
        at += 1
        if marker == END:
            yield Segment(begin, END, b"")
            return
        if marker in BARE:
            continue
        need(at + 2 <= n, "a segment has no length")
        size = int.from_bytes(data[at : at + 2], "big")
        need(size >= 2 and at + size <= n, "a segment has a wrong length")
        found = Segment(begin, marker, data[at + 2 : at + size])
        at += size
        if marker == SCAN:
            found.entropy, at = _entropy(data, at)
        yield found


@dataclass
class State:
    """What the segments so far have defined: order matters, a table after the scan is too late."""

    quant: set[int] = field(default_factory=set)
    huff: tuple[set[int], set[int]] = field(default_factory=lambda: (set(), set()))
    frame: dict[int, int] | None = None
    width: int = 0
    height: int = 0
    seen: set[int] = field(default_factory=set)
    entropy: int = 0


def quantization(s: State, p: bytes) -> None:
    while p:
        wide, name = p[0] >> 4, p[0] & 15
        need(wide <= 1 and name <= 3, "a quantization table is not valid")
        size = 64 * (wide + 1)
        cells = p[1 : 1 + size]
        values = [int.from_bytes(cells[i : i + 1 + wide], "big") for i in range(0, len(cells), 1 + wide)]
        need(all(values), "quantization coefficients must be above zero")
        need(len(cells) == size, "a quantization table is truncated")
        s.quant.add(name)
        p = p[1 + size :]


def huffman(s: State, p: bytes) -> None:
    while p:
        need(len(p) >= 17, "a Huffman table is truncated")
        kind, name = p[0] >> 4, p[0] & 15
        need(kind <= 1 and name <= 3, "a Huffman table is not valid")
        room = 1
        for count in p[1:17]:
            room = 2 * room - count
            need(room >= 0, "a Huffman table has more codes than bits allow")
        total = sum(p[1:17])
        need(0 < total <= 256, "a Huffman table has a wrong number of symbols")
        symbols = p[17 : 17 + total]
        need(len(symbols) == total, "a Huffman table is truncated")
        if kind == 0:
            need(max(symbols) <= 11, "a DC table holds a symbol that can't be")
        else:
            fine = {run << 4 | bits for run in range(16) for bits in range(1, 11)} | {0x00, 0xF0}
            need(set(symbols) <= fine, "an AC table holds a symbol that can't be")
        s.huff[kind].add(name)
        p = p[17 + total :]


def frame(s: State, p: bytes) -> None:
    need(len(p) >= 6, "the frame header is truncated")
    bits, count = p[0], p[5]
    s.height, s.width = int.from_bytes(p[1:3], "big"), int.from_bytes(p[3:5], "big")
    need(len(p) == 6 + 3 * count and s.width > 0 and s.height > 0, "the frame header is not valid")
    need(bits == 8, "only 8 bits a sample are supported")
    need(count in (1, 3), "only one or three components are supported")
    parts = [p[6 + 3 * i : 9 + 3 * i] for i in range(count)]
    need(len({c[0] for c in parts}) == count and all(c[2] <= 3 for c in parts), "the frame components are not valid")
    need(all(1 <= x <= 4 for c in parts for x in (c[1] >> 4, c[1] & 15)), "the sampling factors are not valid")
    s.frame = {c[0]: c[2] for c in parts}


def scan(s: State, p: bytes) -> None:
    count = p[0] if p else 0
    need(count > 0 and len(p) == 4 + 2 * count and s.frame is not None, "the scan header is not valid")
    for i in range(count):
        part, tables = p[1 + 2 * i], p[2 + 2 * i]
        ok = part in s.frame and s.frame[part] in s.quant and tables >> 4 in s.huff[0] and tables & 15 in s.huff[1]
        need(ok, "the scan names a component or table that is not defined")
    need(p[1 + 2 * count :] == b"\x00\x3f\x00", "the scan is not baseline sequential")


RULES: dict[int, Callable[[State, bytes], None]] = {QUANT: quantization, HUFF: huffman, FRAME: frame, SCAN: scan}


def inspect(data: bytes) -> tuple[bool, str | None, int | None, int | None, str | None]:
    """(ok, error, width, height, color space) of one image."""
    s = State()
    try:
        for seg in segments(data):
            need(seg.marker not in OTHER_FRAMES, "only baseline images are supported")
            if seg.marker in RULES:
                RULES[seg.marker](s, seg.payload)
            s.seen.add(seg.marker)
            s.entropy += seg.entropy
        need(s.frame is not None, "there is no frame header")
        need({SCAN, END, QUANT, HUFF} <= s.seen and s.entropy > 0, "tables, scan data or the end are missing")
    except BadImage as e:
        return False, str(e), None, None, None
    return True, None, s.width, s.height, "DeviceGray" if len(s.frame) == 1 else "DeviceRGB"


def inspect_images(images: DataFrame) -> DataFrame:
    """``images`` (doc_id, image_id, bytes) with ok, error, width, height, color_space; null bytes are an error."""

    def run(batches):
        for d in batches:
            rows = [inspect(bytes(b)) if b is not None else (False, "no bytes", None, None, None) for b in d["bytes"]]
            out = pd.DataFrame(rows, columns=["ok", "error", "width", "height", "color_space"])
            out = out.astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([d[["doc_id", "image_id"]].reset_index(drop=True), out], axis=1)

    return images.select("doc_id", "image_id", "bytes").mapInPandas(run, f"doc_id string, image_id string, {RESULT}")


def register_segments(spark: SparkSession) -> None:
    """``jpeg_segments(bytes)`` as a table function for SQL; it ends where the framing breaks."""
    from pyspark.sql.functions import udtf

    class JpegSegments:
        def eval(self, data):
            try:
                for s in segments(bytes(data or b"")):
                    yield s.offset, s.marker, len(s.payload)
            except BadImage:
                return

    spark.udtf.register("jpeg_segments", udtf(JpegSegments, returnType=SEGMENTS))
