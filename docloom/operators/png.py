"""PNG images of 8 bits a sample, without interlacing: to RGBA pixels and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The signature, and samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(width: int, height: int, pixels: bytes) -> bytes:
    """A PNG of RGBA pixels, rows without a filter. Wrong sizes are a ValueError."""
    if width < 1 or height < 1 or len(pixels) != 4 * width * height:
        raise ValueError("pixels don't fit the size")
    rows = np.frombuffer(pixels, np.uint8).reshape(height, 4 * width)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def _chunks(data: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body, check = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError("a chunk is truncated or damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """Rows of bytes whose filters are undone; ``step``: bytes of a pixel."""
    line = width * step
    if len(raw) != height * (line + 1):
        raise ValueError("the image data have a wrong size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height + 1, line), np.uint8)  # the first row stands above the image
    for y in range(height):
        kind, row, up = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:  # sums along the row, each sample on its own
            out[y + 1] = np.cumsum(row.reshape(width, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = row + up
        elif kind in (3, 4):
            now, above, left = out[y + 1], up.tolist(), [0] * step
            upleft = [0] * step
            for x in range(0, line, step):
                for k in range(step):
                    a, b, c = left[k], above[x + k], upleft[k]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        near = (abs(p - a), abs(p - b), abs(p - c))
                        guess = a if near[0] <= near[1] and near[0] <= near[2] else b if near[1] <= near[2] else c
                    left[k] = now[x + k] = (int(row[x + k]) + guess) & 255
                    upleft[k] = b
        else:
            raise ValueError("a row has an unknown filter")
    return out[1:].reshape(height, width, step)


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA pixels of a PNG; ValueError for what is no such image."""
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG")
    head, palette, alpha, body, ended = None, None, b"", [], False
    for kind, part in _chunks(data):
        if kind == b"IHDR" and len(part) == 13:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not ended:
        raise ValueError("the header or the end is missing")
    width, height, bits, colour, _, _, interlace = head
    if bits != 8 or interlace or colour not in SAMPLES or not width or not height:
        raise ValueError("only images of 8 bits without interlacing are supported")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("the image data are damaged") from e
    px = _unfiltered(raw, height, width, SAMPLES[colour])
    full = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        if palette is None or px.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        clear = np.full(len(palette), 255, np.uint8)
        clear[: len(alpha)] = np.frombuffer(alpha[: len(palette)], np.uint8)
        out = np.concatenate([palette[px[..., 0]], clear[px]], axis=2)
    elif colour in (0, 4):
        out = np.concatenate([px[..., :1]] * 3 + [px[..., 1:] if colour == 4 else full], axis=2)
    else:
        out = px if colour == 6 else np.concatenate([px, full], axis=2)
    return width, height, np.ascontiguousarray(out).tobytes()
