"""Hashed character features of words, computed for many words at once."""

from __future__ import annotations

from itertools import islice

import numpy as np

#: Bytes of a word at most; a longer one becomes pieces of about so many that begin so many bytes apart.
LONGEST, APART = 24, 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(word: str) -> list[str]:
    """Overlapping pieces of at most LONGEST bytes, cut between characters; no n-gram of up to 5 bytes is lost."""
    raw = word.encode("utf-8", "replace")
    out, s, e = [], 0, 0
    whole = lambda i: i if i >= len(raw) or raw[i] & 0xC0 != 0x80 else whole(i - 1)
    for at in range(0, len(raw), APART):
        s = whole(at)
        e = min(len(raw), whole(s + LONGEST))
        out.append(raw[s:e].decode("utf-8"))
        if e == len(raw):
            break
    return out


def split_long(words: list[str]) -> tuple[list[str], np.ndarray | None]:
    """The words, long ones as their pieces, and the word each is from (None where no word is long)."""
    long = [
        i for i, w in enumerate(words) if len(w) > LONGEST // 4 and (len(w) > LONGEST or not w.isascii()) and len(w.encode("utf-8", "replace")) > LONGEST
    ]
    if not long:
        return words, None
    out, source, at = [], [], 0
    for i in [*long, len(words)]:
        out += words[at:i]
        source.append(np.arange(at, i))
        if i < len(words):
            out += (made := pieces(words[i]))
            source.append(np.full(len(made), i))
        at = i + 1
    return out, np.concatenate(source)


def as_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes between boundary marks, padded with zeros, and the lengths with the marks; of words that ``split_long`` gives."""
    raw = [w.encode("utf-8", "replace").replace(b"\0", b" ") for w in words]
    if max(map(len, raw), default=0) > LONGEST:
        raise ValueError(f"a word above {LONGEST} bytes")
    raw = [b"\x02" + b + b"\x03" for b in raw]
    flat = np.array(raw, dtype=f"S{LONGEST + 2}") if raw else np.empty(0, f"S{LONGEST + 2}")
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return flat.view(np.uint8).reshape(len(raw), LONGEST + 2).astype(np.uint64), size


def ngram_slots(words: list[str], sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """A row of buckets (1 to buckets - 1; 0: none) per word: its n-grams, affixes among them by the boundary marks."""
    chars, length = as_bytes(words)
    out = []
    with np.errstate(over="ignore"):
        for g in sizes:
            n = chars.shape[1] - g + 1
            h = np.full((len(words), n), g, np.uint64)
            for j in range(g):
                h = (h ^ chars[:, j : j + n]) * MIX
                h ^= h >> np.uint64(31)
            slot = (h % np.uint64(buckets - 1)).astype(np.int32) + 1
            out.append(np.where(np.arange(n) + g <= length[:, None], slot, 0))
    return np.concatenate(out, axis=1)


def affix_slots(words: list[str], sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Buckets of the first and last bytes of each word, by length of the affix."""
    chars, length = as_bytes(words)
    rows = np.arange(len(words))[:, None]
    out = []
    with np.errstate(over="ignore"):
        for g in sizes:
            for kind, at in ((100, np.arange(1, g + 1)[None, :]), (200, length[:, None] - 1 - g + np.arange(g)[None, :])):
                h = np.full(len(words), kind + g, np.uint64)
                part = chars[rows, np.clip(at, 0, chars.shape[1] - 1)]
                for j in range(g):
                    h = (h ^ part[:, j]) * MIX
                    h ^= h >> np.uint64(31)
                slot = (h % np.uint64(buckets - 1)).astype(np.int32) + 1
                out.append(np.where(length - 2 >= g, slot, 0)[:, None])
    return np.concatenate(out, axis=1)


class WordTable:
    """Rows of a float table by word, made for new words in bulk; row 0 stands for none. Holds ``most`` words."""

    def __init__(self, make, width: int, most: int = 100_000):
        self.make, self.most = make, most
        self.table = np.zeros((1024, width), np.float32)
        self.place: dict[str, int] = {}

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        """Row numbers of the words of all texts, end to end. Valid until the next call."""
        new = set()
        for t in texts:
            new.update(t)
        if len(self.place) + len(new) > self.most:  # the words met first are the frequent ones
            self.place = dict(islice(self.place.items(), self.most // 2))
        new = list(new.difference(self.place))
        need = len(self.place) + len(new) + 1
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), self.table.shape[1]), np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        for s in range(0, len(new), 4096):
            part, at = new[s : s + 4096], len(self.place) + 1
            self.table[at : at + len(part)] = self.make(part)
            self.place.update(zip(part, range(at, at + len(part)), strict=True))
        get = self.place.__getitem__
        total = sum(map(len, texts))
        return np.fromiter((r for t in texts for r in map(get, t)), np.int32, total)
