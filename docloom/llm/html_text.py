"""Main text of web pages: an article's blocks, and what a suffix array over each host's pages finds nowhere else."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .url_filter import url_host

#: Tokens of a repeated run at least, distinct pages it must stand on.
RUN, PAGES = 6, 3
#: Pages of a host that are put into one suffix array; larger hosts are dealt into several, whose counts are added.
SHARD = 512

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text; it ends at the closing tag only.
RAW = set("script style noscript template textarea iframe noembed noframes object svg math canvas audio video xmp head title".split())
#: Elements that never hold article text; a header and a form only in some places, see ``blocks``.
DROP = set("nav aside footer button select datalist dialog menu search fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of class names and ids, as pages use them: of boilerplate, of heads, of articles, and parts that say neither.
NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar footer sidebar side aside ad ads advert adverts advertisement advertisements"
    " advertising promo promos promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup signin login register share sharing social follow related recommended recommendations trending popular comment comments"
    " commentlist disqus replies reply respond widget widgets toolbar pagination pager copyright legal disclaimer skip search form hidden".split()
)
HEADS = set("header masthead banner".split())
BODIES = set("article articlebody post entry hentry story main maincontent blogpost".split())
PLAIN = set(
    "site page global top bottom left right primary secondary inner outer wrapper wrap container holder box bar block area section list item items body content"
    " link links text panel col column row group inline small large mobile desktop sticky fixed float mini posts articles stories news topics slot unit button"
    " buttons icon icons tools detail details full single title".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only behind an equals sign
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"'])\s*[^\s>]*)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>][^\s>]*)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

KEEP, UNDECIDED = 1, 0


BOILERPLATE, HEAD, FORM, ARTICLE, NEUTRAL = "boilerplate", "head", "form", "article", "neutral"


def named(label: str) -> str:
    """What the class names and ids of an element say: a name counts only if all its parts are known, so that
    ``side-effects`` is no sidebar."""
    kind = NEUTRAL
    for token in label.split():
        parts = {x for x in re.split(r"[\W_]+", CAMEL.sub("-", token).lower()) if x and not x[0].isdigit()}
        if not parts - NAMES - HEADS - BODIES - PLAIN:
            if parts & NAMES:
                return BOILERPLATE
            if parts & HEADS:
                kind = HEAD
            elif parts & BODIES and kind == NEUTRAL:
                kind = ARTICLE
    return kind


@lru_cache(1 << 14)
def traits(name: str, attrs: str) -> str:
    """What an element holds, by its name and attributes."""
    plain = ARTICLE if name in ("article", "main") else HEAD if name == "header" else FORM if name == "form" else BOILERPLATE if name in DROP else NEUTRAL
    if not attrs.strip(" /\n\t"):
        return plain
    a: dict[str, str] = {}
    for k, x, y, z in ATTRIBUTE.findall(attrs):
        a.setdefault(k.lower(), html.unescape(x or y or z))
    role = a.get("role", "").lower()
    if plain == BOILERPLATE or role in ROLES - {"banner"} or "hidden" in a or a.get("aria-hidden") == "true":
        return BOILERPLATE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return BOILERPLATE
    if name in ("body", "html"):
        return NEUTRAL
    if name == "main" or role == "main" or plain == FORM:
        return ARTICLE if plain != FORM else FORM
    said = named(f"{a.get('class', '')} {a.get('id', '')}")
    if said == BOILERPLATE:
        return said
    if plain == HEAD or said == HEAD or role == "banner":
        return HEAD
    return ARTICLE if plain == ARTICLE or role == "article" or a.get("itemprop", "").lower() == "articlebody" else said


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, without those in known boilerplate; KEEP: in an article, else UNDECIDED.

    A head inside an article is its headline, elsewhere the page's. A form is
    dropped, but for an article in it, and unless it holds most of the text
    outside articles: then it wraps the page. Unclosed and stray tags are
    borne: an end tag closes the nearest open element of its name.
    """
    src = page or ""
    out: list[tuple[str, int, int]] = []  # text, KEEP or UNDECIDED, number of the form around it
    stack: list[tuple[str, bool, bool, int]] = []  # element, in boilerplate, in an article, form
    text: list[str] = []
    dropped = body = False
    form = forms = 0
    at, n = 0, len(src)

    def flush() -> None:
        if text:
            if not dropped:
                s = SPACE.sub(" ", html.unescape("".join(text))).strip()
                if s:
                    out.append((s, KEEP if body else UNDECIDED, 0 if body else form))
            text.clear()

    def cut(i: int) -> tuple[bool, bool, int]:
        del stack[i:]
        return stack[-1][1:] if stack else (False, False, 0)

    while at < n:
        m = TOKEN.search(src, at)
        if not m:
            text.append(src[at:])
            break
        if m.start() > at:
            text.append(src[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text.append(html.escape(m[1], quote=False))
            continue
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if m[2]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCK:
                flush()
            if i is not None:
                if any(x[0] in BLOCK for x in stack[i:]):
                    flush()
                dropped, body, form = cut(i)
            continue
        if name in RAW and not m[4].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(src, at)
            at = end.end() if end else n
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            if name in ("li", "p", "dt", "dd", "tr", "td", "th", "option"):  # the end tag may be left out
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        dropped, body, form = cut(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
        if name in VOID:
            continue
        kind = traits(name, m[4])
        if m[4].endswith("/") and name not in BLOCK:
            continue
        dropped = dropped or kind == BOILERPLATE or (kind in (HEAD, FORM) and not (kind == HEAD and body) and (kind == HEAD or body))
        body = body or (kind == ARTICLE and not dropped)
        if kind == FORM and not form and not dropped:
            forms += 1
            form = forms
        stack.append((name, dropped, body, form))
    flush()
    if not forms:
        return [(s, k) for s, k, _ in out]
    size = Counter()
    for s, k, f in out:
        if k == UNDECIDED:
            size[f] += len(s)
    wraps = {f for f, c in size.items() if 2 * c > sum(size.values())}
    return [(s, k) for s, k, f in out if not f or f in wraps]


def suffix_order(tokens: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``upto`` (or more) tokens, and the class of each, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < upto:
        after = np.r_[rank[step:], np.full(min(step, len(rank)), -1)][: len(rank)] + 1
        pair = rank * (len(rank) + 2) + after
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable"), rank


def run_classes(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of ``run`` tokens begin in the streams laid end to end with a separator after each, the class of equal
    runs of each, on how many streams the class stands, and where the streams end.

    The separators equal nothing. Neighbours in the suffix array that share
    ``run`` tokens or more are one class. A longer repeated substring is covered
    by its runs, each of which stands on as many streams at least.
    """
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in s], np.int64) for s in streams]
    apart = len(vocab) + np.arange(len(streams))
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    tokens = np.concatenate([np.r_[s, a] for s, a in zip(ids, apart, strict=True)])
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in ids])
    order, _ = suffix_order(tokens, run)
    common = common_prefix(tokens, order, run)
    grouped = np.cumsum(np.r_[0, common < run])
    by = np.lexsort((owner[order], grouped))
    order, who = order[by], owner[order][by]
    new = np.r_[True, (grouped[1:] != grouped[:-1]) | (who[1:] != who[:-1])]
    distinct = np.bincount(grouped, weights=new)
    ends = np.cumsum([len(s) + 1 for s in ids])
    inside = order + run < ends[who]  # without a separator
    return order[inside], grouped[inside], distinct[grouped][inside].astype(np.int64), ends


def common_prefix(tokens: np.ndarray, order: np.ndarray, upto: int) -> np.ndarray:
    """Number of first tokens, ``upto`` at most, that each suffix shares with the next one in ``order``."""
    padded = np.concatenate([tokens, np.full(upto, -1)])
    out, same = np.zeros(len(order) - 1, np.int64), np.ones(len(order) - 1, bool)
    for i in range(upto):
        x = padded[order + i]
        same &= (x[1:] == x[:-1]) & (x[1:] >= 0)
        out += same
    return out


def covered(starts: np.ndarray, ends: np.ndarray, run: int) -> list[np.ndarray]:
    """Per token of each stream whether a run that begins at one of ``starts`` holds it."""
    total = int(ends[-1]) if len(ends) else 0
    mark = np.zeros(total + run + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + run, -1)
    held = np.cumsum(mark)[:total] > 0
    return [held[a : b - 1] for a, b in zip(np.r_[0, ends[:-1]].astype(np.int64), ends, strict=True)]


def repeated(streams: list[list[str]], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """Per token of each page's stream whether a run of ``run`` tokens around it stands on so many distinct pages."""
    starts, _, count, ends = run_classes(streams, run)
    return covered(starts[count >= pages], ends, run)


def block_runs(pages: list[list[str]], run: int):
    """The tokens of pages end to end and, as ``run_classes`` gives them, the runs that lie in one block: what stands around
    a repeated block is no part of it."""
    streams = [[w for b in p for w in [*b.split(" "), "\0"]] for p in pages]
    starts, kind, count, ends = run_classes(streams, run)
    flat = [w for s in streams for w in [*s, "\0"]]
    cuts = np.cumsum([0, *(w == "\0" for w in flat)])
    inside = cuts[starts + run] == cuts[starts]
    return flat, starts[inside], kind[inside], count[inside], ends


def _name(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _run_name(tokens: list[str]) -> int:
    return _name("\1" + "\n".join(tokens))


def counted_runs(pages: list[list[str]], run: int = RUN) -> dict[int, int]:
    """64-bit names of the runs, and of the blocks shorter than a run, of distinct pages: on how many of them each stands."""
    flat, starts, kind, count, _ = block_runs(pages, run)
    _, first = np.unique(kind, return_index=True)
    out = {_run_name(flat[s : s + run]): n for s, n in zip(starts[first].tolist(), count[first].tolist(), strict=True)}
    short = Counter(b for p in pages for b in set(p) if b.count(" ") + 1 < run)
    return out | {_name(b): n for b, n in short.items()}


def unique_text(pages: list[list[str]], known: set[int], run: int = RUN) -> list[list[str]]:
    """Of each page's blocks the tokens that no run named in ``known`` holds; nothing of the short blocks named there."""
    flat, starts, kind, _, ends = block_runs(pages, run)
    _, first, which = np.unique(kind, return_index=True, return_inverse=True)
    use = np.array([_run_name(flat[s : s + run]) in known for s in starts[first].tolist()], bool)
    out = []
    for p, mark in zip(pages, covered(starts[use[which]], ends, run), strict=True):
        at, kept = 0, []
        for b in p:
            words = b.split(" ")
            left = [w for w, m in zip(words, mark[at : at + len(words)], strict=True) if not m]
            kept.append(" ".join(left) if len(words) >= run or _name(b) not in known else "")
            at += len(words) + 1
        out.append(kept)
    return out


def extract_text(pages: DataFrame, run: int = RUN, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks in navigation, headers, footers, asides, forms, scripts and elements
    named as menus, adverts, notices, comments and the like are no text; blocks
    inside an article or main element (or one so named) are. All other blocks
    are compared with those of the host's other pages: runs that stand on at
    least ``least`` pages with different blocks are removed, and so are blocks
    shorter than a run that stand on as many; the rest of a block stays. Suffix
    arrays over about ``shard`` pages each find the runs and count their pages;
    the counts of all arrays of a host are added before a run is judged.

    Null and empty html give an empty text, null urls count as one host;
    repeated rows give repeated rows; pages are read whole, however long, and
    parsed once; other columns are ignored; no rows give no rows.
    """
    rows = small_batches(pages).select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = f"page_id {kinds['page_id']}, url {kinds['url']}"

    def parse(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [blocks(h) for h in part.column("html").to_pylist()]
                is_open = [any(k == UNDECIDED for _, k in f) for f in found]
                digest = lambda f: hashlib.sha256("\n".join(f"{k}{b}" for b, k in f).encode("utf-8", "surrogatepass")).digest()
                yield pa.record_batch(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array([None if o else "\n\n".join(b for b, _ in f) for f, o in zip(found, is_open, strict=True)], pa.string()),
                        pa.array([digest(f) if o else None for f, o in zip(found, is_open, strict=True)], pa.binary()),
                        pa.array([[b for b, _ in f] if o else None for f, o in zip(found, is_open, strict=True)], pa.list_(pa.string())),
                        pa.array([[k == KEEP for _, k in f] if o else None for f, o in zip(found, is_open, strict=True)], pa.list_(pa.bool_())),
                    ],
                    ["page_id", "url", "text", "content", "blocks", "kept"],
                )

    def asked(group: pd.DataFrame) -> list[list[str]]:
        return [[b for b, k in zip(bs, ks, strict=True) if not k] for bs, ks in zip(group["blocks"], group["kept"], strict=True)]

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = counted_runs(asked(group), run)
        names = np.fromiter(found.keys(), np.int64, len(found))
        return pd.DataFrame({"host": key[0], "shard": key[1], "name": names, "pages": np.fromiter(found.values(), np.int64, len(found))})

    def unique(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        left = unique_text(asked(group), set(known["name"].tolist()), run)
        texts = []
        for bs, ks, rest in zip(group["blocks"], group["kept"], left, strict=True):
            todo = iter(rest)
            texts.append("\n\n".join(b for b in (b if k else next(todo) for b, k in zip(bs, ks, strict=True)) if b))
        return pd.DataFrame({"host": group["host"], "content": group["content"], "text": texts})

    parsed = staged(rows.mapInArrow(parse, f"{head}, text string, content binary, blocks array<string>, kept array<boolean>"), "parsed")
    done = parsed.where("content is null").select("page_id", "url", "text")
    open_pages = parsed.where("content is not null").withColumn("host", url_host(F.col("url")))
    if not open_pages.limit(1).count():
        return done.withColumn("n_chars", F.length("text").cast("long"))
    # pages with equal blocks are one; the number of such pages of each host is known without their text
    single = open_pages.groupBy("host", "content").agg(F.first("blocks").alias("blocks"), F.first("kept").alias("kept"))
    sizes = open_pages.groupBy("host").agg(F.ceil(F.count_distinct("content") / F.lit(shard)).alias("shards"))
    dealt = single.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("content"), "shards"))
    counts = dealt.groupBy("host", "shard").applyInPandas(count, "host string, shard long, name long, pages long")
    many = counts.groupBy("host", "name").agg(F.sum("pages").alias("all")).where(F.col("all") >= least).select("host", "name")
    known = counts.select("host", "shard", "name").join(many, ["host", "name"], "left_semi")
    texts = dealt.groupBy("host", "shard").cogroup(known.groupBy("host", "shard")).applyInPandas(unique, "host string, content binary, text string")
    rest = open_pages.drop("blocks", "kept", "text").join(texts, ["host", "content"]).select("page_id", "url", "text")
    return done.unionByName(rest).withColumn("n_chars", F.length("text").cast("long"))
