"""Language of words and texts by a linear-chain conditional random field, trained in numpy."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, small_batches
from .word_features import WordTable, affix_slots, ngram_slots, split_long

#: Buckets of the features; labelled rows that are learned from at most, each with its whole text.
BUCKETS = 1 << 15
MOST_ROWS = 1500
LETTER = regex.compile(r"\p{L}")
LEVELS = 4


class Field:
    """Feature weights per language, transitions, and a lexicon of words that lean to one language."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs = langs
        self.weights = np.zeros((BUCKETS + LEVELS * n, n), np.float32)  # behind the buckets, the lexicon's levels of each language
        self.trans = np.where(np.eye(n, dtype=bool), 2.0, 0.0).astype(np.float32)
        self.start = np.zeros(n, np.float32)
        self.lexicon: dict[str, int] = {}

    def slots(self, words: list[str]) -> np.ndarray:
        """Features of each word: n-grams, affixes, and its entry in the lexicon."""
        bare = [w.strip(".,;:!?\"'()[]{}<>*#$%&-_|") or w for w in words]
        own = np.fromiter((self.lexicon.get(w, -1) for w in bare), np.int32, len(bare))
        own = np.where(own < 0, 0, BUCKETS + own)[:, None].astype(np.int32)
        return np.concatenate([ngram_slots(bare, (2, 3), BUCKETS), affix_slots(bare, (1, 2, 3, 4), BUCKETS), own], axis=1)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each language for each word; words without a letter get none and are left out of the chains."""
        slots = self.slots(words)
        n = (slots > 0).sum(1)
        full = slots[slots > 0]
        if not len(full):
            return np.zeros((len(words), len(self.langs)), np.float32)
        sums = np.add.reduceat(self.weights[full], np.minimum(np.cumsum(n) - n, len(full) - 1))
        return np.where(n[:, None] > 0, sums, 0).astype(np.float32)

    def learn_lexicon(self, words: list[list[str]], labels: list[np.ndarray]) -> None:
        seen: dict[str, Counter] = {}
        for row, y in zip(words, labels, strict=True):
            for w, lang in zip(row, y.tolist(), strict=True):
                seen.setdefault(w.strip(".,;:!?\"'()[]{}<>*#$%&-_|") or w, Counter())[lang] += 1
        for w, c in sorted(seen.items()):
            n, (lang, top) = sum(c.values()), min(c.items(), key=lambda x: (-x[1], x[0]))
            if n >= 3 and top / n > 0.5:
                level = min(LEVELS - 1, int(LEVELS * 2 * (top / n - 0.5)))
                self.lexicon[w] = lang * LEVELS + level


def marginals(emit: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward over chains laid end to end: probability of each label at each place.

    Works on all chains at once, the longest first, so that a step touches only
    those that still go on. With ``pairs`` also the expected transitions and
    the probabilities at the starts.
    """
    k = emit.shape[1]
    total = int(sizes.sum())
    out = np.zeros((total, k), np.float32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    moves = np.zeros((k, k))
    if not len(order):
        return (out, moves, np.zeros(k)) if pairs else out
    begin = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float32)
    T = np.exp(trans - trans.max()).astype(np.float32)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # chains with more than t places
    fwd = np.empty((total, k), np.float32)
    a = e[begin] * np.exp(start - start.max()).astype(np.float32)
    a /= a.sum(1, keepdims=True)
    fwd[begin] = a
    for t in range(1, int(size[0])):
        n = alive[t]
        at = begin[:n] + t
        a = (a[:n] @ T) * e[at]
        a /= a.sum(1, keepdims=True)
        fwd[at] = a
    b = np.ones((len(order), k), np.float32)
    for t in range(int(size[0]) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        p = fwd[at] * b[:n]
        p /= p.sum(1, keepdims=True)
        out[at] = p
        if t:
            eb = e[at] * b[:n]
            if pairs:
                joint = fwd[at - 1][:, :, None] * T[None] * eb[:, None, :]
                moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            eb = eb @ T.T
            b[:n] = eb / eb.sum(1, keepdims=True)
    return (out, moves, out[begin].sum(0, dtype=np.float64)) if pairs else out


def letter_words(text: str | None) -> tuple[list[str], np.ndarray | None]:
    """Words, long ones as pieces, and the word each is from."""
    return split_long((text or "").lower().split())


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 6, batch: int = 64) -> Field | None:
    """The field fitted to labelled texts, or None without any.

    A text's words carry its language. Chains of pieces from several texts,
    with the language changing between them, teach the transitions.
    """
    if not langs:
        return None
    field = Field(sorted(set(langs)))
    number = {x: i for i, x in enumerate(field.langs)}
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in letter_words(text)[0] if LETTER.search(w)]
        if not words:
            continue
        rows.append(words)
        labels.append(np.full(len(words), number[lang]))
    if not rows:
        return None
    field.learn_lexicon(rows, labels)
    chains, tags = [], []
    pieces = [(i, s) for i, r in enumerate(rows) for s in range(0, len(r), 12)]
    order = rng.permutation(len(pieces))
    at = 0
    while at < len(order):
        n = int(rng.integers(1, 6))
        mine = [pieces[j] for j in order[at : at + n]]
        at += n
        chains.append([w for i, s in mine for w in rows[i][s : s + 12]])
        tags.append(np.concatenate([labels[i][s : s + 12] for i, s in mine]))
    vocab = sorted({w for c in chains for w in c})
    place = {w: i for i, w in enumerate(vocab)}
    slots = np.concatenate([field.slots(vocab[s : s + 4096]) for s in range(0, len(vocab), 4096)])
    k = len(field.langs)
    params = {"weights": field.weights, "trans": field.trans, "start": field.start}
    square = {n: np.full(p.shape, 1e-8, np.float32) for n, p in params.items()}
    for epoch in range(epochs):
        todo = rng.permutation(len(chains))
        for s in range(0, len(todo), batch):
            use = todo[s : s + batch]
            ids = np.array([place[w] for i in use for w in chains[i]])
            y = np.concatenate([tags[i] for i in use])
            sizes = np.array([len(tags[i]) for i in use])
            emit = field.weights[slots[ids]].sum(1)
            p, moves, first = marginals(emit, sizes, field.trans, field.start, pairs=True)
            p[np.arange(len(y)), y] -= 1
            begin = np.cumsum(sizes) - sizes
            linked = np.setdiff1d(np.arange(1, len(y)), begin)
            np.subtract.at(moves, (y[linked - 1], y[linked]), 1)
            first -= np.bincount(y[begin], minlength=k)
            words, back = np.unique(ids, return_inverse=True)
            per = np.stack([np.bincount(back, p[:, c], len(words)) for c in range(k)], 1)
            i, j = np.nonzero(slots[words])
            flat = slots[words][i, j]
            grad = {
                "weights": np.stack([np.bincount(flat, per[i, c], len(field.weights)) for c in range(k)], 1) / len(y) + 1e-7 * field.weights,
                "trans": moves / len(y),
                "start": first / len(use),
            }
            for n, g in grad.items():
                square[n] += (g * g).astype(np.float32)
                params[n] -= (0.15 * g / np.sqrt(square[n])).astype(np.float32)
            field.weights[0] = 0
    return field


def fit_languages(docs: DataFrame, most: int = MOST_ROWS, seed: int = 7) -> Field | None:
    """Learn from text and lang of rows with a non-null lang whose crc32(doc_id as text) mod 4 is not 2: of each
    language about as many, ``most`` in all (and so no more languages), those with the smallest hash of their id. Of rows
    that share doc_id and lang the smallest text is taken, whatever their order; texts are learned from whole."""
    keep = F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(keep)
    spark = docs.sparkSession
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    if not counts:
        return None
    share = spark.createDataFrame([(r["lang"], r["count"]) for r in counts], "lang string, n long")
    # the most * n / languages rows with the smallest even number of each language, chosen before any text is read
    even = F.shiftright(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / (1 << 52)
    lots = (
        rows.drop("text")
        .join(F.broadcast(share), "lang")  # at most ``most`` rows
        .select("doc_id", "lang", ((even + 1) / 2 * F.col("n")).alias("lot"))
        .orderBy("lot", "doc_id")
        .limit(most)
    )
    chosen = spark.createDataFrame(lots.select("doc_id", "lang").collect(), "doc_id long, lang string").distinct()
    got = rows.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most ``most`` rows are broadcast
    got = got.groupBy("doc_id", "lang").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def fit(rows):
        made = train([r[2] for r in rows], [r[1] for r in rows], seed)
        return made and made.__dict__

    made = fit_in_task(got.select("doc_id", "lang", "text"), fit)
    if not made:
        return None
    field = Field(made["langs"])
    field.__dict__.update(made)
    return field


def label_languages(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, n_words, n_switches.

    Every word with a letter gets label probabilities by forward-backward over
    the whole text; a word above 24 bytes is a chain of overlapping pieces, and
    one word in n_words. The text's language has the highest mean probability, which
    is the score; n_switches counts neighbours with different best labels. Null
    texts, texts without a letter, and all texts without a field are ``und``
    with score 0. Repeated rows are labelled alike; other columns are ignored;
    no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", "lang_pred", "score", "n_words", "n_switches"]

    def run(batches):
        field = shared.value
        k = len(field.langs) if field else 1

        def make(words):  # scores, and whether the word has a letter
            has = np.array([bool(LETTER.search(w)) for w in words], np.float32)[:, None]
            return np.concatenate([field.emissions(words), has], axis=1) if field else np.zeros((len(words), k + 1), np.float32)

        table = WordTable(make, k + 1)
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                words, source = zip(*(letter_words(t) for t in part.column("text").to_pylist()), strict=True)
                rows = table.rows(words)
                owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
                values = table.table[rows]
                real = values[:, k] > 0
                end = np.cumsum([len(w) for w in words])
                more = np.zeros(len(words), np.int64)  # pieces beyond the first of a word
                for i, w in enumerate(source):
                    if w is not None:
                        with_letter = w[real[end[i] - len(w) : end[i]]]
                        more[i] = len(with_letter) - len(np.unique(with_letter))
                owner, emit = owner[real], values[real, :k]
                sizes = np.bincount(owner, minlength=len(words))
                if field is None:
                    best, score, switches, sizes = np.zeros(len(words), int), np.zeros(len(words)), np.zeros(len(words), int), np.zeros(len(words), int)
                else:
                    p = marginals(emit, sizes, field.trans, field.start)
                    mean = np.stack([np.bincount(owner, p[:, c], len(words)) for c in range(k)], 1) / np.maximum(1, sizes)[:, None]
                    best = mean.argmax(1)
                    score = np.clip(mean.max(1), 0, 1)
                    top = p.argmax(1)
                    change = (top[1:] != top[:-1]) & (owner[1:] == owner[:-1])
                    switches = np.bincount(owner[1:][change], minlength=len(words))
                lang = [field.langs[b] if n else "und" for b, n in zip(best, sizes, strict=True)] if field else ["und"] * len(words)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(sizes > 0, score, 0.0)), pa.array((sizes - more if field else sizes).astype(np.int64)), pa.array(switches.astype(np.int64))],
                    names,
                )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, n_words long, n_switches long"
    )
