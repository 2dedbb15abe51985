"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, small_batches
from .word_features import WordTable, ngram_slots, split_long

#: Words of a window and from one window to the next: every word but those at the ends lies in two windows.
WINDOW, STRIDE = 16, 8
#: Units of a direction, size of a word's input, of the attention layer, and buckets of the embedding tables.
HIDDEN, INPUT, ATTEND, BUCKETS = 8, 12, 8, 1 << 13
NGRAMS = (3, 4, 5)
#: Labelled rows of each class the network is trained on at most (those with the smallest hash of their id).
MOST_TOXIC, MOST_CLEAN = 1200, 2400


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def split_words(text: str | None) -> tuple[list[str], np.ndarray | None]:
    """Words, long ones as pieces, and the word each is from."""
    return split_long((text or "").lower().split())


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>*#$%&-_") or word


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of the windows, STRIDE words apart, in texts laid end to end, which are real, and whose they are.

    A text without words has one window without words.
    """
    lengths = np.asarray(lengths, np.int32)
    count = np.maximum(1, -(-np.maximum(lengths - (WINDOW - STRIDE), 0) // STRIDE))
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), count)
    nth = np.arange(count.sum(), dtype=np.int32) - np.repeat(np.cumsum(count, dtype=np.int32) - count, count)
    inside = nth[:, None] * np.int32(STRIDE) + np.arange(WINDOW, dtype=np.int32)
    real = inside < lengths[owner][:, None]
    begin = np.cumsum(lengths, dtype=np.int32) - lengths
    return np.where(real, begin[owner][:, None] + inside, np.int32(-1)), real, owner


class Network:
    """Parameters, forward pass and gradients. Arrays carry the direction first."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {
            "chars": f(BUCKETS, INPUT, k=0.3),
            "words": f(BUCKETS, INPUT, k=0.1),
            "W": f(2, INPUT, 3 * HIDDEN, k=INPUT**-0.5),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "U": f(2, HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5),
            "A": f(2 * HIDDEN, ATTEND, k=0.3),
            "v": f(ATTEND, k=0.3),
            "u": f(2 * HIDDEN, k=0.3),
            "c": np.zeros(1, np.float32),
        }
        self.p["chars"][0] = self.p["words"][0] = 0
        self.scale = (1.0, 0.0)  # of the largest window logit of a text, for its score

    @staticmethod
    def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bare = [_bare(w) for w in words]
        chars = ngram_slots(bare, NGRAMS, BUCKETS)
        # a word's own bucket: a hash of the buckets of its n-grams
        mix = np.arange(1, chars.shape[1] + 1, dtype=np.int64) * 2654435761
        return chars, ((chars * mix).sum(1) % (BUCKETS - 1) + 1).astype(np.int32)

    def inputs(self, words: list[str]) -> np.ndarray:
        chars, own = self.slots(words)
        n = (chars > 0).sum(1)
        pairs = np.add.reduceat(self.p["chars"][chars[chars > 0]], np.cumsum(n) - n)  # every word has an n-gram: its marks count
        return pairs / np.sqrt(n)[:, None] + self.p["words"][own]

    def gates(self, words: list[str]) -> np.ndarray:
        """What the gates get from each word, for both directions: all that scoring needs of a word."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p["W"][d] + self.p["b"][d] for d in (0, 1)], axis=1)

    def run(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; gates: (windows, WINDOW, 2 x 3 HIDDEN)."""
        n, t, h3 = len(gates), gates.shape[1], 3 * HIDDEN
        U = self.p["U"]
        h = np.zeros((2, n, HIDDEN), np.float32)
        hs = np.empty((n, t, 2 * HIDDEN), np.float32)
        tape = []
        full = bool(real.all())
        for s in range(t):
            g = np.stack([gates[:, s, :h3], gates[:, t - 1 - s, h3:]])
            gh = np.matmul(h, U)
            rz = sigmoid(g[..., : 2 * HIDDEN] + gh[..., : 2 * HIDDEN])
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            ghn = gh[..., 2 * HIDDEN :]
            c = np.tanh(g[..., 2 * HIDDEN :] + r * ghn)
            new = c + z * (h - c)
            if not full:
                m = np.stack([real[:, s], real[:, t - 1 - s]])[..., None]
                new = np.where(m, new, h)
            if keep:
                tape.append((h, r, z, c, ghn))
            h = new
            hs[:, s, :HIDDEN] = h[0]
            hs[:, t - 1 - s, HIDDEN:] = h[1]
        q = np.tanh(hs @ self.p["A"])
        e = q @ self.p["v"]
        e = np.where(real, e, -1e9)
        a = np.exp(e - e.max(1, keepdims=True)) * real
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        ctx = (a[..., None] * hs).sum(1)
        logit = ctx @ self.p["u"] + self.p["c"][0]
        return (logit, (tape, hs, q, a, ctx)) if keep else logit

    def gradients(self, words: list[list[str]], real: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss of windows."""
        p = self.p
        names = sorted({w for row in words for w in row})
        place = {w: i for i, w in enumerate(names)}
        chars, own = self.slots(names)
        root = np.sqrt(np.maximum(1, (chars > 0).sum(1, keepdims=True))).astype(np.float32)
        x = p["chars"][chars].sum(1) / root + p["words"][own]
        at = np.array([[place[w] for w in row] + [0] * (WINDOW - len(row)) for row in words])
        xs = x[at]
        gates = np.concatenate([xs @ p["W"][d] + p["b"][d] for d in (0, 1)], axis=2)
        logit, (tape, hs, q, a, ctx) = self.run(gates, real, keep=True)
        d = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        out = {"u": ctx.T @ d, "c": np.array([d.sum()], np.float32)}
        dctx = d[:, None] * p["u"]
        dhs = a[..., None] * dctx[:, None]
        da = (hs * dctx[:, None]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        out["v"] = np.einsum("nt,ntk->k", de, q)
        dq = de[..., None] * p["v"] * (1 - q * q)
        out["A"] = np.einsum("nth,ntk->hk", hs, dq)
        dhs += dq @ p["A"].T
        t, h3 = gates.shape[1], 3 * HIDDEN
        dgates = np.zeros_like(gates)
        out["U"] = np.zeros_like(p["U"])
        dh = np.zeros((2, len(gates), HIDDEN), np.float32)
        for s in reversed(range(t)):
            h, r, z, c, ghn = tape[s]
            m = np.stack([real[:, s], real[:, t - 1 - s]])[..., None]
            dh = dh + np.stack([dhs[:, s, :HIDDEN], dhs[:, t - 1 - s, HIDDEN:]])
            dn, through = dh * m, dh * ~m
            dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
            dr = dc * ghn * r * (1 - r)
            dgh = np.concatenate([dr, dz, dc * r], axis=2)
            out["U"] += np.matmul(h.transpose(0, 2, 1), dgh)
            dh = through + dn * z + np.matmul(dgh, p["U"].transpose(0, 2, 1))
            dg = np.concatenate([dr, dz, dc], axis=2)
            dgates[:, s, :h3] += dg[0]
            dgates[:, t - 1 - s, h3:] += dg[1]
        parts = (dgates[..., :h3], dgates[..., h3:])
        out["W"] = np.stack([np.einsum("ntx,ntg->xg", xs, part) for part in parts])
        out["b"] = np.stack([part.sum((0, 1))[None] for part in parts])
        dxs = sum(part @ p["W"][k].T for k, part in enumerate(parts)) * real[..., None]
        dx = np.stack([np.bincount(at.ravel(), dxs[..., k].ravel(), len(names)) for k in range(INPUT)], 1)
        out["words"] = np.stack([np.bincount(own, dx[:, k], BUCKETS) for k in range(INPUT)], 1)
        spread = dx / root
        i, j = np.nonzero(chars)
        flat = chars[i, j]
        out["chars"] = np.stack([np.bincount(flat, spread[i, k], BUCKETS) for k in range(INPUT)], 1)
        return out


def _adam(net: Network, words, real, target, weight, epochs: int, seed: int, state: dict, rate: float = 0.01, batch: int = 256):
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for s in range(0, len(order), batch):
            o = order[s : s + batch]
            g = net.gradients([words[i] for i in o], real[o], target[o], weight[o])
            state["t"] = t = state.get("t", 0) + 1
            for k, d in g.items():
                m, v = state.setdefault(k, (np.zeros_like(net.p[k]), np.zeros_like(net.p[k])))
                m *= 0.9
                m += 0.1 * d
                v *= 0.99
                v += 0.01 * d * d
                net.p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            net.p["chars"][0] = net.p["words"][0] = 0


def _evidence(texts: list[list[str]], labels: np.ndarray) -> list[np.ndarray]:
    """A first guess per word: the largest smoothed log odds of its n-gram buckets between the texts of both classes."""
    names = sorted({w for t in texts for w in t})
    place = {w: i for i, w in enumerate(names)}
    parts = [ngram_slots([_bare(w) for w in names[s : s + 4096]], NGRAMS, BUCKETS).astype(np.uint16) for s in range(0, len(names), 4096)]
    chars = np.concatenate(parts) if parts else np.zeros((0, 1), np.uint16)
    counts = np.zeros((2, BUCKETS * 4))
    buckets = [np.unique(chars[[place[w] for w in set(t)]]) if t else np.empty(0, np.int32) for t in texts]
    for b, y in zip(buckets, labels, strict=True):
        counts[int(y), b] += 1
    n = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    odds *= np.minimum(1, counts.sum(0) / 5)
    odds[0] = -9
    odds = odds.astype(np.float32)
    best = np.concatenate([odds[chars[s : s + 4096]].max(1) for s in range(0, len(chars), 4096)]) if len(names) else np.empty(0)
    return [best[[place[w] for w in t]] if t else np.empty(0, np.float32) for t in texts]


def train(texts: list[str], labels: list[int], seed: int = 3) -> Network | float:
    """The network fitted to labelled texts; with one class only, its share as a constant score.

    A toxic text need have one toxic window only. The windows with the
    strongest evidence stand for their text at first; in later rounds those the
    network itself finds highest, of clean texts too. Every fifth text is kept
    from the network and sets the scale of the score.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    pool: dict[str, str] = {}  # one object per distinct word
    words = [[pool.setdefault(w, w) for w in split_words(t)[0]] for t in texts]
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    held_words, held_y = [w for w, x in zip(words, apart, strict=True) if x], y[apart]
    words, y = [w for w, x in zip(words, apart, strict=True) if not x], y[~apart]
    at, real, owner = windows([len(w) for w in words])
    flat = [w for t in words for w in t]
    rng = np.random.default_rng(seed)
    evidence = np.concatenate([*_evidence(words, y), np.float32([-9])])  # the last stands for no word
    strength = np.concatenate([evidence[at[s : s + 8192]].max(1) for s in range(0, len(at), 8192)])
    del evidence
    net, state = Network(seed), {}
    for turn in range(3):
        order = np.lexsort((-strength, owner))
        first = np.r_[True, owner[order][1:] != owner[order][:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        clean = y[owner[order]] == 0
        use = np.where(clean, (rank < 2) | (rng.random(len(order)) < 2 * (y == 0).sum() / max(1, clean.sum())), rank < 1)
        chosen = order[use]
        target = y[owner[chosen]]
        weight = np.where(target > 0, (target == 0).sum() / max(1, 2 * (target > 0).sum()), 1.0).astype(np.float32)
        picked = [[flat[k] for k in at[i][real[i]]] for i in chosen]
        batch = min(256, max(32, len(picked) // 16))
        steps = max(500 if turn == 0 else 250, 3 * len(picked) // batch)
        epochs = -(-steps * batch // len(picked))
        _adam(net, picked, real[chosen], target, weight, epochs, seed + turn, state, 0.01 if turn < 2 else 0.004, batch)
        strength = _logits(net, words)[0]
    if len(held_y):
        y = held_y
        strength, owner = _logits(net, held_words)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, strength)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the log loss of the texts' largest logits, lightly held to the start
        q = sigmoid(a * top + b)
        d, w = q - y, q * (1 - q)
        grad = np.array([(d * top).sum() + (a - 1), d.sum() + b])
        hess = np.array([[(w * top * top).sum() + 1, (w * top).sum()], [(w * top).sum(), w.sum() + 1]])
        move = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(move[0], -0.5, 0.5)), b - float(np.clip(move[1], -0.5, 0.5))
    net.scale = (max(a, 0.05), b)
    return net


def _logits(net: Network, words: list[list[str]], table: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text of every window."""
    table = table or WordTable(net.gates, 6 * HIDDEN)
    rows = np.append(table.rows(words), 0)  # row 0 where a window has no word
    at, real, owner = windows([len(w) for w in words])
    out = np.empty(len(at), np.float32)
    for s in range(0, len(at), 2048):
        out[s : s + 2048] = net.run(table.table[rows[at[s : s + 2048]]], real[s : s + 2048])
    return out, owner


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, seed: int = 3):
    """Train on labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most so many of each class.

    ``labels`` (doc_id, toxic); null labels and ids are left out, of several
    labels of an id the highest holds, of several texts of an id the smallest,
    whatever their order.
    """
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .withColumn("lot", F.xxhash64(F.lit(seed), "doc_id"))
    )
    chosen = marked.where("toxic > 0").orderBy("lot", "doc_id").limit(most_toxic)
    chosen = chosen.unionByName(marked.where("toxic = 0").orderBy("lot", "doc_id").limit(most_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id"  # at most most_toxic + most_clean rows
    )
    rows = texts.groupBy("lot", "doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("lot", "doc_id", "text", "toxic")

    def fit(rows):
        made = train([r[2] for r in rows], [int(r[3] > 0) for r in rows], seed)
        return made if isinstance(made, float) else made.__dict__

    made = fit_in_task(rows, fit)
    if not isinstance(made, dict):
        return made or 0.0
    net = Network()
    net.__dict__.update(made)
    return net


def _scored(batches, net: Network | float):
    """Parts of the batches with score, number of windows and place of the highest window of each text."""
    table = WordTable(net.gates, 6 * HIDDEN) if not isinstance(net, float) else None
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            part = batch.slice(s, 64)
            words, source = zip(*(split_words(t) for t in part.column("text").to_pylist()), strict=True)
            _, _, owner = windows([len(w) for w in words])
            count = np.bincount(owner, minlength=len(words))
            if table is None:
                yield part, np.full(len(words), net), count, np.zeros(len(words), np.int64)
                continue
            logit, _ = _logits(net, words, table)
            best = np.lexsort((np.arange(len(logit)), -logit, owner))
            best = best[np.r_[True, owner[best][1:] != owner[best][:-1]]]
            score = sigmoid(net.scale[0] * logit[best].astype(np.float64) + net.scale[1])
            begin = (best - (np.cumsum(count) - count)) * STRIDE
            yield part, score, count, np.array([b if w is None else w[b] for b, w in zip(begin, source, strict=True)], np.int64)


def reject_toxic(docs: DataFrame, model: Network | float) -> DataFrame:
    """The rows of ``docs`` (text, and any others) whose score is below 0.5, unchanged; edge cases as for ``score_toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, score, _, _ in _scored(batches, shared.value):
            yield part.filter(pa.array(score < 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, model: Network | float) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score, predicted, n_windows, worst_word (where the highest
    window begins, counted in words).

    Windows of WINDOW words that begin every STRIDE words cover the whole text;
    so a phrase of more than STRIDE + 1 words may lie whole in none. The highest
    logit, scaled, gives the score. Words above 24 bytes are overlapping pieces, each
    one place of a window. Null and empty texts have one empty window.
    Repeated rows score alike; other columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "predicted", "n_windows", "worst_word"]

    def run(batches):
        for part, score, count, worst in _scored(batches, shared.value):
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(worst.astype(np.int64))],
                names,
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int, n_windows long, worst_word long"
    )
