"""Cross-entropy difference of texts under matched target and background bigram models with one vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, pack, pack_rising, settled, small_batches, staged, unpack, unpack_rising

#: Weight of the unigrams.
PRIOR = 50.0
#: Words of a chunk: what a task counts, or scores, together.
CHUNK = 1 << 21
#: Words a task remembers the names of.
MEMO = 300_000
#: Bits of the filter that picks the target's texts before they are joined; a fuller filter lets more texts through.
FILTER_BITS = 1 << 24
#: Buckets of names for each shuffle partition; a task counts one at a time.
BUCKETS = 4


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class WordHashes:
    """64-bit names of words, even; what stands before a text's first word is named like the empty word."""

    def __init__(self, memo: int = MEMO):
        self.memo, self.name_of = memo, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Names of the words of texts end to end, and the number of words of each text."""
        if len(self.name_of) > self.memo:
            self.name_of.clear()
        lists, known = [words_of(t) for t in texts], self.name_of
        for w in {w for row in lists for w in row}.difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~1
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((known[w] for row in lists for w in row), np.uint64, int(sizes.sum())), sizes


START = np.uint64(int.from_bytes(hashlib.blake2b(b"", digest_size=8).digest(), "little") & ~1)


def pair_names(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit names of bigrams, odd."""
    with np.errstate(over="ignore"):
        h = before * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) + word) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29)) | np.uint64(1)


def before_each(ids: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The word before each word of texts laid end to end; ``start`` before the first of a text."""
    out = np.concatenate([ids[:0], [start], ids[:-1]]).astype(ids.dtype)[: len(ids)]
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    return out


class Corpus(NamedTuple):
    """What the models are made of: all counted texts, and the ids of those that make the target model."""

    docs: DataFrame
    target: DataFrame


def fit_models(docs: DataFrame, target: DataFrame) -> Corpus:
    """Models of every word and every bigram in all rows of ``docs`` (doc_id, text).

    Texts whose doc_id is in ``target`` (doc_id) make the target model, all
    others the background model, scaled to the target's number of words. Null
    ids are background. Nothing is counted before texts are scored: counts are
    shuffled once, and answered to the chunks of texts that ask for them.
    """
    return Corpus(docs, target)


def _chunks(batches) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, names of the words and sizes of the texts of each chunk; the same for the same rows."""
    names_of, ids, held, size = WordHashes(), [], [], 0

    def made():
        return ids, np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held])

    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            ids = ids + batch.column("doc_id").slice(s, 64).to_pylist()
            held.append(names_of(batch.column("text").slice(s, 64).to_pylist()))
            size += len(held[-1][0]) + len(held[-1][1])
            if size > CHUNK:
                yield made()
                ids, held, size = [], [], 0
    if held:
        yield made()


def _numbered(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rising names of a chunk's words and of the start, the number of each word among them, and the start's."""
    own, at = np.unique(np.concatenate([[START], words]).astype(np.uint64), return_inverse=True)
    return own, at[1:].astype(np.int64), int(at[0])


def _requests(buckets: int, counted: bool, asked: bool):
    """Rows (chunk, bucket, names, counts) of the distinct words and bigrams of each chunk, rising by name.

    ``counted``: how often each stands there; ``asked``: the chunk waits for an answer.
    """

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        for turn, (_, words, sizes) in enumerate(_chunks(batches)):
            own, at, start = _numbered(words, sizes)
            pairs, pair_n = np.unique(before_each(at, sizes, start) * len(own) + at, return_counts=True)
            word_n = np.bincount(at, minlength=len(own))
            word_n[start] += int((sizes > 0).sum())
            names = np.concatenate([own, pair_names(own[pairs // len(own)], own[pairs % len(own)])])
            counts = np.concatenate([word_n, pair_n]) if counted else np.zeros(len(names), np.int64)
            order = np.argsort(names)
            names, counts = names[order], counts[order]
            yield from _dealt(part + turn if asked else None, names, counts, buckets)

    return run


def _edges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where the names of each bucket, a range of names, begin; and the end."""
    firsts = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(names, firsts), [len(names)]])


def _dealt(chunk: int | None, names: np.ndarray, counts: np.ndarray, buckets: int):
    edges = _edges(names, buckets)
    for low in range(0, buckets, 256):
        rows = [b for b in range(low, min(buckets, low + 256)) if edges[b] < edges[b + 1]]
        cut = [slice(edges[b], edges[b + 1]) for b in rows]
        yield pa.record_batch(
            [
                pa.array([chunk] * len(rows), pa.int64()),
                pa.array(rows, pa.int64()),
                pa.array([pack_rising(names[c]) for c in cut], pa.binary()),
                pa.array([pack(counts[c]) for c in cut], pa.binary()),
            ],
            ["chunk", "bucket", "names", "counts"],
        )


ANSWER = "chunk long, bucket long, back binary, goal binary, n_back long, n_goal long, n_words long"


def _answers(batches):
    """For each request (chunk, bucket) the counts of its names on both sides, in its order; the first row of a bucket
    also has the sums over its words. Rows come sorted by bucket."""

    def done(bucket, rows):
        lists = [unpack_rising(r[1]) for r in rows]
        names, at = np.unique(np.concatenate(lists), return_inverse=True)
        ends = np.cumsum([0, *map(len, lists)])
        total, goal = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for (_, _, counts, is_goal), s, e in zip(rows, ends[:-1], ends[1:], strict=True):
            (goal if is_goal else total)[at[s:e]] += unpack(counts).astype(np.int64)
        back = total - goal
        word = ((names & np.uint64(1)) == 0) & (names != START)
        sums = [int(back[word].sum()), int(goal[word].sum()), int((word & (total > 0)).sum())]
        wait = [(r[0], at[s:e]) for r, s, e in zip(rows, ends[:-1], ends[1:], strict=True) if r[0] is not None]
        for i in range(0, max(1, len(wait)), 256):
            part = wait[i : i + 256] or [(None, np.empty(0, np.int64))]
            yield pa.record_batch(
                [
                    pa.array([c for c, _ in part], pa.int64()),
                    pa.array([bucket] * len(part), pa.int64()),
                    pa.array([pack(back[x]) for _, x in part], pa.binary()),
                    pa.array([pack(goal[x]) for _, x in part], pa.binary()),
                    *(pa.array([n if i + j == 0 else 0 for j in range(len(part))], pa.int64()) for n in sums),
                ],
                ["chunk", "bucket", "back", "goal", "n_back", "n_goal", "n_words"],
            )

    held, now = [], None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "names", "counts", "goal")), strict=True):
            if bucket != now:
                if held:
                    yield from done(now, held)
                held, now = [], bucket
            held.append(row)
    if held:
        yield from done(now, held)


TEXTS = "chunk long, bucket long, back binary, goal binary, doc_ids array<long>, sizes array<long>, words binary"


def _texts(batches):
    """The texts of each chunk: a row of its names (words: rising names), then rows of texts whose words are numbers."""
    part = TaskContext.get().partitionId() << 32
    columns = ["chunk", "bucket", "back", "goal", "doc_ids", "sizes", "words"]

    def row(chunk, ids, sizes, blob):
        none = pa.nulls(1, pa.binary())
        longs = pa.list_(pa.int64())
        return pa.record_batch(
            [pa.array([chunk]), pa.nulls(1, pa.int64()), none, none, pa.array([ids], longs), pa.array([sizes], longs), pa.array([blob], pa.binary())], columns
        )

    for turn, (ids, words, sizes) in enumerate(_chunks(batches)):
        own, at, _ = _numbered(words, sizes)
        yield row(part + turn, None, None, pack_rising(own))
        ends = np.cumsum(sizes)
        for s in range(0, len(ids), 64):
            low, high = int(ends[s - 1]) if s else 0, int(ends[min(s + 64, len(ids)) - 1])
            yield row(part + turn, ids[s : s + 64], sizes[s : s + 64].tolist(), pack(at[low:high]))


NAMES = ["doc_id", "n_tokens", "ce_target", "ce_background", "ce_diff"]
SCHEMA = "doc_id long, n_tokens long, ce_target double, ce_background double, ce_diff double"


def _losses(n_back: int, n_goal: int, n_words: int, prior: float):
    """Scores of the texts of each chunk, from its rows of texts and its answers; rows come sorted by chunk and bucket."""
    scale = n_goal / n_back if n_back and n_goal else 1.0

    def score(answers, own, texts):
        ids = [i for t in texts for i in t[0]]
        sizes = np.array([n for t in texts for n in t[1]], np.int64)
        at = np.concatenate([unpack(t[2]) for t in texts]).astype(np.int64)
        start, top = int(np.searchsorted(own, START)), len(own)
        pairs, which = np.unique(before_each(at, sizes, start) * top + at, return_inverse=True)
        order = np.argsort(np.concatenate([own, pair_names(own[pairs // top], own[pairs % top])]))
        owner, n = np.repeat(np.arange(len(sizes)), sizes), np.maximum(1, sizes)
        means = []
        for side, total, k in ((1, n_goal, 1.0), (0, n_back, scale)):
            c = np.empty(len(order))
            c[order] = np.concatenate([unpack(a[side]) for a in answers]) * k
            base = (c[pairs % top] + 1.0) / (total * k + n_words + 1)  # every word is possible, and one never met
            loss = -np.log((c[top:] + prior * base) / (c[pairs // top] + prior))
            means.append(np.bincount(owner, loss[which], len(sizes)) / n)
        a, b = means
        for s in range(0, len(ids), 1024):
            e = s + 1024
            yield pa.record_batch([pa.array(ids[s:e], pa.int64()), pa.array(sizes[s:e]), pa.array(a[s:e]), pa.array(b[s:e]), pa.array((a - b)[s:e])], NAMES)

    def run(batches):
        now, answers, own, texts = None, [], None, []
        for batch in batches:
            for chunk, back, goal, ids, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "back", "goal", "doc_ids", "sizes", "words")), strict=True):
                if chunk != now:
                    if now is not None:
                        yield from score(answers, own, texts)
                    now, answers, own, texts = chunk, [], None, []
                if back is not None:
                    answers.append((back, goal))
                elif ids is None:
                    own = unpack_rising(words)
                else:
                    texts.append((ids, sizes, words))
        if now is not None:
            yield from score(answers, own, texts)

    return run


def score_difference(docs: DataFrame, models: Corpus, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ce_target, ce_background, ce_diff.

    Mean loss per word of the whole text under each model, and target minus
    background: the lower, the more the text is like the target. A bigram's
    share is drawn to its word's share, which has the weight ``prior``. A text
    that was counted is in the counts it is scored by (it is not left out), so
    texts of the target look a little nearer to it than unseen ones would. Null
    and empty texts have 0 words and 0 everywhere. Repeated rows score alike;
    other columns are ignored; no rows give no rows.

    Tasks lay texts into chunks and send the distinct names of a chunk's words
    and bigrams (64-bit hashes), with their counts, to buckets by name. A
    bucket adds up what all chunks sent and answers each chunk in the order of
    its names. The texts of a chunk, read again, meet its answers. The target's
    texts are counted a second time to tell the two sides apart.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * parts
    plain = lambda d: small_batches(d).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "chunk long, bucket long, names binary, counts binary"
    ask = lambda d, counted, asked: d.mapInArrow(_requests(buckets, counted, asked), schema)
    everything, whole = plain(models.docs), settled(plain(docs))
    wanted = models.target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    wanted = staged(wanted, "target", few=True)
    goal = everything.where(bit_filter(wanted, FILTER_BITS)(F.col("doc_id")))
    goal = goal.join(wanted.hint("merge"), "doc_id", "left_semi")  # the target grows with the documents: sorted, whatever its size
    # the branch that asks comes first: its tasks are numbered as where its texts are read again
    same = models.docs is docs
    sent = [(ask(whole, same, True), False), (ask(goal, True, False), True)]
    if not same:
        sent.append((ask(everything, True, False), False))
    requests = [d.withColumn("goal", F.lit(is_goal)) for d, is_goal in sent]
    for more in requests[1:]:
        requests[0] = requests[0].unionByName(more)
    dealt = requests[0].repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = staged(dealt.mapInArrow(_answers, ANSWER), "answers")
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_back", "n_goal", "n_words"))).first()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = whole.mapInArrow(_texts, TEXTS).unionByName(
        answers.where("chunk is not null").select("chunk", "bucket", "back", "goal", none("doc_ids", "array<long>"), none("sizes", "array<long>"), none("words", "binary"))
    )
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_losses(*total, prior), SCHEMA)
