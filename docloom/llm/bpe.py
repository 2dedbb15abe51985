"""Byte-level BPE: the distinct words of a corpus are folded once by Spark higher-order functions, texts put together from them."""

from __future__ import annotations

import base64
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pack, release, released, settled, small_batches, unpack

#: Longest word in bytes that is folded: the fold's work grows with the square of a word's length. Longer ones are merged on a
#: heap, by the same rule.
LONGEST = 256
#: Characters of a chunk, the texts whose distinct words a task asks for together.
CHUNK = 1 << 25
#: Texts and words of a row of texts, at most, but for a longer text; bytes of a batch that a worker is handed.
TEXTS, WORDS, BATCH = 256, 1 << 18, 1 << 22
#: Buckets of words for each shuffle partition.
BUCKETS = 4
NO_RANK = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """The rank map by pairs of pieces: a perfect hash of (rank of the left piece, rank of the right one).

    A pair stands at ``(key + shifts[key mod their number]) mod slots``, where key is left * wide + right.
    """

    def __init__(self, ranks: dict[bytes, int], seed: int = 1):
        self.wide = max(ranks.values(), default=0) + 1
        self.single = [ranks.get(bytes([i]), NO_RANK) for i in range(256)]
        pairs = {
            ranks[piece[:i]] * self.wide + ranks[piece[i:]]: rank
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        }
        rng = random.Random(seed)
        slots = 2 * len(pairs) + 7
        while not self._place(pairs, slots, rng):
            slots += 1  # pairs of one group that agree in both remainders part at another number of slots

    def _place(self, pairs: dict[int, int], slots: int, rng: random.Random) -> bool:
        """Shifts that give every pair a slot of its own, the largest groups of pairs first; False if so many slots won't do."""
        groups = defaultdict(list)
        count = len(pairs) // 2 + 1
        for key in pairs:
            groups[key % count].append(key)
        self.shifts, self.keys, self.values = np.zeros(count, np.int64), np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
        taken = bytearray(slots)
        for group, keys in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            base = [key % slots for key in keys]
            if len(set(base)) < len(base):
                return False
            for _ in range(10_000):
                shift = rng.randrange(slots)
                at = [(b + shift) % slots for b in base]
                if not any(taken[i] for i in at):
                    break
            else:
                return False
            self.shifts[group] = shift
            for i, key in zip(at, keys, strict=True):
                taken[i], self.keys[i], self.values[i] = 1, key, pairs[key]
        return True

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table as one struct in one row."""
        made = {"shifts": (self.shifts, pa.int64()), "keys": (self.keys, pa.int64()), "values": (self.values, pa.int32()), "single": (self.single, pa.int32())}
        columns = {c: pa.array([np.asarray(v).tolist()], pa.list_(kind)) for c, (v, kind) in made.items()}
        return spark.createDataFrame(pa.table(columns)).select(F.struct(*made))

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """Rank of two pieces as one; NO_RANK if they are none, or the right one is null."""
        key = left.cast("long") * F.lit(self.wide) + right
        slot = lambda: ((key + F.get(table["shifts"], (key % F.lit(len(self.shifts))).cast("int"))) % F.lit(len(self.keys))).cast("int")
        return F.when(F.get(table["keys"], slot()) == key, F.get(table["values"], slot())).otherwise(F.lit(NO_RANK))


def with_table(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """``df`` with the one value of ``table`` as the column ``name``, for one expression above that names it once: Spark puts
    the subquery itself in the name's place then, so that no row holds a copy.

    A literal's text would stand in all texts of the plan, which Spark's listeners keep on the driver for each query that
    ran and are sent anew each time that the plan is adapted: megabytes each.
    """
    return df.withColumn(name, table.scalar())


def fold_merges(word: Column, table: Column, pairs: PairTable) -> Column:
    """Ids of a word (array of its bytes as numbers) by folding ranked merges: the lowest-ranked adjacent pair first, the
    leftmost of equals. ``table``: a column with the value of ``pairs.frame``.

    The state is the pieces' ranks, which are their ids, and the rank of each piece with the next. The table is bound to a
    variable first: each place that named it would hold a copy of its own.
    """
    return F.get(F.transform(F.array(table), lambda t: _fold(word, t, pairs)), 0)


def _fold(word: Column, table: Column, pairs: PairTable) -> Column:
    state = lambda p, r: F.struct(p.alias("p"), r.alias("r"))
    bind = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    none = F.array().cast("array<int>")

    def merged(s: Column, low: Column) -> Column:
        p, r = s["p"], s["r"]

        def at(k: Column) -> Column:  # k: place of the pair, from 0
            left = F.when(k > 0, F.array(pairs.rank(table, F.get(p, k - 1), low))).otherwise(none)
            return state(
                F.concat(F.slice(p, F.lit(1), k), F.array(low), F.slice(p, k + 3, F.size(p))),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 1, F.lit(0))), left, F.array(pairs.rank(table, low, F.get(p, k + 2))), F.slice(r, k + 3, F.size(p))),
            )

        return bind((F.array_position(r, low) - 1).cast("int"), at)

    def step(s: Column, _: Column) -> Column:
        return bind(F.array_min(s["r"]), lambda low: F.when(low < NO_RANK, merged(s, low)).otherwise(s))

    first = F.transform(word, lambda b: F.get(table["single"], b))
    start = bind(first, lambda p: state(p, F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda a, b: pairs.rank(table, a, b))))
    done = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(word), F.lit(2))), start, step, lambda s: s["p"])
    return F.when(F.size(word) == 0, none).otherwise(done)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word by ranked merges on a heap, in n log n steps."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not piece[i] or j >= n or piece[i] + piece[j] != both:
            continue  # one of the two has been merged since
        piece[i], piece[j] = both, b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(both + piece[k])) is not None:
                heapq.heappush(heap, (r, i, both + piece[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h] + both)) is not None:
            heapq.heappush(heap, (r, h, piece[h] + both))
    return [ranks[p] for p in piece if p]


def _chunks(batches, find):
    """For each chunk: doc_ids, the words of each text as numbers, and the number of each distinct word."""
    ids, numbers, place, size = [], [], {}, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = find(text or "")
                for w in set(words).difference(place):
                    place[w] = len(place)
                ids.append(i)
                numbers.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
                size += len(text or "") + 1
                if size > CHUNK:
                    yield ids, numbers, place
                    ids, numbers, place, size = [], [], {}, 0
    if ids:
        yield ids, numbers, place


def _runs(numbers: list[np.ndarray]):
    """Bounds of the runs of texts that share a row."""
    start, held = 0, 0
    for i, words in enumerate(numbers):
        if i > start and (i - start == TEXTS or held + len(words) > WORDS):
            yield start, i
            start, held = i, 0
        held += len(words)
    if numbers:
        yield start, len(numbers)


def _by_bucket(words, buckets: int) -> list[list[bytes]]:
    """The words of each bucket, in byte order."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for raw in map(str.encode, words):
        out[crc(raw) % buckets].append(raw)
    for rows in out:
        rows.sort()
    return out


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes, int]:
    flat = b"".join(words)
    return pack(np.fromiter(map(len, words), np.int64, len(words))), pa.compress(flat, codec="zstd", asbytes=True) if flat else b"", len(flat)


def _unpack_words(sizes: bytes, blob: bytes, size: int) -> list[bytes]:
    ends = np.cumsum(unpack(sizes)).tolist()
    flat = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


#: Rows of requests (bucket, lengths, words, size) and of texts (no bucket; counts, numbers, doc_ids) of each chunk.
ASKED = "key long, chunk long, bucket long, lengths binary, words binary, size long, counts binary, numbers binary, doc_ids array<long>"


def _asked(pattern: str, buckets: int):
    """For each chunk a row of the distinct words in each bucket; a row (no counts) of where each word stands in the order of
    those, for words by falling number of occurrences; and rows of texts whose words are numbers in that order."""

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        part = TaskContext.get().partitionId() << 32
        for turn, (ids, numbers, place) in enumerate(_chunks(batches, find)):
            chunk = part + turn
            by_bucket = _by_bucket(place, buckets)
            rows = [(b, *_pack_words(ws)) for b, ws in enumerate(by_bucket) if ws]
            for s in range(0, len(rows), 256):
                bucket, lengths, blobs, size = zip(*rows[s : s + 256], strict=True)
                yield _rows(ASKED, len(bucket), key=bucket, chunk=[chunk] * len(bucket), bucket=bucket, lengths=lengths, words=blobs, size=size)
            met = np.fromiter((place[w.decode()] for ws in by_bucket for w in ws), np.int64, len(place))  # numbers in the order of the requests
            del by_bucket, rows
            met_often = np.zeros(len(place), np.int64)
            for s, e in _runs(numbers):
                met_often += np.bincount(np.concatenate(numbers[s:e]), minlength=len(place))
            rank = np.argsort(-met_often[met], kind="stable")
            yield _rows(ASKED, 1, key=[-1 - chunk], chunk=[chunk], numbers=[pack(rank)])
            number = np.empty(len(place), np.int32)
            number[met[rank]] = np.arange(len(place), dtype=np.int32)
            place.clear()
            release()
            for s, e in _runs(numbers):
                sizes = np.fromiter(map(len, numbers[s:e]), np.int64, e - s)
                yield _rows(ASKED, 1, key=[-1 - chunk], chunk=[chunk], counts=[pack(sizes)], numbers=[pack(number[np.concatenate(numbers[s:e])])], doc_ids=[ids[s:e]])

    return run


KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _rows(schema: str, n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that aren't given are null."""
    kinds = dict(c.split() for c in schema.split(", "))
    made = {c: columns.get(c, pa.nulls(n, KINDS[k])) for c, k in kinds.items()}
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, KINDS[kinds[c]]) for c, v in made.items()], list(made))


DISTINCT = "chunk long, bucket long, bytes array<int>, ids array<int>, wanted binary, counts binary, numbers binary, doc_ids array<long>"


def _distinct(ranks):
    """For each bucket rows of its distinct words, in byte order (bytes as numbers, to be folded, or the ids of words that are
    pieces themselves or too long to be folded), then rows of its requests (chunk, places of the wanted words). Rows come
    sorted by bucket; rows of texts, behind all buckets, go on as they are."""

    def done(bucket: int, asked: list[tuple[int, list[bytes]]]):
        known = ranks.value
        rows = sorted(set().union(*(words for _, words in asked)))
        for s in range(0, len(rows), 4096):
            part = rows[s : s + 4096]
            ids = [[known[w]] if w in known else merge_long(w, known) if len(w) > LONGEST else None for w in part]
            todo = [w if i is None else b"" for w, i in zip(part, ids, strict=True)]
            ends = np.cumsum([0, *map(len, todo)], dtype=np.int32)
            flat = np.frombuffer(b"".join(todo), np.uint8).astype(np.int32)
            yield _rows(DISTINCT, len(part), bucket=[bucket] * len(part), bytes=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), ids=ids)
        place = dict(zip(rows, range(len(rows)), strict=True))
        for s in range(0, len(asked), 256):
            part = asked[s : s + 256]
            wanted = [pack(np.fromiter(map(place.__getitem__, words), np.int64, len(words))) for _, words in part]
            yield _rows(DISTINCT, len(part), chunk=[c for c, _ in part], bucket=[bucket] * len(part), ids=[[]] * len(part), wanted=wanted)

    def run(batches):
        now, asked = None, []
        for batch in batches:
            texts = batch.filter(batch.column("bucket").is_null())
            for bucket, chunk, lengths, blob, size in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "lengths", "words", "size")), strict=True):
                if bucket != now:
                    if asked:
                        yield from done(now, asked)
                    now, asked = bucket, []
                if bucket is not None:
                    asked.append((chunk, _unpack_words(lengths, blob, size)))
            if texts.num_rows:
                yield _rows(DISTINCT, texts.num_rows, ids=[[]] * texts.num_rows, **{c: texts.column(c) for c in ("chunk", "counts", "numbers", "doc_ids")})
        if asked:
            yield from done(now, asked)

    return run


ANSWERED = "chunk long, bucket long, counts binary, ids binary, doc_ids array<long>"


def _answers(batches):
    """For each request the ids of its words, in its order (chunk, bucket, counts, ids): of each bucket the words come first.
    Rows of texts go on (their numbers as ids)."""
    now, held, table = None, [], None
    for batch in batches:
        texts = batch.filter(batch.column("bucket").is_null())
        if texts.num_rows:
            yield _rows(ANSWERED, texts.num_rows, chunk=texts.column("chunk"), counts=texts.column("counts"), ids=texts.column("numbers"), doc_ids=texts.column("doc_ids"))
        batch = batch.filter(batch.column("bucket").is_valid())
        bucket = batch.column("bucket").to_numpy()
        is_word = batch.column("chunk").is_null().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (is_word[1:] != is_word[:-1])) + 1).tolist(), len(bucket)]
        out = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if bucket[s] != now:
                now, held, table = bucket[s], [], None
            if is_word[s]:
                ids = batch.column("ids").slice(s, e - s)
                held.append((pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()))
                continue
            if table is None:
                size = np.concatenate([n for n, _ in held])
                table = size, np.cumsum(size) - size, np.concatenate([i for _, i in held])
            for chunk, wanted in zip(batch.column("chunk").slice(s, e - s).to_pylist(), batch.column("wanted").slice(s, e - s).to_pylist(), strict=True):
                n, ids = _taken(table, unpack(wanted).astype(np.int64))
                out.append((chunk, int(now), pack(n), pack(ids)))
        if out:
            chunk, buckets, counts, blobs = zip(*out, strict=True)
            yield _rows(ANSWERED, len(out), chunk=chunk, bucket=buckets, counts=counts, ids=blobs)


def _taken(table: tuple[np.ndarray, np.ndarray, np.ndarray], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids, and the ids, of the words at these places of a table (numbers of ids, their starts, all ids)."""
    size, start, flat = table
    n = size[places]
    ends = np.cumsum(n)
    return n, flat[np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(start[places], n)]


def _assemble(batches):
    """The ids of the texts of each chunk; rows sorted by chunk: its answers by bucket, the order of its words, its texts."""
    now, held, table = None, [], None
    for batch in batches:
        for chunk, bucket, counts, ids, docs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "counts", "ids", "doc_ids")), strict=True):
            if chunk != now:
                now, held, table = chunk, [], None
            if bucket is not None:
                held.append((unpack(counts).astype(np.int64), unpack(ids).astype(np.int32)))
            elif counts is None:
                rank = unpack(ids).astype(np.int64)
                size = np.concatenate([np.empty(0, np.int64), *(c for c, _ in held)])
                table = size[rank], (np.cumsum(size) - size)[rank], np.concatenate([np.empty(0, np.int32), *(i for _, i in held)])
                held = []
            else:
                n, flat = _taken(table, unpack(ids).astype(np.int64))
                ends = np.cumsum(np.concatenate([[0], n]))
                of_text = ends[np.cumsum(np.concatenate([[0], unpack(counts).astype(np.int64)]))].astype(np.int32)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(of_text), pa.array(flat))], ["doc_id", "ids"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids array<int>.

    Each match of ``pattern`` is encoded on its own, without special tokens.
    Tasks lay texts into chunks and send the distinct words of each to buckets
    by hash. Every distinct word of the corpus is folded once in the JVM, but
    for words that are pieces themselves and words above LONGEST bytes, which
    are merged on a heap by the same rule; the ids go back to the chunks that
    asked, where the texts, as numbers of their chunk's words, wait for them.
    Null and empty texts have no ids; repeated rows are encoded alike; other
    columns are ignored; no rows give no rows. Work is linear in the text,
    n log n in the length of a long word.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = settled(small_batches(docs, size=BATCH).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shared = spark.sparkContext.broadcast(ranks)
    asked = whole.mapInArrow(released(_asked(pattern, BUCKETS * parts)), ASKED).repartition(parts, "key").sortWithinPartitions(F.asc_nulls_last("bucket"), "chunk")
    words = asked.drop("key").mapInArrow(released(_distinct(shared)), DISTINCT)
    pairs = PairTable(ranks)
    held = with_table(words, "table", pairs.frame(spark))
    folded = held.withColumn("ids", F.coalesce("ids", fold_merges(F.col("bytes"), F.col("table"), pairs))).drop("bytes", "table")
    answered = folded.mapInArrow(released(_answers), ANSWERED).repartition(parts, "chunk")
    in_order = [F.col("chunk"), F.asc_nulls_last("bucket"), F.col("counts").isNotNull()]
    return answered.sortWithinPartitions(*in_order).mapInArrow(released(_assemble), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (ids array<int>, and more) with the column ``decoded``: the binary pieces of the ids, concatenated.

    Pieces stand in the table as Latin-1 text, a character for each byte. Null
    ids, empty arrays and ids without a piece give no bytes.
    """
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece.decode("latin-1")
    table, taken = "pieces", {c.lower() for c in encoded.columns}
    while table in taken:
        table += "_"
    held = with_table(encoded, table, encoded.sparkSession.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.string()))})))
    text = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(table, i)), "")
    return held.withColumn("decoded", F.encode(text, "ISO-8859-1")).drop(table)
