"""Exact Jaccard self-join of word shingle sets: prefix index in position blocks, answers derived from hub sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, connected_components, drop_staged, pack, pack_rising, settled, small_batches, staged, unpack, unpack_rising

#: Shingles are ordered by the number of sets that hold them, up to this number; frequent ones come last in every set's order,
#: so unlike sets that share them stay apart.
HOT = 100_000
#: A list of at most so many sets is compared all with all; longer ones against hubs.
SMALL = 24
#: Times as many sets of a list ask in each turn as in the one before: texts are read as often as the logarithm of a list.
TURNS = 8
#: Shingles of a chunk, the texts whose shingles a task sends together.
CHUNK = 1 << 21
#: Buckets of names for each shuffle partition, and bits of a name.
BUCKETS = 4
NAME_BITS = 40
#: Bits of the filter that picks the texts to be read again, at most (eight a text below that); a fuller filter only lets
#: more texts through.
FILTER_BITS = 1 << 24
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct 64-bit hashes of the k-word shingles of a text, ascending."""

    def __init__(self, k: int, memo: int = 500_000):
        self.k, self.memo, self.hash_of = k, memo, {}

    def words(self, text: str | None) -> np.ndarray:
        if len(self.hash_of) > self.memo:
            self.hash_of.clear()
        words, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.hash_of
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, len(h) if len(h) < self.k else self.k, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(min(self.k, len(h))):
                out = (out ^ h[i : i + n]) * MIX
                out ^= out >> np.uint64(29)
        return np.unique(out)


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


#: Rows of requests (bucket, names, owners) and of texts (no bucket; doc_id, set_key, n, owner) of each chunk.
ASKED = "key long, chunk long, bucket long, names binary, owners binary, doc_id long, set_key long, n long, owner long"
#: The same without key; of requests the shared names are left, with the class of each.
SHARED = "chunk long, bucket long, names binary, classes binary, owners binary, doc_id long, set_key long, n long, owner long"
KINDS = {"long": pa.int64(), "binary": pa.binary()}


def _rows(schema: str, more: pa.Schema, size: int, /, **columns) -> pa.RecordBatch:
    """A batch of ``size`` rows of ``schema`` and the fields ``more``; columns that aren't given are null."""
    kinds = {c: KINDS[k] for c, k in (x.split() for x in schema.split(", "))} | {f.name: f.type for f in more}
    made = [columns.get(c, pa.nulls(size, k)) for c, k in kinds.items()]
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(made, kinds.values(), strict=True)], list(kinds))


def _asked(k: int, buckets: int, named: list[str]):
    """For each chunk a row of each text, and in each bucket, a range of names, the names of the shingles of its distinct
    sets, rising, with the number in the chunk of the set that holds them (its owner)."""
    firsts = np.array([-(-(b << NAME_BITS) // buckets) for b in range(1, buckets)], np.uint64)

    def deal(chunk, held, more):
        names = np.concatenate(held) >> np.uint64(64 - NAME_BITS)
        order = np.argsort(names, kind="stable")
        owners = np.repeat(np.arange(len(held), dtype=np.int32), [len(s) for s in held])[order]
        names = names[order]
        edges = np.concatenate([[0], np.searchsorted(names, firsts), [len(names)]])
        for low in range(0, buckets, 256):
            rows = [b for b in range(low, min(buckets, low + 256)) if edges[b] < edges[b + 1]]
            cut = [slice(edges[b], edges[b + 1]) for b in rows]
            yield _rows(
                ASKED, more, len(rows), key=rows, chunk=[chunk] * len(rows), bucket=rows, names=[pack_rising(names[c]) for c in cut], owners=[pack(owners[c]) for c in cut]
            )

    def run(batches):
        shingles, held, size, seen = Shingler(k), [], 0, set()
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            more = pa.schema([batch.schema.field(c) for c in named])
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, sizes, owners = [], [], []
                for text in part.column("text"):
                    s = shingles(text.as_py())
                    keys.append(set_key(s) if len(s) else None)
                    sizes.append(len(s))
                    new = len(s) and keys[-1] not in seen
                    owners.append(len(held) if new else None)
                    if new:
                        seen.add(keys[-1])
                        held.append(s)
                        size += len(s)
                yield _rows(
                    ASKED, more, len(part), key=[-1 - chunk] * len(part), chunk=[chunk] * len(part),
                    doc_id=part.column("doc_id"), set_key=keys, n=sizes, owner=owners, **{c: part.column(c) for c in named},
                )
                if size > CHUNK:
                    yield from deal(chunk, held, more)
                    held, size, seen, chunk = [], 0, set(), chunk + 1
        if held:
            yield from deal(chunk, held, more)

    return run


def _shared(hot: int, named: list[str]):
    """Of the requests of each bucket the names that more than one set holds, with a class that rises with the number of
    those sets. Rows come sorted by bucket; rows of texts, behind all buckets, go on as they are."""

    def done(bucket, rows, more):
        names = [unpack_rising(n) for _, n, _ in rows]
        _, at, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        classes = 1 + (4 * np.log2(np.maximum(np.minimum(count, hot), 1))).astype(np.int64)
        ends = np.cumsum([0, *map(len, names)])
        out = []
        for (chunk, _, owners), own, s, e in zip(rows, names, ends[:-1], ends[1:], strict=True):
            many = count[at[s:e]] > 1
            if many.any():
                out.append((chunk, pack_rising(own[many]), pack(classes[at[s:e][many]]), pack(unpack(owners)[many])))
        for s in range(0, len(out), 256):
            chunk, blobs, ranks, owners = zip(*out[s : s + 256], strict=True)
            yield _rows(SHARED, more, len(chunk), chunk=chunk, bucket=[bucket] * len(chunk), names=blobs, classes=ranks, owners=owners)

    def run(batches):
        now, held = None, []
        for batch in batches:
            more = pa.schema([batch.schema.field(c) for c in named])
            asked = batch.filter(batch.column("bucket").is_valid())
            for bucket, *row in zip(*(asked.column(c).to_pylist() for c in ("bucket", "chunk", "names", "owners")), strict=True):
                if bucket != now:
                    if held:
                        yield from done(now, held, more)
                    now, held = bucket, []
                held.append(row)
            texts = batch.filter(batch.column("bucket").is_null())
            if texts.num_rows:
                yield _rows(SHARED, more, texts.num_rows, **{c: texts.column(c) for c in ("chunk", "doc_id", "set_key", "n", "owner", *named)})
        if held:
            yield from done(now, held, more)

    return run


def _cut(percent: int, named: list[str]):
    """A row of each text: doc_id, key, n, the number of shingles that no other set holds (skip), and of the first text of
    each set in a chunk the rest of the set's prefix. Rows come sorted by chunk."""

    def done(texts, answers):
        texts = pa.Table.from_batches(texts).combine_chunks().to_batches()[0]
        sizes, owner = texts.column("n").to_numpy(), texts.column("owner")
        first = np.flatnonzero(owner.is_valid().to_numpy(zero_copy_only=False))
        n = sizes[first]  # owners are numbered as their texts come
        name, rank, own = (np.concatenate([np.empty(0, np.uint64), *x]) for x in (zip(*answers, strict=True) if answers else ([], [], [])))
        order = np.lexsort((name, rank, own))
        name, own = name[order].view(np.int64), own[order].astype(np.int64)
        many = np.bincount(own, minlength=len(n))
        skip = n - many
        some = np.clip(n - (percent * n + 99) // 100 + 1 - skip, 0, many)
        start = np.cumsum(many) - many
        prefix, skips = [b""] * len(sizes), np.zeros(len(sizes), np.int64)
        skips[first] = skip
        for i, s, e in zip(first.tolist(), start.tolist(), (start + some).tolist(), strict=True):
            prefix[i] = name[s:e].tobytes()
        return pa.record_batch(
            [*(texts.column(c) for c in ("doc_id", "set_key", "n")), pa.array(skips), pa.array(prefix, pa.binary()), *map(texts.column, named)],
            ["doc_id", "key", "n", "skip", "prefix", *named],
        )

    def run(batches):
        now, texts, answers = None, [], []
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if chunk[s] != now:
                    if texts:
                        yield done(texts, answers)
                    now, texts, answers = chunk[s], [], []
                part = batch.slice(s, e - s)
                asked = part.filter(part.column("bucket").is_valid())
                for names, classes, owners in zip(*(asked.column(c).to_pylist() for c in ("names", "classes", "owners")), strict=True):
                    answers.append((unpack_rising(names), unpack(classes), unpack(owners)))
                own = part.filter(part.column("bucket").is_null())
                if own.num_rows:
                    texts.append(own)
        if texts:
            yield done(texts, answers)

    return run


def _prefixes(docs: DataFrame, k: int, hot: int, percent: int, row: str | None = None) -> DataFrame:
    """doc_id, key, n, skip and the prefix of each text's set, as names, in the order of how many sets hold them: first
    those that only one set of all texts holds, ``skip`` in number. They can't be shared, and are left out.

    Tasks lay texts into chunks and send the names of their shingles to buckets once, packed; a bucket counts them, and
    sends those that are shared back to the chunks. A name is the upper NAME_BITS bits of a hash: shingles that share one
    count as shared, which lets more pairs through and loses none.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [row] if row else []
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in named)
    whole = settled(small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *named))
    asked = whole.mapInArrow(_asked(k, BUCKETS * parts, named), ASKED + more).repartition(parts, "key").sortWithinPartitions(F.asc_nulls_last("bucket"))
    shared = asked.drop("key").mapInArrow(_shared(hot, named), SHARED + more).repartition(parts, "chunk")
    # the texts of a chunk stay in the order of their owners' numbers
    return shared.sortWithinPartitions("chunk", F.asc_nulls_last("bucket"), F.asc_nulls_last("owner")).mapInArrow(
        _cut(percent, named), "doc_id long, key long, n long, skip long, prefix binary" + more
    )


def _postings(batches):
    """token (a name), place (position in the upper, set size in the lower 32 bits), key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            tokens = [np.frombuffer(b.as_py(), np.int64) for b in part.column("prefix")]
            size = np.array([len(t) for t in tokens])
            if not size.sum():
                continue
            skip = part.column("skip").to_numpy(zero_copy_only=False)
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - skip, size)
            n = np.repeat(part.column("n").to_numpy(zero_copy_only=False), size)
            key = np.repeat(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64), size)
            yield pa.record_batch(
                [pa.array(np.concatenate(tokens)), pa.array((pos << 32) | n), pa.array(key)], ["token", "place", "key"]
            )


def _may_link(pos_a, n_a, pos_b, n_b, percent):
    """Whether sets whose first common shingle stands at these positions can reach the threshold, by size and position."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    bound = np.minimum(n_a - pos_a, n_b - pos_b)
    return (100 * small >= percent * large) & ((100 + percent) * bound >= percent * (n_a + n_b))


def _list_pairs(percent: int, small: int):
    """Candidate pairs of short lists, hub pairs of long ones (kinds 0 and 2), and the entries of long lists (kind 1).

    Rows come sorted by (token, place, key): a list is read in blocks by
    position and never held whole. The first entry, the set with the fewest
    rarer shingles before the shared one, is the hub.
    """
    names = ["kind", "token", "place", "a", "b"]

    def out(kind, token, place, a, b):
        n = len(a)
        full = lambda x: x if isinstance(x, np.ndarray) else np.full(n, x, np.int64)
        return pa.record_batch([pa.array(full(x)) for x in (kind, token, place, a, b)], names)

    def pairs(pa_, ka, pb, kb):
        """Pairs with the smaller name first, and the sizes of both sets in the places of token and place. Kind 2: this
        can't be the first shingle that they share and still link; such meetings only count."""
        na, nb = pa_ & 0xFFFFFFFF, pb & 0xFFFFFFFF
        by_place = _may_link(pa_ >> 32, na, pb >> 32, nb, percent)
        ok = (ka != kb) & _may_link(0, na, 0, nb, percent)
        na, nb, ka, kb, by_place = (np.broadcast_to(v, ok.shape)[ok] for v in (na, nb, ka, kb, by_place))
        first = ka < kb
        return out(np.where(by_place, 0, 2), np.where(first, na, nb), np.where(first, nb, na), np.minimum(ka, kb), np.maximum(ka, kb))

    def short(token, place, key, start, size):
        """All pairs of the lists of one size, at once."""
        i, j = np.triu_indices(size, 1)
        at = start[:, None]
        a, b = (at + i).ravel(), (at + j).ravel()
        return pairs(place[a], key[a], place[b], key[b])

    def run(batches):
        rest, hub = None, None  # rest: rows of a list that may go on; hub: (token, place, key) of a long list under way
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("token", "place", "key")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            yield from work(rows, hub_box := [hub], last=False, keep=(keep := []))
            rest, hub = keep[0] if keep else None, hub_box[0]
        if rest is not None:
            yield from work(rest, [hub], last=True, keep=[])

    def work(rows, hub_box, last, keep):
        token, place, key = rows
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, int)
        size = np.diff(np.r_[start, len(token)])
        if not last and len(start):
            s = start[-1]  # the last list may go on in the next batch
            going = hub_box[0] is not None and hub_box[0][0] == token[s]
            if size[-1] <= small and not going:
                keep.append([x[s:] for x in rows])
                start, size = start[:-1], size[:-1]
        long = size > small
        if len(start) and hub_box[0] is not None and token[start[0]] == hub_box[0][0]:
            long[0] = True
        for n in np.unique(size[~long]):
            if n > 1:
                yield short(token, place, key, start[~long & (size == n)], n)
        for s, n in zip(start[long], size[long], strict=True):
            t, p, k = token[s], place[s : s + n], key[s : s + n]
            if hub_box[0] is None or hub_box[0][0] != t:
                hub_box[0] = (t, p[0], k[0])
            _, hp, hk = hub_box[0]
            yield out(1, t, p, k, hk)
            yield pairs(p, k, hp, hk)

    return run


def _read_sets(docs: DataFrame, wanted: DataFrame, k: int, bits: int) -> DataFrame:
    """key and set of the texts of ``wanted`` (doc_id), read again; a bounded bit table picks them from all rows."""
    may_want = bit_filter(wanted.select("doc_id"), bits)

    def run(batches):
        shingles = Shingler(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py()) for t in part.column(0)]
                sets = [s for s in sets if len(s)]
                yield pa.record_batch(
                    [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["key", "members"],
                )

    picked = docs.where(may_want(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))))
    return picked.select("text").mapInArrow(run, "key long, members binary")


def _sets_of(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, bits: int) -> DataFrame:
    """key and set of every set in ``pairs`` (a, b), read from one text each."""
    touched = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = touched.join(nodes, "key").select("key", F.coalesce("rep", F.lit(-(1 << 63))).alias("doc_id"))
    wanted = staged(wanted, "wanted", few=True)
    return staged(_read_sets(docs, wanted, k, bits).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")


def _enough_common(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the threshold by the number of lists they met in.

    Of two prefixes, the one that ends first in the common order is known whole
    to the other: what the sets share is at most the shingles that both
    prefixes hold, and the rest of the first set. Pairs may have met unseen in
    long lists; as many as either set has of those are allowed for.
    """
    met = pairs.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("c"), F.max("token").alias("na"), F.max("place").alias("nb"), F.min("kind").alias("kind")
    ).where("kind = 0")
    long = staged(entries.groupBy("key").agg(F.count(F.lit(1)).alias("long")), "long", few=True)  # plain shuffles below the joins: a hub's pairs can be split
    met = met.join(long.select(F.col("key").alias("a"), F.col("long").alias("la")), "a", "left")
    met = met.join(long.select(F.col("key").alias("b"), F.col("long").alias("lb")), "b", "left")
    unseen = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    rest = F.floor((percent * F.greatest("na", "nb") + 99) / 100) - 1
    return met.where((100 + percent) * (F.col("c") + unseen + rest) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _verify(batches):
    """Intersection sizes of pairs of sets."""
    for batch in batches:
        common = []
        for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            i = np.searchsorted(y, x)
            common.append((int((y[np.minimum(i, len(y) - 1)] == x).sum()), len(x) + len(y)))
        yield pa.record_batch(
            [batch.column("a"), batch.column("b"), pa.array([c for c, _ in common], pa.int64()), pa.array([n for _, n in common], pa.int64())],
            ["a", "b", "common", "total"],
        )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified overlaps of ``pairs`` (a, b): a, b, common, total, linked."""
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("members_b"))
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("members_a"))
    done = pairs.join(right, "b").join(left, "a").select("a", "b", "members_a", "members_b")
    done = done.mapInArrow(_verify, "a long, b long, common long, total long")
    return done.withColumn("linked", (100 + percent) * F.col("common") >= percent * F.col("total"))


def _checked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, bits: int, percent: int) -> DataFrame:
    """The verified overlaps of ``pairs``, staged; the sets don't outlive them."""
    sets = _sets_of(docs, pairs, nodes, k, bits)
    links = staged(_links(pairs, sets, percent), "links", few=True)
    drop_staged(sets)
    return links


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 75, hot: int = HOT, small: int = SMALL, bits: int = FILTER_BITS, row: str | None = None
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, set_key; and, where ``row`` (a column
    that names the rows) is given, that and component_key, null for texts without words, equal in one component only.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the
    distinct k-word shingles, of fewer words the whole sequence. Sets link when
    100 * intersection >= percent * union; component_id is the smallest doc_id
    reachable by links. Texts without words have an empty set and link with
    nothing. Equal sets are one node. Null ids form their own components only
    where no id is known; repeated rows share a component; other columns are
    ignored; no rows give no rows. Shingles and sets are named by 64-bit hashes.

    Candidates come from an index of set prefixes, rare shingles of all texts
    first; shingles that one set alone holds are in no list. Lists
    of at most ``small`` sets give all pairs. A longer list gives pairs with
    its hub only; sets that prove linked need no more answers. While a list
    still spans several components, the sets outside its largest one are
    compared with the other components, a few at first and TURNS times as many
    in each turn after, except where sizes, positions or the distances to the
    hub exclude a pair.
    """
    prefixes = staged(_prefixes(docs, k, hot, percent, row), "prefixes")
    named_rows = [row] if row else []
    rows = staged(prefixes.select("doc_id", "key", "n", *named_rows), "rows")
    full = rows.where("key is not null")
    nodes = staged(
        full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes", few=True
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = prefixes.where("octet_length(prefix) > 0").select("key", "n", "skip", "prefix").mapInArrow(_postings, "token long, place long, key long")
    lists = index.repartition(parts, "token").sortWithinPartitions("token", "place", "key")
    found = staged(
        lists.mapInArrow(_list_pairs(percent, small), "kind long, token long, place long, a long, b long"), "found"
    )
    drop_staged(prefixes)
    entries = staged(
        found.where("kind = 1").select("token", F.col("a").alias("key"), F.col("b").alias("hub"), "place").distinct(), "entries", few=True
    )
    pairs = staged(_enough_common(found.where("kind <> 1"), entries, percent), "pairs", few=True)
    drop_staged(found)
    checked = _checked(docs, pairs, nodes, k, bits, percent)
    labels = connected_components(checked.where("linked").select("a", "b"))
    known, asked, most = checked, None, 16 * small
    while (turn := _askers(entries, labels, known, asked, most)) is not None:
        live, askers = turn
        most *= TURNS
        pairs = _cross_pairs(live, askers, known, percent)
        if pairs.limit(1).count():
            again = _checked(docs, pairs, nodes, k, bits, percent)
            known = staged(known.unionByName(again), "links", few=True)
            if again.where("linked").limit(1).count():
                labels = connected_components(known.where("linked").select("a", "b"))
        now = askers.select("token", "key")
        asked = now if asked is None else staged(asked.unionByName(now), "asked", few=True)
    named = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    least = staged(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least", few=True)
    of_key = staged(named.join(least, "component").select("key", "component_id", "component"), "of_key", few=True)
    out = full.select("doc_id", "n", "key", *named_rows).join(of_key, "key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("key").alias("set_key"), *named_rows, *([F.col("component").alias("component_key")] if row else [])
    )
    empty = rows.where("key is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("set_key"), *named_rows, *([F.col("key").alias("component_key")] if row else [])
    )
    return out.unionByName(empty)


def _askers(
    entries: DataFrame, labels: DataFrame, known: DataFrame, asked: DataFrame | None, most: int
) -> tuple[DataFrame, DataFrame] | None:
    """The entries of long lists that still span several components, and of each list up to ``most`` sets outside its
    largest component that have not met the others; None when no list has any."""
    named = entries.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    open_lists = staged(largest.where("components > 1").select("token", F.col("top.component").alias("main")), "open", few=True)
    live = named.join(open_lists, "token")
    waiting = live.where("component <> main").select("token", "key", "place")
    if asked is not None:
        waiting = waiting.join(asked, ["token", "key"], "left_anti")
    turn = Window.partitionBy("token").orderBy("place", "key")
    chosen = waiting.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("token", "key")
    chosen = staged(chosen, "asking", few=True)
    if not chosen.limit(1).count():
        return None
    overlap = known.select("a", "b", (1 - F.col("common") / (F.col("total") - F.col("common"))).alias("far"))
    both = overlap.union(overlap.select("b", "a", "far"))
    away = both.select(F.col("a").alias("key"), F.col("b").alias("hub"), "far").distinct()
    live = live.join(away, ["key", "hub"], "left").withColumn(
        "far", F.when(F.col("key") == F.col("hub"), 0.0).otherwise(F.col("far"))
    )
    live = staged(live.select("token", "key", "place", "component", "far"), "live", few=True)
    return live, staged(live.join(chosen, ["token", "key"], "left_semi"), "askers", few=True)


def _cross_pairs(live: DataFrame, askers: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of an asker and a set of another component of its list, not compared before and not excluded by size,
    position or, from their distances to the list's hub, by the triangle inequality of the Jaccard distance."""
    side = lambda d, n: d.select("token", *(F.col(c).alias(c[0] + n) for c in ("key", "place", "component", "far")))
    size = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    rest = lambda c: size(c) - F.shiftright(c, 32)
    may = (
        (100 * F.least(size("px"), size("py")) >= percent * F.greatest(size("px"), size("py")))
        & ((100 + percent) * F.least(rest("px"), rest("py")) >= percent * (size("px") + size("py")))
        & (F.coalesce(F.abs(F.col("fx") - F.col("fy")), F.lit(0.0)) <= 1 - percent / 100 + 1e-9)
    )
    pairs = side(askers, "x").join(side(live, "y"), "token").where((F.col("cx") != F.col("cy")) & may)
    pairs = pairs.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b")).distinct()
    return staged(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "pairs", few=True)
