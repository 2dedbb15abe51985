"""The pipeline's stages against brute force."""

import collections
import random
import re

import pytest

import corpus_pipeline as P
from docloom.llm import toxicity
from tests.llm.test_llm import brute_jaccard, edited

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGE = dict(P.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def corpus():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(20, 90))), f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n"), "s1") for i in range(10)] + [(200 + i, edited(rows[20 + i][1], 1, i), "s0") for i in range(10)]
    rows += [(300, None, None), (301, "", "s0"), (302, "one two", "s0"), (303, "one two", None), (304, None, "s2"), (305, "x" * 3000, "s2"), (20, rows[20][1], "s0")]
    return rows


def test_deduplication_stages(spark):
    rows = corpus()
    docs = table(spark, rows)
    kept = STAGE["exact dedup"](spark, docs, None)
    assert kept.columns == docs.columns
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
    near = STAGE["n-gram Jaccard join"](spark, kept, None)
    assert near.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = sorted(i for i, _, c in brute_jaccard(left) if c == i)
    assert sorted(r["doc_id"] for r in near.collect()) == want
    assert STAGE["exact dedup"](spark, docs.limit(0), None).count() == 0 and STAGE["n-gram Jaccard join"](spark, docs.limit(0), None).count() == 0


def test_mixing_stage(spark):
    rows = [r for r in corpus() if r[0] != 20]
    docs = table(spark, rows)
    mixed = STAGE["mixing sources to target weights"](spark, docs, None)
    assert mixed.columns == docs.columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    taken = collections.Counter()
    text = {i: words(t) for i, t, _ in rows}
    for r in mixed.collect():
        w = words(r["text"])
        taken[r["doc_id"]] += len(w)
        twice = text[r["doc_id"]] * 2
        assert w and any(twice[k : k + len(w)] == w for k in range(len(text[r["doc_id"]]))) and r["n_chars"] == len(r["text"])
    plan = {r["doc_id"]: r["taken"] for r in P.mix_sources(docs).collect()}
    assert {i: n for i, n in plan.items() if n} == dict(taken)


def test_toxicity_stage(spark, tmp_path):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(200):
        bad = i % 3 == 0
        rows.append((i, " ".join([r.choice(["sun", "moon", "star", "sky", "cloud"]) for _ in range(30)] + ["vilewort"] * bad), "s"))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, [*rows, (900, None, None)])
    kept = STAGE["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i in range(200) if i % 3} | {900}


def test_tokenizing_stage_and_run(spark, tmp_path):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = P.bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    done = P.run(spark, str(tmp_path)).collect()
    assert done and {r["doc_id"] for r in done} <= {r[0] for r in rows}
    texts = table(spark, rows)
    got = sorted((r["doc_id"], r["n_tokens"]) for r in STAGE["byte-level BPE encoding and decoding"](spark, texts, None).collect())
    assert got == sorted((i, len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)


def test_tokenizing_stage_hands_workers_few_bytes(spark):
    """The last stage bounds its batches by bytes, whatever the session had, and loses no row."""
    pytest.importorskip("public_tokenizers")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")
    rows = [(i, "word " * 20_000, "a") for i in range(40)]
    got = STAGE["byte-level BPE encoding and decoding"](spark, table(spark, rows), None)
    assert spark.conf.get(name) == f"{P.bpe.BATCH}b"
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(range(40))


def test_tokenizing_stage_keeps_its_tables_out_of_the_plan(spark):
    """The driver keeps the texts of plans: they don't hold the tables of ranks and pieces, and neither do the rows."""
    pytest.importorskip("public_tokenizers")
    done = STAGE["byte-level BPE encoding and decoding"](spark, table(spark, corpus()), None)
    plan = done._jdf.queryExecution()
    texts = [p.toString() for p in (plan.analyzed(), plan.optimizedPlan(), plan.executedPlan())]
    assert max(map(len, texts)) < 100_000
    assert not [t for t in texts[1:] if re.search(r"AS (table|pieces)#", t)] and "scalar-subquery" in texts[1]


def test_decoding_beside_columns_of_the_same_name(spark):
    rows = spark.createDataFrame([(1, [1, 0, 2], "x", 5), (2, None, "y", 6), (3, [9], "z", 7)], "doc_id long, ids array<int>, Pieces string, pieces_ int")
    got = P.bpe.decode(rows, {b"a": 0, b"\xff\x00": 1, b"": 2}).orderBy("doc_id").collect()
    assert [(*r[:1], *r[2:]) for r in got] == [(1, "x", 5, b"\xff\x00a"), (2, "y", 6, b""), (3, "z", 7, b"")]


def test_stages_are_in_order():
    assert [n for n, _ in P.STAGES][0] == "toxicity" and len(P.STAGES) == 5 and toxicity.WINDOW == 16


def test_rows_that_share_an_id_are_mixed_on_their_own(spark):
    r = random.Random(7)
    make = lambda n: " ".join(f"v{r.randrange(10**12)}" for _ in range(n))
    rows = [(i, make(r.randrange(20, 200)), f"s{i % 3}") for i in range(30)]
    rows += [(None, make(n), f"s{n % 3}") for n in (3, 500, 40, 77)] + [(5, make(400), "s0"), (5, make(6), "s1"), (6, rows[6][1], "s0"), (6, rows[6][1], "s0")]
    docs = table(spark, rows)
    words = lambda t: t.split(" ")
    got = [(x["doc_id"], words(x["text"])) for x in STAGE["mixing sources to target weights"](spark, docs, None).collect()]
    plan = collections.Counter()
    for x in P.mix_sources(docs).collect():
        plan[x["doc_id"], x["size"], x["source"]] += x["taken"]
    owner = {w: (i, len(words(t)), s) for i, t, s in rows for w in words(t)}  # every word is of one text
    owner |= {w: (6, len(words(rows[6][1])), "s0") for w in words(rows[6][1])}
    taken = collections.Counter()
    for i, w in got:
        assert w and all(owner[x][0] == i for x in w)
        taken[owner[w[0]]] += len(w)
    assert taken == {k: n for k, n in plan.items() if n}


def test_near_copies_among_null_ids(spark):
    base = [" ".join(f"t{i}x{j}" for j in range(60)) for i in range(4)]
    rows = [(None, base[0], "a"), (None, base[0] + " more", "a"), (1, base[1], "a"), (None, base[1] + " more", "a"), (2, base[2], "a"), (2, base[2] + " more", "a"), (2, base[3], "a"), (None, None, "a"), (None, "", "a")]
    got = sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in STAGE["n-gram Jaccard join"](spark, table(spark, rows), None).collect())
    assert got == [(0, ""), (0, ""), (0, "t0x0"), (1, "t1x0"), (2, "t2x0"), (2, "t3x0")]


def test_stages_bear_columns_named_like_their_own(spark, tmp_path):
    """Columns with the names the stages use themselves stay as they are, through all stages, and so do empty tables."""
    names = ["__row", "__plan", "__taken", "__nth", "__one", "__text", "keep_id", "size", "whole", "part_from", "part_to", "component_key", "key", "score"]
    rows = [(i, t, s) for i, t, s in corpus()]
    docs = table(spark, rows).withColumns({n: P.F.lit(f"own {n}") for n in names})
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in P.STAGES[:-1]:
            if name == "toxicity" and not empty:
                continue  # words say nothing of these labels
            now = P.staged(stage(spark, now, str(tmp_path)), "test")
            assert now.columns == docs.columns
            assert empty == (now.count() == 0) and now.where(" or ".join(f"`{n}` <> 'own {n}'" for n in names)).count() == 0
        assert empty == (P.tokenize(spark, now, str(tmp_path)).count() == 0)


def test_toxicity_stage_against_the_scores(spark, tmp_path):
    """The rows that stay are those that the scored windows, each computed alone, leave below one half."""
    import numpy as np

    r = random.Random(9)
    good, bad = [f"w{i}" for i in range(80)], ["vilewort", "grubling"]
    rows = [(i, " ".join(r.choices(good, k=r.randrange(1, 70)) + r.choices(bad, k=i % 4 == 0)), "s") for i in range(240)] + [(3, "vilewort here", "t"), (None, None, "s"), (900, "", "s"), (901, "w1 " * 5000 + "grubling", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, rows)
    net = toxicity.fit_toxicity(docs, labels)

    def score(text):
        words = (text or "").lower().split()
        starts = range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
        best = -np.inf
        for s in starts:
            part = words[s : s + toxicity.WINDOW]
            gates = np.zeros((1, toxicity.WINDOW, 6 * toxicity.HIDDEN), np.float32)
            if part:
                gates[0, : len(part)] = net.gates(part)
            best = max(best, float(net.run(gates, np.arange(toxicity.WINDOW)[None] < len(part))[0]))
        return 1 / (1 + np.exp(-(net.scale[0] * best + net.scale[1])))

    kept = sorted((x["doc_id"] or -1, x["text"] or "") for x in STAGE["toxicity"](spark, docs, str(tmp_path)).collect())
    assert kept == sorted((i or -1, t or "") for i, t, _ in rows if score(t) < 0.5) and 100 < len(kept) < 240
