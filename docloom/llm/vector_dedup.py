"""Near-duplicate vectors by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged

#: Projections, recall aimed at per pair, rows of a block.
PROJECTIONS = 48
RECALL = 0.999
BLOCK = 2048
#: Projections whose collisions are counted for all pairs of a block, and rows counted at once.
DENSE, SLAB = 24, 64


def calibrate(cosine: float, projections: int = PROJECTIONS, recall: float = RECALL) -> tuple[float, int]:
    """Window half-width and least number of collisions for pairs at the threshold.

    Two unit vectors at this cosine lie ``gap`` apart, so a Gaussian projection
    puts them N(0, gap) apart. The window is two deviations; the count is the
    largest that a pair at the threshold still reaches with the wanted recall
    (nearer pairs reach it more surely).
    """
    gap = math.sqrt(max(0.0, 2 - 2 * cosine))
    hit = math.erf(2 / math.sqrt(2))
    tail, least = 0.0, 0
    while least < projections:
        tail += math.comb(projections, least) * hit**least * (1 - hit) ** (projections - least)
        if tail > 1 - recall:
            break
        least += 1
    return 2 * gap + 1e-9, max(1, least)


def directions(dim: int, projections: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def _compare(cosine: float, projections: int, recall: float):
    """Candidate pairs of two blocks of one label, in any order."""
    width, least = calibrate(cosine, projections, recall)
    spare = projections - least

    def run(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.stack(d["unit"].to_numpy()).astype(np.float64) for d in (left, right))
        if x.shape[1] == 0:
            return np.empty(0, int), np.empty(0, int)
        lines = directions(x.shape[1], projections)
        px, py = x @ lines, y @ lines
        kind = np.uint16 if len(y) < 1 << 16 else np.uint32
        # where each row of y stands in each sorted projection, and the window that each row of x has there
        order = np.argsort(py, axis=0, kind="stable")
        place = np.empty(order.shape, kind)
        np.put_along_axis(place, order, np.arange(len(y), dtype=kind)[:, None], axis=0)
        place = np.ascontiguousarray(place.T)
        low, wide = np.empty((projections, len(x), 1), kind), np.empty((projections, len(x), 1), kind)
        for k in range(projections):
            sorted_ = py[order[:, k], k]
            lo, hi = np.searchsorted(sorted_, px[:, k] - width), np.searchsorted(sorted_, px[:, k] + width, "right")
            low[k, :, 0], wide[k, :, 0] = lo, hi - lo
        first = min(projections, DENSE)
        found_i, found_j = [np.empty(0, int)], [np.empty(0, int)]
        for s in range(0, len(x), SLAB):
            met = np.zeros((min(SLAB, len(x) - s), len(y)), np.uint8)
            for k in range(first):  # a place below the window wraps around, beyond its end
                met += (place[k] - low[k, s : s + SLAB] < wide[k, s : s + SLAB]).view(np.uint8)
            i, j = np.nonzero(met >= max(0, first - spare))
            # the others are counted for what is left, leaving pairs once they can't reach the count
            missed, i = first - met[i, j].astype(np.int64), i + s
            for k in range(first, projections):
                missed += place[k, j] - low[k, i, 0] >= wide[k, i, 0]
                live = missed <= spare
                i, j, missed = i[live], j[live], missed[live]
            found_i.append(i)
            found_j.append(j)
        return np.concatenate(found_i), np.concatenate(found_j)

    return run


def vector_components(
    vectors: DataFrame, cosine: float = 0.93, projections: int = PROJECTIONS, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared only if their labels are equal and not null, by cosine in
    double precision; a pair links at ``cosine`` or more. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing;
    so do vectors of different lengths. Equal vectors are one node with a
    count. Rows that repeat a vec_id count as other vectors and share its
    component if equal. Other columns are ignored; no rows give no rows.

    Candidates are pairs whose projections fall into each other's windows
    often enough (``calibrate``); each is verified. The distinct vectors of a
    label are dealt evenly into blocks of about ``block``, so that a large
    label is many tasks; blocks meet in pairs, in a task each, which sorts the
    projections and reads them in windows. A window holds about half of all
    vectors of a label, so cutting blocks by ranges of a projection would spare
    less than it costs to repeat for the projections that a pair may miss: work
    and shuffle grow with the square of a label's distinct vectors. Only links,
    with the sizes of the nodes, leave a task.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("e")
    ).withColumn(
        "sound",
        F.coalesce(
            F.col("label").isNotNull()
            & (F.size("e") > 0)
            & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("e", lambda v: v != 0),
            F.lit(False),
        ),
    )
    # equal vectors share a node, named by a 64-bit hash of label and components
    rows = staged(rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("label", "e"))), "vectors")
    sound = rows.where("sound")
    nodes = staged(
        sound.groupBy("node", "label", F.size("e").alias("dim")).agg(
            F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("e").alias("e")
        ),
        "nodes",
    )
    run = _compare(cosine, projections, recall)

    def scale(batches):
        for d in batches:
            d = d.reset_index(drop=True)
            units = []
            for e in d["e"]:
                v = np.asarray(e, np.float64)
                v = v / np.abs(v).max()  # keeps very large and very small components in range
                units.append(v / np.sqrt(v @ v))
            yield pd.DataFrame({"node": d["node"], "copies": d["copies"], "label": d["label"], "dim": d["dim"], "bins": d["bins"], "unit": units})

    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("bins"))
    units = staged(
        nodes.join(sizes, ["label", "dim"]).select("node", "copies", "label", "dim", "bins", "e").mapInPandas(
            scale, f"node long, copies long, label {nodes.schema['label'].dataType.simpleString()}, dim int, bins int, unit array<double>"
        ),
        "units",
    )
    other = F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("other")
    bin_ = F.pmod("node", F.col("bins")).cast("int").alias("bin")  # any even dealing is right: blocks of a label meet in full
    dealt = units.select("*", bin_, other).select(
        "node", "copies", "unit", "label", "dim", F.least("bin", "other").alias("a"), F.greatest("bin", "other").alias("b"), "bin"
    )

    def meet(d: pd.DataFrame) -> pd.DataFrame:
        a, b = int(d["a"].iloc[0]), int(d["b"].iloc[0])
        left = d[d["bin"] == a].reset_index(drop=True)
        right = left if a == b else d[d["bin"] == b].reset_index(drop=True)
        out = {"a": [], "b": [], "ca": [], "cb": []}
        if len(left) and len(right):
            i, j = run(left, right)
            if a == b:
                i, j = i[i < j], j[i < j]
            x, y = (np.stack(q["unit"].to_numpy()) for q in (left, right))
            near = np.empty(len(i), bool)
            for s in range(0, len(i), 65536):
                near[s : s + 65536] = np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) >= cosine
            i, j = i[near], j[near]
            out = {"a": left["node"].to_numpy()[i], "b": right["node"].to_numpy()[j], "ca": left["copies"].to_numpy()[i], "cb": right["copies"].to_numpy()[j]}
        # per block only sums of links and a spanning forest leave, not every pair
        return _summary(out)

    summary = staged(
        dealt.groupBy("label", "dim", "a", "b").applyInPandas(meet, "node long, links long, other long"), "summary"
    )
    degree = summary.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    edges = summary.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = connected_components(edges)
    named = (
        nodes.select("node", "least", "copies")
        .join(labels, "node", "left")
        .join(degree, "node", "left")
        .select("node", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    named = staged(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = staged(named.join(least, "component").select("node", "n_links", "component_id"), "found")
    out = sound.select("vec_id", "node").join(found, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _summary(out: dict) -> pd.DataFrame:
    """Links per node, and a forest that joins what the pairs join."""
    a, b = np.asarray(out["a"], np.int64), np.asarray(out["b"], np.int64)
    ca, cb = np.asarray(out["ca"], np.int64), np.asarray(out["cb"], np.int64)
    ends, inverse = np.unique(np.r_[a, b], return_inverse=True)
    links = np.bincount(inverse, weights=np.r_[cb, ca], minlength=len(ends)).astype(np.int64)
    parent = list(range(len(ends)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    forest = []
    for i, j in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((ends[i], ends[j]))
    node = np.r_[ends, np.array([f[0] for f in forest], np.int64)]
    return pd.DataFrame(
        {
            "node": node,
            "links": np.r_[links, np.zeros(len(forest), np.int64)],
            "other": pd.array([None] * len(ends) + [int(f[1]) for f in forest], dtype="Int64"),
        }
    )
