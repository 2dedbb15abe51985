"""Helpers shared by the operators: staged tables and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests), and
    an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended first
        pass


def staged(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    ``few``: the rows are few beside the input; an eighth as many files as there are shuffle partitions hold them.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` whose tasks read the same rows in the same order each time: as it is if it only scans, else staged."""
    return staged(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def drop_staged(df: DataFrame) -> None:
    """Remove the files behind a staged table that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def small_batches(df: DataFrame, rows: int = 1024, size: int = 0) -> DataFrame:
    """``df``, whose session hands Python workers at most so many rows at once: texts may be long, and a worker holds a batch.

    ``size``: no more rows than pass so many bytes, either; a row is never cut. 0 leaves that as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size and not 0 < df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) <= size:
        conf.set(name, f"{size}b")
    return df


def release() -> None:
    """Hand what this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run):
    """``run`` (batches to batches) for a worker that Spark keeps: what earlier tasks freed goes back to the system before it
    and what it freed behind it, as idle workers stand beside those of the next steps."""

    def kept(batches):
        release()
        yield from run(batches)
        release()

    return kept


def _bit(table: bytes, bits: int, key: Column) -> Column:
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.unhex(F.lit(table.hex())), (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), F.pmod(slot, F.lit(8)).cast("int")) == 1


def bit_filter(keys: DataFrame, most: int) -> Callable[[Column], Column]:
    """Tells of a key whether ``keys`` (one long column) may hold it, by a table of eight bits a key, ``most`` bits at most:
    what is broadcast is bounded, and a fuller table only lets more keys through."""
    (name,) = keys.columns
    bits = min(most, max(1 << 13, 1 << (8 * keys.count()).bit_length()))
    slots = keys.select(F.pmod(F.xxhash64(name), F.lit(bits)).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(32)).cast("int"))
    table = bytearray(bits // 8)
    packed = slots.groupBy(F.floor(F.col("slot") / 32).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    words = np.frombuffer(table, "<u4")
    words[packed["w"].to_numpy()] = packed["b"].to_numpy().astype("<u4")
    return lambda key: _bit(bytes(table), bits, key)


def fit_in_task(rows: DataFrame, fit):
    """What ``fit`` makes of all ``rows`` (a bounded sample), sorted: run by one task, so that the driver holds the result only.

    None for no rows.
    """
    names = rows.columns

    def run(batches):
        import pickle

        held = [r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names), strict=True)]
        if held:
            yield pa.record_batch([pa.array([pickle.dumps(fit(sorted(held)))], pa.binary())], ["made"])

    made = rows.repartition(1).mapInArrow(run, "made binary").collect()
    import pickle

    return pickle.loads(made[0]["made"]) if made else None


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = int(planes.any(1).nonzero()[0].max(initial=-1)) + 1
    head = len(numbers).to_bytes(8, "little") + bytes([used])
    return head + (pa.compress(planes[:used].tobytes(), codec="zstd", asbytes=True) if used else b"")


def unpack(blob: bytes) -> np.ndarray:
    n, used = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.zeros((8, n), np.uint8)
    if used:
        planes[:used] = np.frombuffer(pa.decompress(blob[9:], decompressed_size=n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_rising(names: np.ndarray) -> bytes:
    return pack(np.diff(names, prepend=np.uint64(0)))


def unpack_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a long, b long).

    Rounds over staged tables until nothing changes: each node takes the
    smallest label that it, its label or a neighbour's label has, and hands it
    to the node that was its label, so that whole trees move at once and the
    rounds grow with the logarithm of a chain. Nothing but a count of changed
    rows reaches the driver. Repeated edges and loops do no harm; an empty table
    gives an empty result (node long, component long).
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
        few=True,
    )
    first = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", few=True)

    def with_far(labels):  # the label of each node's label
        return labels.join(labels.select(F.col("node").alias("component"), F.col("component").alias("far")), "component")

    labels = staged(with_far(first).select("node", "component", "far"), "labels", few=True)
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "far"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("far").alias("near"))
        )
        seen = labels.join(around, "node")
        own = seen.select("node", F.least("near", "far").alias("to"), F.col("component").alias("old"))
        hooked = seen.select(F.col("component").alias("node"), F.col("near").alias("to"), F.lit(None).cast("long").alias("old"))
        step = own.union(hooked).groupBy("node").agg(F.least(F.min("to"), F.max("old")).alias("component"), F.max("old").alias("old"))
        step = staged(step, "labels", few=True)
        if not step.where("old <> component").limit(1).count():
            return step.select("node", "component")
        labels = staged(with_far(step.select("node", "component")).select("node", "component", "far"), "labels", few=True)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts`` (n long, one row per key): those not below the smallest count that leaves no more.

    Only how many keys have each count reaches the driver, until ``most`` is passed.
    """
    total, least = 0, None
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("n"))
    for r in sizes.limit(most + 1).toLocalIterator():
        total += r["keys"]
        if total > most:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
