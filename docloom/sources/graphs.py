"""Document object graphs as tables: from Python literals, from a builder, and from Parquet."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = (
    "doc_id string, version string, root struct<obj:bigint,gen:int>, root_ok boolean, info struct<obj:bigint,gen:int>,"
    " info_state string, id array<binary>, id_state string, owner_id string"
)
OBJECTS = "doc_id string, obj_index int, object_number bigint, generation int, generation_ok boolean"
NODES = (
    "doc_id string, obj_index int, node_id int, parent_node int, depth int, ord int, entry_side string, key_kind string,"
    " key_text string, key_bytes binary, path string, kind string, bool_val boolean, num_val double, text_val string,"
    " bytes_val binary, ref_obj bigint, ref_gen int, ref_ok boolean, gen_ok boolean, ref_owner string"
)
FLAGS = "doc_id string, obj_index int, code string, path string, message string"


@dataclass(frozen=True)
class Graph:
    """Tables of many documents. ``flags`` holds what could not be put into rows, such as a dictionary without entries."""

    documents: DataFrame
    objects: DataFrame
    nodes: DataFrame
    flags: DataFrame

    def write(self, path: str) -> None:
        for name in ("documents", "objects", "nodes", "flags"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> Graph:
    kinds = {"documents": DOCUMENTS, "objects": OBJECTS, "nodes": NODES, "flags": FLAGS}
    return Graph(**{n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in kinds.items()})


UNSET = object()


@dataclass(frozen=True)
class Name:
    value: Any


@dataclass(frozen=True)
class ByteName:
    value: Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Hex:
    value: Any


@dataclass(frozen=True)
class Ref:
    number: Any
    generation: Any = 0
    owner: str | None = None


@dataclass(frozen=True)
class Dict:
    """Text keys in insertion order, and pairs whose key is a Name or ByteName."""

    entries: Any = field(default_factory=dict)
    byte_entries: Any = None


@dataclass(frozen=True)
class Stream:
    entries: Any = field(default_factory=dict)
    data: Any = b""
    byte_entries: Any = None


@dataclass(frozen=True)
class Obj:
    number: Any
    value: Any
    generation: Any = 0


@dataclass(frozen=True)
class Document:
    root: Any
    objects: Any
    version: Any = "1.7"
    info: Any = UNSET
    id: Any = UNSET
    owner: str | None = None


def key_order(entries: dict) -> list[tuple[str, Any]]:
    """Keys that are array indexes first, ascending, then the others as inserted."""
    index = lambda k: k.isdecimal() and k.isascii() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1
    return sorted(((k, v) for k, v in entries.items() if index(k)), key=lambda x: int(x[0])) + [
        (k, v) for k, v in entries.items() if not index(k)
    ]


def _whole(v: Any, low: int, high: int) -> int | None:
    ok = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v == int(v) and low <= v <= high
    return int(v) if ok else None


class _Flattener:
    def __init__(self, doc_id: str):
        self.doc, self.nodes, self.flags, self.next, self.obj = doc_id, [], [], 0, 0

    def flag(self, code: str, path: str, message: str) -> None:
        self.flags.append((self.doc, self.obj, code, path, message))

    def add(self, value: Any, path: str, parent: int | None = None, depth: int = 0, ord_: int = 0, side=None, key=(None, None, None), open_=()):
        row = dict.fromkeys("kind bool_val num_val text_val bytes_val ref_obj ref_gen ref_ok gen_ok ref_owner".split())
        children: list = []
        if isinstance(value, (Dict, Stream, list)) and any(value is o for o in open_):
            self.flag("direct-object-cycle", path, "A direct object contains itself")
            return
        if value is UNSET:
            row["kind"] = "undefined"
        elif value is None:
            row["kind"] = "null"
        elif isinstance(value, bool):
            row |= {"kind": "boolean", "bool_val": value}
        elif isinstance(value, (int, float)):
            row |= {"kind": "number", "num_val": float(value)}
        elif isinstance(value, Name):
            row |= {"kind": "name", "text_val": value.value if isinstance(value.value, str) else None}
        elif isinstance(value, ByteName):
            row |= {"kind": "byte-name", "bytes_val": bytes(value.value) if isinstance(value.value, (bytes, bytearray)) else None}
        elif isinstance(value, (Literal, Hex)):
            ok = isinstance(value.value, (bytes, bytearray))
            row |= {"kind": "literal-string" if isinstance(value, Literal) else "hex-string", "bytes_val": bytes(value.value) if ok else None}
        elif isinstance(value, Ref):
            n, g = _whole(value.number, 1, 9_999_999_999), _whole(value.generation, 0, 65_534)
            row |= {"kind": "reference", "ref_obj": n, "ref_gen": g, "ref_ok": n is not None, "gen_ok": g is not None, "ref_owner": value.owner}
        elif isinstance(value, list):
            row["kind"] = "array"
            children = [(v, f"{path}[{i}]", None, ("index", None, None)) for i, v in enumerate(value)]
        elif isinstance(value, (Dict, Stream)):
            row["kind"] = "dictionary" if isinstance(value, Dict) else "stream"
            if isinstance(value, Stream):
                row["bytes_val"] = bytes(value.data) if isinstance(value.data, (bytes, bytearray)) else None
            if not isinstance(value.entries, dict):
                self.flag("invalid-dictionary", f"{path}.entries", "A dictionary needs a record of entries")
            else:
                children = [(v, f"{path}.{k}", "entries", ("name", k, None)) for k, v in key_order(value.entries)]
                if value.byte_entries is not None and not isinstance(value.byte_entries, (list, tuple)):
                    self.flag("invalid-dictionary", f"{path}.byteEntries", "Byte entries must be a list")
                for i, e in enumerate(value.byte_entries if isinstance(value.byte_entries, (list, tuple)) else ()):
                    at = f"{path}.byteEntries[{i}]"
                    if not isinstance(e, (list, tuple)) or len(e) != 2:
                        self.flag("invalid-dictionary", at, "A byte entry must be a pair")
                        continue
                    k = e[0]
                    if isinstance(k, Name):
                        key = ("name", k.value if isinstance(k.value, str) else None, None)
                    elif isinstance(k, ByteName):
                        key = ("byte-name", None, bytes(k.value) if isinstance(k.value, (bytes, bytearray)) else None)
                    else:
                        key = ("unknown", None, None)
                    children.append((e[1], f"{at}.value", "byteEntries", key))
        else:
            row["kind"] = "unknown"
        me = self.next
        self.next += 1
        head = (self.doc, self.obj, me, parent, depth, ord_, side, *(key if parent is not None else (None, None, None)), path)
        self.nodes.append((*head, *row.values()))
        for i, (v, p, s, k) in enumerate(children):
            self.add(v, p, me, depth + 1, i, s, k, (*open_, value))


def graph_from_literals(spark: SparkSession, docs: dict[str, Document]) -> Graph:
    """Tables of documents given as Python values. Malformed values become flags or rows that the validator reports."""
    rows: dict[str, list] = {"documents": [], "objects": [], "nodes": [], "flags": []}
    for doc_id, d in docs.items():
        f = _Flattener(doc_id)
        ref = lambda r: (_whole(r.number, 1, 9_999_999_999), _whole(r.generation, 0, 65_534)) if isinstance(r, Ref) else None
        info_state = "absent" if d.info is UNSET else "reference" if isinstance(d.info, Ref) else "bad"
        pair = isinstance(d.id, (list, tuple)) and len(d.id) == 2 and all(isinstance(x, Hex) for x in d.id)
        id_state = "absent" if d.id is UNSET else "pair" if pair else "bad"
        ids = [bytes(x.value) if isinstance(x.value, (bytes, bytearray)) else None for x in d.id] if pair else None
        rows["documents"].append(
            (doc_id, d.version if isinstance(d.version, str) else None, ref(d.root), isinstance(d.root, Ref), ref(d.info), info_state, ids, id_state, d.owner)
        )
        if not isinstance(d.objects, (list, tuple)):
            f.flag("invalid-object", "objects", "The objects of a document must be a list")
        for i, o in enumerate(d.objects if isinstance(d.objects, (list, tuple)) else ()):
            f.obj, f.next = i, 0
            if not isinstance(o, Obj):
                f.flag("invalid-object", f"objects[{i}]", "An indirect object is needed")
                continue
            n = _whole(o.number, 1, 9_999_999_999)
            g = _whole(o.generation, 0, 65_534)
            rows["objects"].append((doc_id, i, n, g, g is not None))
            if n is not None:  # the value of an object without a number is not looked at
                f.add(o.value, f"objects[{i}].value")
        rows["nodes"] += f.nodes
        rows["flags"] += f.flags
    kinds = {"documents": DOCUMENTS, "objects": OBJECTS, "nodes": NODES, "flags": FLAGS}
    return Graph(**{n: spark.createDataFrame(rows[n], s) for n, s in kinds.items()})


def number_objects(created: DataFrame) -> DataFrame:
    """Object numbers from 1 in the order of creation: ``created`` (doc_id, handle, creation_ord, ...)."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("creation_ord")
    return created.withColumn("object_number", F.row_number().over(order).cast("long")).withColumn("generation", F.lit(0))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder: path relative to it, and bytes. A folder that isn't there has no files."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return spark.createDataFrame([], "path string, bytes binary")
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.expr(f"substring(path, {len(base) + 1})").alias("path"), F.col("content").alias("bytes"))
