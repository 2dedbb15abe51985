"""All structural rules as filters that give diagnostic rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.graphs import Graph
from ..stages import staged
from .page_tree import page_tree_diagnostics
from .references import definitions, duplicate_numbers, reference_uses, resolve, unreachable_objects
from .serialize import MAX_GAPS, key_bytes

COLUMNS = ["doc_id", "severity", "code", "path", "message", "related", "phase", "place"]
RELATED = "array<struct<path:string,message:string>>"


class InvalidGraph(ValueError):
    """Raised for errors; ``diagnostics`` holds them as a table."""

    def __init__(self, diagnostics: DataFrame, first: list):
        self.diagnostics = diagnostics
        super().__init__(first[0]["message"] if len(first) == 1 else "The documents have several errors")


def _rows(df: DataFrame, code: str | Column, path: Column, message: str, phase: int, place: Column | None = None, severity: str = "error") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    place = F.lit("") if place is None else place
    return df.select(
        "doc_id", F.lit(severity).alias("severity"), code.alias("code"), path.alias("path"), F.lit(message).alias("message"),
        F.lit(None).cast(RELATED).alias("related"), F.lit(phase).alias("phase"), place.alias("place"),
    )


def _apply(df: DataFrame, rules: list[tuple], phase: int, place: Column | None = None) -> DataFrame:
    """Diagnostics of all ``rules`` (condition, code, path, message) in one pass over the rows."""
    kind = "struct<code:string,path:string,message:string>"
    one = lambda code, path, message: F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(message).alias("message"))
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), one(code, path, message)).cast(kind) for when, code, path, message in rules])
    place = F.lit("") if place is None else place
    hits = df.select("doc_id", place.alias("place"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d"))
    return hits.select(
        "doc_id", F.lit("error").alias("severity"), "d.code", "d.path", "d.message", F.lit(None).cast(RELATED).alias("related"), F.lit(phase).alias("phase"), "place"
    )


def document_rules(graph: Graph) -> DataFrame:
    """Version, root, info and ID."""
    d = graph.documents
    short = F.exists("id", lambda x: F.coalesce(F.octet_length(x) < 16, F.lit(False)))
    known = F.forall("id", lambda x: x.isNotNull())
    out = _rows(d.where(~F.coalesce(F.col("version").isin(S.VERSIONS), F.lit(False))), "invalid-version", F.lit("version"), "Not a known version", 0)
    rules = [
        (~F.col("root_ok"), "invalid-root", "root", "The root must be a reference"),
        (F.col("info_state") == "bad", "invalid-reference", "info", "Info must be a reference"),
        (F.col("id_state") == "bad", "invalid-document-id", "id", "An ID is two hexadecimal strings"),
        ((F.col("version") == "2.0") & (F.col("id_state") == "absent"), "invalid-document-id", "id", "Version 2.0 needs an ID"),
        ((F.col("version") == "2.0") & (F.col("id_state") == "pair") & known & short, "invalid-document-id", "id", "In version 2.0 both parts have 16 bytes at least"),
        ((F.col("version") == "1.0") & (F.col("id_state") != "absent"), "unsupported-version-feature", "id", "Version 1.0 has no ID"),
    ]
    out = out.unionByName(_apply(d, [(w, c, F.lit(p), m) for w, c, p, m in rules], 3))
    parts = d.where("id_state = 'pair'").select("doc_id", F.posexplode("id").alias("i", "b")).where("b is null")
    return out.unionByName(_rows(parts, "invalid-byte-string", F.concat(F.lit("id["), "i", F.lit("].bytes")), "A string needs bytes", 3))


def object_rules(graph: Graph) -> DataFrame:
    """Numbers, generations, later definitions, gaps."""
    o = graph.objects
    at = F.concat(F.lit("objects["), "obj_index", F.lit("]"))
    place = F.lpad(F.col("obj_index").cast("string"), 10, "0")
    out = _rows(o.where("object_number is null"), "invalid-object-number", F.concat(at, F.lit(".objectNumber")), "Not an object number", 1, place)
    bad = o.where("object_number is not null and not generation_ok")
    out = out.unionByName(_rows(bad, "invalid-generation-number", F.concat(at, F.lit(".generation")), "Not a generation", 1, place))
    out = out.unionByName(_rows(duplicate_numbers(graph), "duplicate-object-number", F.concat(at, F.lit(".objectNumber")), "The number is taken", 1, place))
    size = definitions(graph).groupBy("doc_id").agg(F.max("object_number").alias("top"), F.count(F.lit(1)).alias("n"))
    out = out.unionByName(_rows(size.where(F.col("top") - F.col("n") > MAX_GAPS), "excessive-xref-gaps", F.lit("objects"), "More than a million numbers are unused", 2))
    return out.unionByName(_rows(graph.flags, F.col("code"), F.col("path"), "The value has not the right shape", 1))


def value_rules(graph: Graph) -> DataFrame:
    """Names, numbers, strings, streams and dictionary keys, anywhere in a value."""
    versions = graph.documents.select("doc_id", F.col("version").isin("1.0", "1.1").alias("old"))
    n = graph.nodes.join(versions, "doc_id")
    place = F.concat(F.lpad(F.col("obj_index").cast("string"), 10, "0"), F.lpad(F.col("node_id").cast("string"), 10, "0"))
    path = F.col("path")
    entry = F.regexp_replace(path, r"\.value\z", "")
    kind = F.col("kind")
    name_ok = F.when(kind == "name", S.is_name("text_val")).otherwise(S.is_name_bytes("bytes_val"))
    value_name = F.coalesce("bytes_val", F.encode("text_val", "UTF-8"))
    escaped = lambda b: F.coalesce(F.contains(S.pdf_name(b), F.lit("#")), F.lit(False))
    is_name_value = kind.isin("name", "byte-name")
    side, key_kind = F.col("entry_side"), F.col("key_kind")
    key_ok = F.when(key_kind == "name", S.is_name("key_text")).when(key_kind == "byte-name", S.is_name_bytes("key_bytes")).otherwise(False)
    is_key = side.isNotNull()
    wide = ~S.is_finite("num_val") | ((F.col("num_val") == F.rint("num_val")) & ~S.is_safe_integer("num_val"))
    key_path = F.when(side == "byteEntries", F.concat(entry, F.lit(".key"))).otherwise(path)
    rules = [
        ((kind == "number") & wide, "invalid-number", path, "Not finite, or an integer that a double can't hold"),
        ((kind == "stream") & F.col("parent_node").isNotNull(), "stream-must-be-indirect", path, "A stream must be an object of its own"),
        (is_name_value & ~name_ok, "invalid-name", path, "A name needs characters, none of them NUL"),
        (is_name_value & name_ok & F.col("old") & escaped(value_name), "unsupported-version-feature", path, "Escaped names need version 1.2"),
        ((side == "entries") & ~key_ok, "invalid-dictionary-key", path, "A key needs characters, none of them NUL"),
        ((side == "byteEntries") & ~key_ok, "invalid-name", F.concat(entry, F.lit(".key")), "A key needs bytes, none of them zero"),
        (is_key & key_ok & F.col("old") & escaped(key_bytes()), "unsupported-version-feature", key_path, "Escaped names need version 1.2"),
        (kind.isin("literal-string", "hex-string") & F.col("bytes_val").isNull(), "invalid-byte-string", F.concat(path, F.lit(".bytes")), "A string needs bytes"),
        ((kind == "stream") & F.col("bytes_val").isNull(), "invalid-stream", F.concat(path, F.lit(".data")), "A stream needs bytes"),
        (kind == "unknown", "invalid-object", path, "Not a value"),
    ]
    out = _apply(n, rules, 1, place)
    ids = ["doc_id", "obj_index"]
    keys = graph.nodes.where("entry_side is not null").withColumn("name", S.pdf_name(key_bytes())).where("name is not null")
    nth = F.row_number().over(Window.partitionBy(*ids, "parent_node", "name").orderBy(F.desc("entry_side"), "ord"))
    twice = keys.withColumn("nth", nth).where("nth > 1 and entry_side = 'byteEntries'")
    out = out.unionByName(_rows(twice, "duplicate-dictionary-key", entry, "The key is there already", 1, place))
    streams = graph.nodes.where("kind = 'stream'").select(*ids, F.col("node_id").alias("parent_node"), F.col("path").alias("stream_path"))
    sized = keys.where((F.col("key_text") == "Length") | (F.col("name") == "/Length")).join(streams, [*ids, "parent_node"])
    sized = sized.select(*ids, "entry_side", "stream_path", "node_id").dropDuplicates([*ids, "stream_path", "entry_side"])
    return out.unionByName(_rows(sized, "stream-length-is-derived", F.concat("stream_path", F.lit(".Length")), "Length is written by the serializer", 1, place))


def reference_rules(graph: Graph) -> DataFrame:
    """Ranges, owners, missing targets and generations of every use of a reference."""
    uses = reference_uses(graph).join(graph.documents.select("doc_id", "owner_id"), "doc_id")
    place = F.coalesce(F.lpad(F.col("obj_index").cast("string"), 10, "0"), F.lit("~"))
    path = F.col("path")
    ranges = [
        (~F.col("ref_ok"), "invalid-object-number", F.concat(path, F.lit(".objectNumber")), "Not an object number"),
        (~F.col("gen_ok"), "invalid-generation-number", F.concat(path, F.lit(".generation")), "Not a generation"),
        (F.col("owner_id").isNotNull() & ~F.col("ref_owner").eqNullSafe(F.col("owner_id")), "foreign-reference", path, "The reference is another builder's"),
    ]
    found = resolve(uses, definitions(graph))
    lost = F.col("found_index").isNull()
    targets = [
        (lost, "invalid-reference", path, "There is no such object"),
        (~lost & ~F.col("found_gen").eqNullSafe(F.col("ref_gen")), "reference-generation-mismatch", path, "The object has another generation"),
    ]
    return _apply(uses, ranges, 1, place).unionByName(_apply(found, targets, 4, place))


def info_rules(graph: Graph) -> DataFrame:
    """Info must be a dictionary of text strings, dates and Trapped."""
    d = graph.documents.where("info_state = 'reference'").select("doc_id", F.col("info.obj").alias("object_number"), F.col("info.gen").alias("generation"), "version")
    target = d.join(definitions(graph), ["doc_id", "object_number", "generation"])
    nodes = graph.nodes.join(target.select("doc_id", "obj_index", "version"), ["doc_id", "obj_index"])
    out = _rows(nodes.where("parent_node is null and kind <> 'dictionary'"), "incorrect-reference-target", F.lit("info"), "Info must be a dictionary", 5)
    whole = nodes.where("parent_node is null and kind = 'dictionary'").select("doc_id", "obj_index")
    entries = nodes.where("depth = 1 and entry_side is not null and not (entry_side = 'entries' and kind = 'undefined')").join(whole, ["doc_id", "obj_index"], "left_semi")
    serialized = F.expr("substring(name, 2)")
    entries = entries.withColumn("name", S.pdf_name(key_bytes()))
    key = F.when(F.col("entry_side") == "entries", F.col("key_text")).otherwise(serialized)
    entries = entries.withColumn("key", key).where("key is not null")
    path = F.when(F.col("entry_side") == "entries", F.concat(F.lit("info."), "key")).otherwise(
        F.concat(F.lit("info."), F.regexp_extract("path", r"(byteEntries\[[0-9]+\]\.value)\z", 1))
    )
    is_text = F.col("kind").isin("literal-string", "hex-string") & F.col("bytes_val").isNotNull()
    trapped = F.col("key") == "Trapped"
    dated = F.col("key").isin("CreationDate", "ModDate")
    fine = (
        F.when(trapped, (F.col("kind") == "name") & F.coalesce(F.col("text_val").isin("True", "False", "Unknown"), F.lit(False)))
        .when(~is_text, F.lit(False))
        .when(dated, S.valid_date("bytes_val"))
        .otherwise(S.valid_unicode_encoding("bytes_val"))
    )
    out = out.unionByName(_rows(entries.where(~fine), "invalid-info", path, "Not what Info may hold under this key", 5))
    early = fine & is_text & ~trapped & ~dated & F.col("version").isin("1.0", "1.1") & F.hex("bytes_val").startswith("FEFF")
    return out.unionByName(_rows(entries.where(early), "unsupported-version-feature", path, "Unicode text needs version 1.2", 5))


def reachability_rules(graph: Graph) -> DataFrame:
    lost = unreachable_objects(graph)
    number = F.col("object_number").cast("string")
    return _rows(lost, "unreachable-object", F.concat(F.lit("object "), number), "Nothing leads to the object from root or info", 7, F.lpad(number, 10, "0"), "warning")


def validate(graph: Graph) -> DataFrame:
    """Diagnostics of all documents: doc_id, severity, code, path, message, related, and phase and place to sort by."""
    tree = page_tree_diagnostics(graph).withColumn("severity", F.lit("error")).select(*COLUMNS)
    parts = [document_rules(graph), object_rules(graph), value_rules(graph), reference_rules(graph), info_rules(graph), tree, reachability_rules(graph)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_valid(graph: Graph) -> DataFrame:
    """The diagnostics, if none is an error; else InvalidGraph."""
    found = staged(validate(graph), "diagnostics")
    first = found.where("severity = 'error'").limit(2).collect()
    if first:
        raise InvalidGraph(found, first)
    return found


def error_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
