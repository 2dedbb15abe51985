"""Reference resolution as joins, and reachability as rounds of a frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graphs import Graph
from ..stages import staged


def definitions(graph: Graph) -> DataFrame:
    """The first definition of each object number: doc_id, object_number, generation, obj_index."""
    first = F.min(F.struct("obj_index", "generation")).alias("first")
    return (
        graph.objects.where("object_number is not null")
        .groupBy("doc_id", "object_number")
        .agg(first)
        .select("doc_id", "object_number", F.col("first.generation").alias("generation"), F.col("first.obj_index").alias("obj_index"))
    )


def duplicate_numbers(graph: Graph) -> DataFrame:
    """Later definitions of a number: doc_id, obj_index, object_number."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "object_number").orderBy("obj_index"))
    rows = graph.objects.where("object_number is not null").withColumn("nth", nth)
    return rows.where("nth > 1").select("doc_id", "obj_index", "object_number")


def reference_uses(graph: Graph) -> DataFrame:
    """Every use of a reference: doc_id, obj_index, path, ref_obj, ref_gen, ref_ok, gen_ok, ref_owner. Root and info have no obj_index."""
    of_nodes = graph.nodes.where("kind = 'reference'").select("doc_id", "obj_index", "path", "ref_obj", "ref_gen", "ref_ok", "gen_ok", "ref_owner")
    d = graph.documents

    def top(name: str, there):
        ref = F.col(name)
        return d.where(there).select(
            "doc_id", F.lit(None).cast("int").alias("obj_index"), F.lit(name).alias("path"), ref["obj"].alias("ref_obj"), ref["gen"].alias("ref_gen"),
            ref["obj"].isNotNull().alias("ref_ok"), ref["gen"].isNotNull().alias("gen_ok"), F.col("owner_id").alias("ref_owner"),
        )

    return of_nodes.unionByName(top("root", F.col("root_ok"))).unionByName(top("info", F.col("info_state") == "reference"))


def resolve(uses: DataFrame, defined: DataFrame) -> DataFrame:
    """``uses`` with the definition of their number (found_gen, found_index), null where there is none."""
    target = defined.select("doc_id", F.col("object_number").alias("ref_obj"), F.col("generation").alias("found_gen"), F.col("obj_index").alias("found_index"))
    return uses.join(target, ["doc_id", "ref_obj"], "left")


def resolve_matching(uses: DataFrame, defined: DataFrame) -> DataFrame:
    """As ``resolve``, by number and generation."""
    target = defined.select("doc_id", F.col("object_number").alias("ref_obj"), F.col("generation").alias("ref_gen"), F.col("obj_index").alias("found_index"))
    return uses.join(target, ["doc_id", "ref_obj", "ref_gen"], "left")


def missing_targets(graph: Graph) -> DataFrame:
    """Uses whose object isn't defined."""
    target = definitions(graph).select("doc_id", F.col("object_number").alias("ref_obj"))
    return reference_uses(graph).join(target, ["doc_id", "ref_obj"], "left_anti").select("doc_id", "path", "ref_obj", "ref_gen")


def generation_mismatches(graph: Graph) -> DataFrame:
    found = resolve(reference_uses(graph), definitions(graph)).where("found_index is not null and not (found_gen <=> ref_gen)")
    return found.select("doc_id", "path", "ref_obj", "ref_gen", "found_gen")


def edges(graph: Graph) -> DataFrame:
    """Distinct edges between defined objects, by number: doc_id, src, dst. Only first definitions count."""
    first = definitions(graph).select("doc_id", "obj_index", F.col("object_number").alias("src"))
    refs = graph.nodes.where("kind = 'reference' and ref_obj is not null").select("doc_id", "obj_index", F.col("ref_obj").alias("dst"))
    known = definitions(graph).select("doc_id", F.col("object_number").alias("dst"))
    return refs.join(first, ["doc_id", "obj_index"]).select("doc_id", "src", "dst").distinct().join(known, ["doc_id", "dst"], "left_semi")


#: Rounds of a frontier before the links that are left are shortened; parts of the visited nodes that are kept apart.
PATIENCE, PARTS = 12, 6


def reachable(start: DataFrame, links: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Nodes (doc_id, n) that can be reached from ``start`` (doc_id, n) over ``links`` (doc_id, src, dst), start included.

    Rounds over a frontier until it is empty. What each round finds is written
    once, as a part of the visited nodes. After ``patience`` rounds the links to
    visited nodes are left out, and where a node then leads to one node only,
    such steps are composed, two, four, eight and so on, into shortcuts: a
    chain takes rounds as the logarithm of its length.
    """
    links = staged(links.select("doc_id", "src", "dst").distinct(), "links")
    parts = [staged(start.select("doc_id", "n").distinct(), "seen")]
    frontier, ways, rounds = parts[0], links, 0

    def seen() -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    while True:
        step = frontier.join(ways.select("doc_id", F.col("src").alias("n"), "dst"), ["doc_id", "n"]).select("doc_id", F.col("dst").alias("n")).distinct()
        frontier = staged(step.join(seen(), ["doc_id", "n"], "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return seen()
        parts.append(frontier)
        if len(parts) > PARTS:
            parts = [staged(seen(), "seen")]
        rounds += 1
        if rounds % patience == 0:
            links = staged(links.join(seen().withColumnRenamed("n", "dst"), ["doc_id", "dst"], "left_anti").select("doc_id", "src", "dst"), "links")
            ways = links.unionByName(shortcuts(links))


def shortcuts(links: DataFrame) -> DataFrame:
    """Compositions of 2, 4, 8 .. links that leave nodes with one link only: doc_id, src, dst."""
    jump = staged(links.groupBy("doc_id", "src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1 and src <> dst").drop("n"), "jump")
    out, reach, most = jump.limit(0), 1, jump.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    while reach < most:
        jump = staged(jump.join(jump.select("doc_id", F.col("src").alias("dst"), F.col("dst").alias("far")), ["doc_id", "dst"]).select("doc_id", "src", F.col("far").alias("dst")), "jump")
        if not jump.limit(1).count():
            break
        out, reach = out.unionByName(jump), 2 * reach
    return out


def reachable_objects(graph: Graph) -> DataFrame:
    """doc_id, object_number of the objects that root or info reach."""
    d = graph.documents
    start = d.where("root_ok").select("doc_id", F.col("root.obj").alias("n")).union(
        d.where("info_state = 'reference'").select("doc_id", F.col("info.obj").alias("n"))
    )
    known = definitions(graph).select("doc_id", F.col("object_number").alias("n"))
    start = start.where("n is not null").join(known, ["doc_id", "n"], "left_semi")
    return reachable(start, edges(graph)).withColumnRenamed("n", "object_number")


def unreachable_objects(graph: Graph) -> DataFrame:
    return definitions(graph).select("doc_id", "object_number").join(reachable_objects(graph), ["doc_id", "object_number"], "left_anti")


def collect_garbage(graph: Graph) -> Graph:
    """The graph without objects that nothing reaches; references of another owner aren't followed."""
    d = graph.documents.select("doc_id", "owner_id")
    own = graph.nodes.join(d, "doc_id").where("kind <> 'reference' or owner_id is null or ref_owner <=> owner_id").drop("owner_id")
    keep = reachable_objects(Graph(graph.documents, graph.objects, own, graph.flags))
    objects = graph.objects.join(keep, ["doc_id", "object_number"], "left_semi")
    kept = objects.select("doc_id", "obj_index")
    return Graph(graph.documents, objects, graph.nodes.join(kept, ["doc_id", "obj_index"], "left_semi"), graph.flags)


def assert_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (doc_id, owner_id, ...) whose owner isn't that of the document."""
    return rows.join(owners.select("doc_id", F.col("owner_id").alias("doc_owner")), "doc_id").where("not (owner_id <=> doc_owner)")
