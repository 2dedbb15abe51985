"""The page tree: inheritance and counts by rounds over levels, and a depth-first walk for documents whose tree isn't one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.graphs import Graph
from ..stages import staged
from .references import definitions

FOUND = "doc_id string, code string, path string, message string, related array<struct<path:string,message:string>>, phase int, place string"
REF = "struct<obj:bigint,gen:int>"


def typed_view(graph: Graph) -> DataFrame:
    """A row per defined object with what the page tree needs of its value.

    kind, type, parent (reference, or null), has_parent, kids and contents
    (arrays of the references or nulls, or null if not an array), states of
    MediaBox and Rotate (absent, good, bad), of Resources and of a single
    Contents (absent, dictionary, reference, bad), and Count.
    """
    first = definitions(graph)
    nodes = graph.nodes.join(first, ["doc_id", "obj_index"], "left_semi")
    ids = ["doc_id", "obj_index"]
    root = nodes.where("parent_node is null").select(*ids, F.col("node_id").alias("root"), "kind")
    own = nodes.where("entry_side = 'entries' and depth = 1").select(*ids, "node_id", "key_text", F.col("kind").alias("k"), "text_val", "num_val", "ref_obj", "ref_gen")
    own = own.where(F.col("key_text").isin("Type", "Parent", "Kids", "Count", "MediaBox", "Resources", "Rotate", "Contents", "Pages"))
    ref = F.when(F.col("kind") == "reference", F.struct(F.col("ref_obj").alias("obj"), F.col("ref_gen").alias("gen")))
    items = nodes.where("key_kind = 'index' and depth = 2").groupBy(*ids, F.col("parent_node").alias("node_id")).agg(
        F.array_sort(
            F.collect_list(F.struct("ord", ref.alias("ref"), ((F.col("kind") == "number") & S.is_finite("num_val")).alias("finite")))
        ).alias("items")
    )
    own = own.join(items, [*ids, "node_id"], "left").where("k <> 'undefined'")
    none = F.array().cast(f"array<struct<ord:int,ref:{REF},finite:boolean>>")
    list_of = F.when(F.col("k") == "array", F.coalesce("items", none))
    pick = lambda key, value: F.max(F.when(F.col("key_text") == key, value))
    whole = F.coalesce((F.col("k") == "number") & S.is_safe_integer("num_val"), F.lit(False))
    own_ref = F.when(F.col("k") == "reference", F.struct(F.col("ref_obj").alias("obj"), F.col("ref_gen").alias("gen")))
    box = F.when((F.col("k") == "array") & (F.size(F.coalesce("items", none)) == 4) & F.forall("items", lambda i: i["finite"]), "good").otherwise("bad")
    turn = F.when(whole & (F.pmod("num_val", F.lit(90.0)) == 0), "good").otherwise("bad")
    state = F.when(F.col("k").isin("dictionary", "reference", "array"), F.col("k")).otherwise("bad")
    first_of = lambda key, value: F.max_by(value, F.when(F.col("key_text") == key, 1))
    seen = own.groupBy(*ids).agg(
        pick("Type", F.when(F.col("k") == "name", F.col("text_val"))).alias("type"),
        pick("Parent", own_ref).alias("parent"),
        F.coalesce(F.max(F.col("key_text") == "Parent"), F.lit(False)).alias("has_parent"),
        first_of("Kids", F.transform(list_of, lambda i: i["ref"])).alias("kids"),
        first_of("Contents", F.transform(list_of, lambda i: i["ref"])).alias("content_items"),
        pick("Contents", own_ref).alias("content_ref"),
        pick("Contents", state).alias("contents"),
        pick("MediaBox", box).alias("box"),
        pick("Rotate", turn).alias("rotate"),
        pick("Resources", state).alias("resources"),
        pick("Resources", own_ref).alias("resource_ref"),
        pick("Count", F.when(whole, F.col("num_val"))).alias("count"),
        pick("Pages", own_ref).alias("pages"),
    )
    seen = seen.withColumn("resources", F.when(F.col("resources") == "array", "bad").otherwise(F.col("resources")))
    return first.join(root, ids).join(seen, ids, "left").drop("root", "obj_index").withColumn("has_parent", F.coalesce("has_parent", F.lit(False)))


def _with_targets(view: DataFrame) -> DataFrame:
    """``view`` with what Resources and Contents references lead to: resource_target, content_targets (kinds; null if missing)."""
    kinds = view.select("doc_id", F.col("object_number").alias("n"), F.col("generation").alias("g"), F.col("kind").alias("target"))
    view = view.withColumns({"n": F.col("resource_ref.obj"), "g": F.col("resource_ref.gen")})
    view = view.join(kinds.withColumnRenamed("target", "resource_target"), ["doc_id", "n", "g"], "left").drop("n", "g")
    items = F.when(F.col("contents") == "reference", F.array("content_ref")).otherwise(F.col("content_items"))
    wanted = view.select("doc_id", "object_number", F.posexplode(items).alias("i", "ref"))
    found = wanted.withColumns({"n": F.col("ref.obj"), "g": F.col("ref.gen")}).join(kinds, ["doc_id", "n", "g"], "left")
    is_ref = F.col("ref").isNotNull()
    state = F.when(~is_ref, "direct").when(F.col("target").isNull(), "missing").when(F.col("target") == "stream", "stream").otherwise("other")
    lists = found.groupBy("doc_id", "object_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", state.alias("s")))), lambda x: x["s"]).alias("content_targets"))
    return view.join(lists, ["doc_id", "object_number"], "left")


def tree_roots(graph: Graph, view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (doc_id, obj, gen) of page trees, and diagnostics of catalogs that lead to none."""
    d = graph.documents.where("root_ok").select("doc_id", F.col("root.obj").alias("n"), F.col("root.gen").alias("g"))
    v = view.select("doc_id", F.col("object_number").alias("n"), "generation", "kind", "type", "pages")
    found = d.join(v, ["doc_id", "n"]).where("generation <=> g")
    catalog = F.coalesce((F.col("kind") == "dictionary") & (F.col("type") == "Catalog"), F.lit(False))
    bad = found.where(~catalog | F.col("pages").isNull())
    bad = bad.select(
        "doc_id", F.lit("invalid-root").alias("code"), F.when(catalog, "root.Pages").otherwise("root").alias("path"),
        F.when(catalog, "Pages of the catalog must be a reference").otherwise("The root must be a Catalog dictionary").alias("message"),
        F.lit(None).cast("array<struct<path:string,message:string>>").alias("related"), F.lit(6).alias("phase"), F.lit("").alias("place"),
    )
    good = found.where(catalog & F.col("pages").isNotNull())
    return good.select("doc_id", F.col("pages.obj").alias("obj"), F.col("pages.gen").alias("gen")), bad


def kid_edges(view: DataFrame) -> DataFrame:
    """doc_id, src, i, dst of Pages objects and their kids."""
    kids = view.where("type = 'Pages' and kind = 'dictionary'").select("doc_id", F.col("object_number").alias("src"), F.posexplode("kids").alias("i", "ref"))
    return kids.where("ref.obj is not null").select("doc_id", "src", "i", F.col("ref.obj").alias("dst"))


def tangled(view: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id of documents where a node has two incoming kid edges, or the root has one: there the order of the walk matters."""
    into = kid_edges(view).select("doc_id", F.col("dst").alias("n")).union(roots.select("doc_id", F.col("obj").alias("n")))
    return into.where("n is not null").groupBy("doc_id", "n").count().where("count > 1").select("doc_id").distinct()


def walk(rows: list[dict], root: tuple) -> list[tuple]:
    """Diagnostics of one document's page tree by a depth-first walk: (code, path, message, related). An explicit stack, so any depth."""
    by = {int(r["object_number"]): r for r in rows}
    out: list[tuple] = []
    first: dict = {}
    active: set = set()
    frames: list[dict] = []
    say = lambda code, path, message, related=None: out.append((code, path, message, related))

    def enter(ref, parent, path, box, res):
        """A frame to go on with, or the leaf count (None: incomplete)."""
        n, g = ref
        if n in first:
            cycle = n in active
            say("page-tree-cycle" if cycle else "page-tree-node-reused", path, "The page tree runs in a circle" if cycle else "A node of the page tree has two parents", [(first[n], "First reached here")])
            return None
        first[n] = path
        r = by.get(n)
        if r is None or r["kind"] != "dictionary":
            say("invalid-page-tree", path, "A node of the page tree must be a dictionary")
            return None
        same = parent is not None and r["parent"] is not None and tuple(r["parent"]) == parent
        if r["type"] == "Page":
            if not same:
                say("incorrect-page-parent", f"{path}.Parent", "Parent must be the Pages node that lists the page")
            for item in leaf_findings(r, path, box, res):
                say(*item)
            return 1
        if r["type"] != "Pages":
            say("invalid-page-tree", f"{path}.Type", "Type must be Page or Pages")
            return None
        if (parent is None and r["has_parent"]) or (parent is not None and not same):
            say("incorrect-page-parent", f"{path}.Parent", "The root has no Parent; other Pages name the node that lists them")
        if r["kids"] is None:
            say("invalid-page-tree", f"{path}.Kids", "Kids must be an array of references")
            return None
        found, box, res = node_findings(r, path, box, res)
        for item in found:
            say(*item)
        active.add(n)
        return {"r": r, "ref": (n, g), "path": path, "box": box, "res": res, "i": 0, "count": 0, "complete": True}

    state = enter(root, None, "pages", False, False)
    if isinstance(state, dict):
        frames.append(state)
    while frames:
        f = frames[-1]
        if f["i"] < len(f["r"]["kids"]):
            i, f["i"] = f["i"], f["i"] + 1
            kid, path = f["r"]["kids"][i], f"{f['path']}.Kids[{i}]"
            if kid is None:
                say("invalid-page-tree", path, "A kid must be a reference")
                f["complete"] = False
                continue
            got = enter(tuple(kid), f["ref"], path, f["box"], f["res"])
            if isinstance(got, dict):
                frames.append(got)
            elif got is None:
                f["complete"] = False
            else:
                f["count"] += got
            continue
        frames.pop()
        active.discard(f["ref"][0])
        want = f["r"]["count"]
        if f["complete"] and (want is None or want != f["count"]):
            say("incorrect-page-count", f"{f['path']}.Count", f"Count does not say {f['count']}")
        if frames:
            if f["complete"]:
                frames[-1]["count"] += f["count"]
            else:
                frames[-1]["complete"] = False
    return out


def _resources(r, path, res):
    state = r["resources"]
    if state is None:
        return [], res
    if state == "dictionary":
        return [], True
    if state == "reference":
        target = r["resource_target"]
        if target is None or target == "dictionary":
            return [], target == "dictionary"
        return [("incorrect-reference-target", f"{path}.Resources", "Resources must lead to a dictionary")], False
    return [("invalid-page-tree", f"{path}.Resources", "Resources must be a dictionary or a reference to one")], False


def node_findings(r, path, box, res):
    out = []
    if r["box"] is not None:
        box = r["box"] == "good"
        if not box:
            out.append(("invalid-page-tree", f"{path}.MediaBox", "MediaBox must hold four finite numbers"))
    more, res = _resources(r, path, res)
    out += more
    if r["rotate"] == "bad":
        out.append(("invalid-page-tree", f"{path}.Rotate", "Rotate must be a multiple of 90"))
    return out, box, res


def leaf_findings(r, path, box, res):
    out = []
    if r["box"] is None:
        if not box:
            out.append(("missing-page-attribute", f"{path}.MediaBox", "A page needs a MediaBox of its own or from above"))
    elif r["box"] == "bad":
        out.append(("invalid-page-tree", f"{path}.MediaBox", "MediaBox must hold four finite numbers"))
    if r["resources"] is None:
        if not res:
            out.append(("missing-page-attribute", f"{path}.Resources", "A page needs Resources of its own or from above"))
    else:
        out += _resources(r, path, res)[0]
    targets = r["content_targets"] if r["content_targets"] is not None else []
    if r["contents"] == "reference":
        if targets and targets[0] == "other":
            out.append(("incorrect-reference-target", f"{path}.Contents", "Contents must lead to a stream"))
    elif r["contents"] == "array":
        for i, t in enumerate(targets):
            if t == "direct":
                out.append(("invalid-page-tree", f"{path}.Contents[{i}]", "Contents must hold references"))
            elif t == "other":
                out.append(("incorrect-reference-target", f"{path}.Contents[{i}]", "Contents must lead to a stream"))
    elif r["contents"] is not None:
        out.append(("invalid-page-tree", f"{path}.Contents", "Contents must be a reference or an array of references"))
    if r["rotate"] == "bad":
        out.append(("invalid-page-tree", f"{path}.Rotate", "Rotate must be a multiple of 90"))
    return out


def _walk_group(group: pd.DataFrame) -> pd.DataFrame:
    import json

    rows = [json.loads(x) for x in group["row"]]
    for r in rows:
        pair = lambda x: (x.get("obj"), x.get("gen")) if x else None
        for k in ("parent", "count", "kids", "box", "rotate", "resources", "resource_target", "contents", "content_targets", "type"):
            r.setdefault(k, None)
        r["parent"] = pair(r["parent"])
        if r["kids"] is not None:
            r["kids"] = [pair(k) for k in r["kids"]]
    root = (int(group["root_obj"].iloc[0]), int(group["root_gen"].iloc[0]))
    doc = group["doc_id"].iloc[0]
    found = walk(rows, root)
    out = [(doc, c, p, m, [{"path": a, "message": b} for a, b in rel] if rel else None, 6, f"{i:08d}") for i, (c, p, m, rel) in enumerate(found)]
    return pd.DataFrame(out, columns=["doc_id", "code", "path", "message", "related", "phase", "place"])


def walked_diagnostics(view: DataFrame, roots: DataFrame) -> DataFrame:
    """Page-tree diagnostics of the documents in ``roots`` by the walk, one document to a call."""
    rows = view.join(roots, "doc_id").select(
        "doc_id", F.to_json(F.struct(*[c for c in view.columns if c != "doc_id"])).alias("row"), F.col("obj").alias("root_obj"), F.col("gen").alias("root_gen")
    )
    return rows.where("root_obj is not null and root_gen is not null").groupBy("doc_id").applyInPandas(_walk_group, FOUND)


def tree_levels(view: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of clean trees from the root down: the view, with path, depth, ancestors (numbers), expected parent and inherited
    states (in_box, in_res). A round per level; the states are folded on the way."""
    ok_box = F.when(F.col("box").isNull(), F.col("in_box")).otherwise(F.col("box") == "good")
    ok_res = (
        F.when(F.col("resources").isNull(), F.col("in_res"))
        .when(F.col("resources") == "dictionary", True)
        .when(F.col("resources") == "reference", F.coalesce(F.col("resource_target") == "dictionary", F.lit(False)))
        .otherwise(False)
    )
    level = roots.select(
        "doc_id", "obj", "gen", F.lit("pages").alias("path"), F.lit(0).alias("level"), F.array().cast("array<bigint>").alias("ancestors"),
        F.lit(None).cast(REF).alias("up"), F.lit(False).alias("in_box"), F.lit(False).alias("in_res"),
    )
    v = view.withColumn("obj", F.col("object_number"))
    done = None
    while True:
        here = staged(level.join(v, ["doc_id", "obj"], "left"), "level")
        if not here.limit(1).count():
            return done
        done = here if done is None else done.unionByName(here)
        inner = here.where("type = 'Pages' and kind = 'dictionary' and kids is not null")
        kids = inner.select(
            "doc_id", F.posexplode("kids").alias("i", "kid"), "path", "level", "ancestors", F.struct("obj", "gen").alias("up"), ok_box.alias("in_box"), ok_res.alias("in_res")
        ).where("kid.obj is not null")
        level = kids.select(
            "doc_id", F.col("kid.obj").alias("obj"), F.col("kid.gen").alias("gen"), F.concat("path", F.lit(".Kids["), "i", F.lit("]")).alias("path"),
            (F.col("level") + 1).alias("level"), F.concat("ancestors", F.array(F.col("up.obj"))).alias("ancestors"), "up", "in_box", "in_res",
        )


def subtree_counts(levels: DataFrame) -> DataFrame:
    """doc_id, obj, leaves, complete of every Pages node: each node counts for all its ancestors."""
    leaf = F.coalesce((F.col("kind") == "dictionary") & (F.col("type") == "Page"), F.lit(False))
    inner = F.coalesce((F.col("kind") == "dictionary") & (F.col("type") == "Pages") & F.col("kids").isNotNull(), F.lit(False))
    whole = leaf | (inner & F.coalesce(F.forall("kids", lambda k: k.isNotNull()), F.lit(False)))
    rows = levels.select("doc_id", F.explode(F.concat("ancestors", F.when(inner, F.array("obj")).otherwise(F.array().cast("array<bigint>")))).alias("obj"), leaf.alias("leaf"), whole.alias("whole"))
    return rows.groupBy("doc_id", "obj").agg(F.count_if("leaf").alias("leaves"), F.bool_and("whole").alias("complete"))


def level_diagnostics(levels: DataFrame) -> DataFrame:
    """Page-tree diagnostics of clean trees, all rules as filters over the levels."""
    found = lambda cond, code, suffix, message: F.when(
        cond, F.array(F.struct(F.lit(code).alias("code"), F.concat("path", F.lit(suffix)).alias("path"), F.lit(message).alias("message")))
    ).otherwise(F.array().cast("array<struct<code:string,path:string,message:string>>"))
    is_dict = F.coalesce(F.col("kind") == "dictionary", F.lit(False))
    page, pages = is_dict & (F.coalesce("type", F.lit("")) == "Page"), is_dict & (F.coalesce("type", F.lit("")) == "Pages")
    inner = pages & F.col("kids").isNotNull()
    body = page | inner
    up_ok = F.coalesce((F.col("parent.obj") == F.col("up.obj")) & (F.col("parent.gen") == F.col("up.gen")), F.lit(False))
    wrong_parent = (page & ~up_ok) | (pages & F.when(F.col("up").isNull(), F.col("has_parent")).otherwise(~up_ok))
    resource_bad = body & (F.col("resources") == "reference") & F.col("resource_target").isNotNull() & (F.col("resource_target") != "dictionary")
    c = F.col("contents")
    item = F.transform(
        F.coalesce("content_targets", F.array().cast("array<string>")),
        lambda t, i: F.when(page & (c == "array") & (t == "direct"), F.struct(F.lit("invalid-page-tree").alias("code"), F.concat("path", F.lit(".Contents["), i, F.lit("]")).alias("path"), F.lit("Contents must hold references").alias("message")))
        .when(page & (t == "other"), F.struct(F.lit("incorrect-reference-target").alias("code"), F.when(c == "array", F.concat("path", F.lit(".Contents["), i, F.lit("]"))).otherwise(F.concat("path", F.lit(".Contents"))).alias("path"), F.lit("Contents must lead to a stream").alias("message"))),
    )
    kid = F.transform(
        F.when(inner, F.col("kids")),
        lambda k, i: F.when(k.isNull(), F.struct(F.lit("invalid-page-tree").alias("code"), F.concat("path", F.lit(".Kids["), i, F.lit("]")).alias("path"), F.lit("A kid must be a reference").alias("message"))),
    )
    counts = subtree_counts(levels).withColumnRenamed("obj", "c_obj").withColumnRenamed("doc_id", "c_doc")
    rows = levels.join(counts, (F.col("doc_id") == F.col("c_doc")) & (F.col("obj") == F.col("c_obj")), "left")
    wrong_count = inner & F.coalesce("complete", F.lit(False)) & ~F.coalesce(F.col("count") == F.col("leaves"), F.lit(False))
    none = F.array().cast("array<struct<code:string,path:string,message:string>>")
    there = lambda a: F.coalesce(F.filter(a, lambda x: x.isNotNull()), none)
    all_found = F.concat(
        found(~is_dict, "invalid-page-tree", "", "A node of the page tree must be a dictionary"),
        found(is_dict & ~page & ~pages, "invalid-page-tree", ".Type", "Type must be Page or Pages"),
        found(wrong_parent, "incorrect-page-parent", ".Parent", "Parent must be the node that lists this one"),
        found(pages & F.col("kids").isNull(), "invalid-page-tree", ".Kids", "Kids must be an array of references"),
        found(body & (F.col("box") == "bad"), "invalid-page-tree", ".MediaBox", "MediaBox must hold four finite numbers"),
        found(page & F.col("box").isNull() & ~F.col("in_box"), "missing-page-attribute", ".MediaBox", "A page needs a MediaBox of its own or from above"),
        found(page & F.col("resources").isNull() & ~F.col("in_res"), "missing-page-attribute", ".Resources", "A page needs Resources of its own or from above"),
        found(resource_bad, "incorrect-reference-target", ".Resources", "Resources must lead to a dictionary"),
        found(body & (F.col("resources") == "bad"), "invalid-page-tree", ".Resources", "Resources must be a dictionary or a reference to one"),
        found(page & (c == "dictionary"), "invalid-page-tree", ".Contents", "Contents must be a reference or an array of references"),
        found(page & (c == "bad"), "invalid-page-tree", ".Contents", "Contents must be a reference or an array of references"),
        there(item),
        found(body & (F.col("rotate") == "bad"), "invalid-page-tree", ".Rotate", "Rotate must be a multiple of 90"),
        there(kid),
        found(wrong_count, "incorrect-page-count", ".Count", "Count does not say how many pages there are below"),
    )
    return rows.select("doc_id", F.explode(all_found).alias("d"), F.col("path").alias("place")).select(
        "doc_id", "d.code", "d.path", "d.message", F.lit(None).cast("array<struct<path:string,message:string>>").alias("related"), F.lit(6).alias("phase"), "place"
    )


def page_tree_diagnostics(graph: Graph, view: DataFrame | None = None) -> DataFrame:
    """Diagnostics of all page trees. Documents in which a node is listed twice are walked in order; all others go by levels."""
    view = staged(_with_targets(typed_view(graph)), "view") if view is None else view
    roots, bad = tree_roots(graph, view)
    roots = staged(roots, "roots")
    knots = staged(tangled(view, roots), "knots")
    out = bad
    levels = tree_levels(view, roots.join(knots, "doc_id", "left_anti"))
    if levels is not None:
        out = out.unionByName(level_diagnostics(levels))
    return out.unionByName(walked_diagnostics(view.join(knots, "doc_id", "left_semi"), roots.join(knots, "doc_id", "left_semi")))
