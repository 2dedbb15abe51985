"""Pinned actions in workflow files: inventory, groups, newest versions and rewritten lines. Nothing here uses a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: A step that uses an action (owner and name) at a ref; the version is in a comment behind it.
USES = r"^(\s*(?:-\s+)?uses:\s+)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)@([^\s#]+)\s+#\s*([^\r\n]*\S)\s*\z"


def workflow_lines(files: DataFrame) -> DataFrame:
    """``files`` (path, bytes) as lines: path, line_index (from 0), line, indent. Only YAML files."""
    rows = files.where(F.col("path").rlike(r"\.ya?ml\z")).withColumn("text", F.decode("bytes", "UTF-8"))
    lines = rows.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_index", "line"))
    return lines.withColumn("indent", F.length(F.regexp_extract("line", r"^(\s*)", 1)))


def used_actions(lines: DataFrame) -> DataFrame:
    """path, line_index, prefix, action, ref, comment, version of pinned uses; uses without a comment aren't pinned, and local
    actions are left out. The version is the comment without a ``v`` in front."""
    part = lambda i: F.regexp_extract("line", USES, i)
    found = lines.where(F.col("line").rlike(USES)).select(
        "path", "line_index", part(1).alias("prefix"), part(2).alias("action"), part(3).alias("ref"), part(4).alias("comment")
    )
    version = F.regexp_replace("comment", "^v", "")
    return found.where(~F.col("action").startswith("./")).withColumn("version", version)


def input_lines(lines: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """The first line ``key: 1.2.3`` after each use, before the next line that is indented less than the use."""
    value = F.regexp_extract("line", rf"^\s*\Q{key}\E:\s+([0-9]+\.[0-9]+\.[0-9]+)\s*\z", 1)
    here = uses.join(lines.select("path", "line_index", "indent"), ["path", "line_index"]).select("path", "line_index", "action", F.col("indent").alias("level"))
    # for each indent that a use of the file has: the next line with a value, and the next that is indented less; read from the
    # last line up, as a frame that grows: Spark starts one that shrinks anew for each row
    ahead = Window.partitionBy("path", "level").orderBy(F.desc("line_index")).rowsBetween(Window.unboundedPreceding, -1)
    levels = lines.join(here.select("path", "level").distinct(), "path").withColumn("value", value)
    found = F.min(F.when(F.col("value") != "", F.struct("line_index", "value"))).over(ahead)
    out = F.min(F.when((F.col("indent") < F.col("level")) & (F.trim("line") != ""), F.col("line_index"))).over(ahead)
    levels = levels.select("path", "level", "line_index", found.alias("f"), out.alias("out"))
    rows = here.join(levels, ["path", "level", "line_index"]).where("f is not null and (out is null or out > f.line_index)")
    return rows.select("path", "action", F.col("line_index").alias("use_line"), F.col("f.line_index").alias("line_index"), "f.value")


def action_groups(uses: DataFrame) -> DataFrame:
    """action, version, ref, occurrences (path and line, in order), one row per action and version."""
    place = F.struct("path", "line_index")
    groups = uses.groupBy("action", "version").agg(F.min_by("ref", place).alias("ref"), F.array_sort(F.collect_list(place)).alias("occurrences"))
    return groups.orderBy("action", "version")


def newest_tags(tags: DataFrame) -> DataFrame:
    """action, tag, commit of the highest plain version in ``tags`` (action, tag, commit); prereleases are left out."""
    rows = tags.withColumn("v", S.semver("tag")).where("v is not null")
    return rows.groupBy("action").agg(F.max(F.struct("v", "tag", "commit")).alias("m")).select("action", "m.tag", "m.commit")


def rewritten_lines(uses: DataFrame, newest: DataFrame) -> DataFrame:
    """path, line_index, line of the uses that a newer tag replaces: the commit as ref, the tag in the comment."""
    both = uses.join(newest, "action").where(F.col("ref") != F.col("commit"))
    return both.select("path", "line_index", F.concat("prefix", "action", F.lit("@"), "commit", F.lit(" # "), S.with_version_prefix("tag")).alias("line"))


def update_report(uses: DataFrame, newest: DataFrame) -> DataFrame:
    """action, version, ref (short) of each group of uses, the newest version and its commit (short), and whether they differ;
    null where no tag is known."""
    groups = action_groups(uses).join(newest, "action", "left")
    return groups.select(
        "action", "version", S.short_commit("ref").alias("ref"), F.regexp_replace("tag", "^v", "").alias("newest"), S.short_commit("commit").alias("commit"), F.coalesce(F.col("ref") != F.col("commit"), F.lit(False)).alias("has_update")
    )
