"""Directory trees: nodes, order, and rendered lines.

Work is done per *directory* first and only then looked up per file, so files
are never multiplied by their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths, rules
from corpusloom.functions.rules import Profile
from corpusloom.plans.ranking import PLACE, with_position
from corpusloom.plans.skew import join_facts
from corpusloom.session import guard

# The pieces of a drawn tree.
BRANCH, LAST_BRANCH = "├── ", "└── "
PIPE, GAP = "│   ", "    "
ROOT = "."


def directories(files: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Every directory above any scanned file, ``(project, path, place)``.

    ``files`` must be the whole scan: a directory stays even when all of its
    files are filtered out. With a profile, pruned directories are left out.
    """
    # A directory lies in the range of its first file; it stands right before it.
    place = F.min(PLACE if PLACE in files.columns else F.lit(0)).alias(PLACE)
    parents = files.groupBy("project", paths.parent(F.col("path")).alias("dir")).agg(place)
    chains = parents.select("project", F.explode(paths.prefixes(F.col("dir"), include_self=True)).alias("path"), PLACE)
    found = chains.groupBy("project", "path").agg(F.min(PLACE).alias(PLACE))
    if profile is None:
        return found
    path = F.col("path")
    return found.filter(rules.within_depth(path, profile.max_depth) & ~rules.is_pruned(path, profile))


def nodes(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row per tree node: ``project, path, parent, name, is_dir, sort_key, place``."""
    guard(files.sparkSession)
    place = F.col(PLACE) if PLACE in files.columns else F.lit(0).alias(PLACE)
    both = dirs.select("project", "path", F.lit(True).alias("is_dir"), PLACE).unionByName(
        files.select("project", "path", F.lit(False).alias("is_dir"), place)
    )
    path = F.col("path")
    return both.select(
        "project",
        "path",
        paths.parent(path).alias("parent"),
        paths.base_name(path).alias("name"),
        "is_dir",
        paths.tree_key(path, F.col("is_dir")).alias("sort_key"),
        PLACE,
    )


def in_order(tree: DataFrame) -> DataFrame:
    """Adds ``ord``, the 1-based position in tree order; a task sorts the nodes of one place."""
    return with_position(tree, ["project"], ["sort_key"], blocks=[PLACE])


def _last_children(tree: DataFrame) -> DataFrame:
    """Per directory the child listed last: files come after directories."""
    return tree.groupBy("project", "parent").agg(F.max(F.struct(~F.col("is_dir"), "name")).alias("last"))


def _is_last() -> Column:
    return F.struct(~F.col("is_dir"), "name") == F.col("last")


def with_last_flag(tree: DataFrame) -> DataFrame:
    """Adds ``is_last``: no sibling follows."""
    joined = join_facts(tree, _last_children(tree), ["project", "parent"])
    return joined.withColumn("is_last", _is_last()).drop("last")


def with_lines(tree: DataFrame) -> DataFrame:
    """Adds ``line``, the drawn text of each node."""
    last = _last_children(tree)
    dirs = tree.filter("is_dir")
    flags = join_facts(dirs, last, ["project", "parent"]).select(
        "project", F.col("path").alias("ancestor"), _is_last().alias("ancestor_last")
    )
    # What every line below a directory starts with: one piece per ancestor.
    chains = dirs.select(
        "project", F.col("path").alias("dir"), F.posexplode(paths.prefixes(F.col("path"), True))
    ).withColumnRenamed("col", "ancestor")
    piece = F.struct("pos", F.when(F.col("ancestor_last"), F.lit(GAP)).otherwise(F.lit(PIPE)).alias("text"))
    indents = (
        join_facts(chains, flags, ["project", "ancestor"])
        .groupBy("project", "dir")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        .select(
            "project",
            F.col("dir").alias("parent"),
            F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("indent"),
        )
    )
    looks = last.join(indents, ["project", "parent"], "left")
    drawn = join_facts(tree, looks, ["project", "parent"])
    line = F.concat(
        F.coalesce("indent", F.lit("")),
        F.when(_is_last(), F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH)),
        F.col("name"),
        F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")),
    )
    return drawn.withColumn("line", line).drop("last", "indent")


def lines(tree: DataFrame) -> DataFrame:
    """The drawn tree of each project, ``(project, ord, line)``; the root line has ``ord`` 0."""
    drawn = in_order(with_lines(tree)).select("project", "ord", "line")
    root = tree.select("project").distinct().select(
        "project", F.lit(0).cast("bigint").alias("ord"), F.lit(ROOT).alias("line")
    )
    return root.unionByName(drawn)
