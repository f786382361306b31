"""File selections: listed paths, patterns, bulk commands and their roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths, rules
from corpusloom.functions.rules import Profile
from corpusloom.plans.ancestry import below, per_directory, targets_above
from corpusloom.plans.ranking import PLACE, with_place, with_position
from corpusloom.plans.skew import join_facts

# How a directory's state is shown.
ALL, SOME, NONE = "x", "~", " "


def select_listed(files: DataFrame, selections: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Files equal to, or below, a selected path of their project.

    ``selections`` is ``(project, target)``; a trailing slash is ignored. Paths
    decide, and files with their contents are joined once. With an ``index`` of
    the corpus that is one ordered pass over it; without one the directories that
    hold files are looked up by the directories above them.
    """
    target = F.rtrim(paths.normalize(F.col("target")), F.lit("/")).alias("target")
    targets = selections.select("project", target).filter("target <> ''").distinct()
    if index is not None:
        found = below(index, targets).select("project", "path")
    else:
        covered = targets_above(files, targets).select("project", "parent").distinct()
        inside = per_directory(files.select("project", "path"), covered, "left_semi")
        found = inside.unionByName(targets.select("project", F.col("target").alias("path")))
    return files.join(found, ["project", "path"], "left_semi")


#: Patterns with the same key that one regular expression tries.
PATTERNS = 100


def select_matching(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that match any glob of their project.

    ``patterns`` is ``(project, pattern)``, any number of them. A pattern is
    looked up by what it shares with its matches: the literal name, extension or
    first segment (``globs.index_key``), in an equi-join; only files that have it
    are tried. Patterns without any such part are tried on all files of their
    project. Paths decide; files with their contents are joined once.
    """
    keyed = patterns.select("project", globs.indexed(F.col("pattern")).alias("p")).select("project", "p.*").filter("regex IS NOT NULL").distinct()
    # Patterns of one key are tried together, in groups of bounded size.
    group = F.pmod(F.xxhash64("regex"), F.ceil(F.count("*").over(Window.partitionBy("project", "kind", "value")) / PATTERNS))
    tried = keyed.withColumn("__group", group).groupBy("project", "kind", "value", "__group").agg(F.array_sort(F.collect_list("regex")).alias("all"))
    tried = tried.select("project", "kind", "value", F.concat(F.lit("^(?:"), F.array_join("all", "|"), F.lit(r")\z")).alias("__re"))
    keys = files.select("project", "path", F.inline(globs.keys_of(F.col("path"))))
    found = join_facts(keys, tried, ["project", "kind", "value"]).filter(F.regexp_instr("path", F.col("__re")) > 0)
    return files.join(found.select("project", "path"), ["project", "path"], "left_semi")


def quick_select(files: DataFrame, patterns: Sequence[str], profile: Profile) -> DataFrame:
    """Files that match any of the patterns; none for an empty list."""
    path = F.col("path")
    return files.filter(rules.is_listed(path, profile) & globs.matches_path(path, patterns))


def bulk_select(files: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``selected``: the last command on the file or a directory above it decides.

    ``events`` is ``(project, seq, target, action)`` with action ``select`` or
    ``deselect``; an empty target is the whole project.
    """
    latest = events.groupBy("project", "target").agg(F.max(F.struct("seq", "action")).alias("cmd"))
    above = (
        targets_above(files, latest).groupBy("project", "parent").agg(F.max("cmd").alias("__above"))
    )
    own = latest.select("project", F.col("target").alias("path"), F.col("cmd").alias("__own"))
    # Paths decide; files with their contents are joined once.
    marked = per_directory(files.select("project", "path"), above).join(own, ["project", "path"], "left")
    last = F.greatest("__above", "__own")
    chosen = marked.filter(last["action"] == "select").select("project", "path", F.lit(True).alias("__chosen"))
    found = files.join(chosen, ["project", "path"], "left")
    return found.select(*files.columns, F.coalesce("__chosen", F.lit(False)).alias("selected"))


def rollup(files: DataFrame) -> DataFrame:
    """State of every directory from its files' ``selected``; the root is the empty path.

    Files are counted per directory before anything is passed up, so only
    directories are repeated per level.
    """
    own = files.groupBy("project", paths.parent(F.col("path")).alias("parent")).agg(
        F.count("*").alias("n"), F.count_if("selected").alias("k")
    )
    chain = F.concat(F.array(F.lit("")), paths.prefixes(F.col("parent"), include_self=True))
    state = (
        F.when(F.col("n_selected") == F.col("n_files"), F.lit(ALL))
        .when(F.col("n_selected") > 0, F.lit(SOME))
        .otherwise(F.lit(NONE))
    )
    return (
        own.select("project", F.explode(chain).alias("dir"), "n", "k")
        .groupBy("project", "dir")
        .agg(F.sum("n").alias("n_files"), F.sum("k").alias("n_selected"))
        .withColumn("state", state)
    )


def in_tree_order(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Adds ``ord``, the position of each file among its project's files in tree order.

    With an ``index`` of the corpus a large project is numbered in ranges.
    """
    key = paths.tree_key(F.col("path"), F.lit(False))
    keyed = files.withColumn("__key", key)
    if index is None:
        return with_position(keyed, ["project"], ["__key"]).drop("__key")
    return with_position(with_place(keyed, index, F.col("__key")), ["project"], ["__key"], blocks=[PLACE]).drop("__key", PLACE)
