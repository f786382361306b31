"""Relating files to facts stated about the directories above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.plans.ranking import PLACE, with_place, with_running_max
from corpusloom.plans.skew import join_facts


def targets_above(files: DataFrame, targets: DataFrame) -> DataFrame:
    """For each directory holding files, the ``targets`` on it or on a directory above.

    ``targets`` has ``project`` and ``target`` (empty for the project itself);
    the result has ``project``, ``parent`` and the columns of ``targets``. The
    prefixes of *directories* are matched with an equi-join, so no file is
    repeated and no pair is formed that does not match.
    """
    parents = files.select("project", paths.parent(F.col("path")).alias("parent")).distinct()
    chain = F.concat(F.array(F.lit("")), paths.prefixes(F.col("parent"), include_self=True))
    chains = parents.select("project", "parent", F.explode(chain).alias("target"))
    return join_facts(chains, targets, ["project", "target"])


def per_directory(files: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    """Joins ``facts`` with one row per ``(project, parent)`` to the files of that directory."""
    placed = files.withColumn("parent", paths.parent(F.col("path")))
    return join_facts(placed, facts, ["project", "parent"], how).drop("parent")


# Ends the range of keys below a directory: they go on with the separator, which is smaller.
_END = "\x01"


def below(index: DataFrame, targets: DataFrame) -> DataFrame:
    """The files of ``index`` (``ranking.path_index``) on or below a target, with ``target``: of several the outermost.

    ``targets`` is ``(project, target)``, each a directory or a file, or empty for
    the whole project. In tree order the files below a directory follow it without
    a break, so one pass over files and targets finds them: a file is reached if a
    target that began before it has not ended. Nothing is repeated for a file's
    ancestors, and a large project is read in the ranges of the index.
    """
    as_dir, as_file = (paths.tree_key(F.col("target"), F.lit(is_dir)) for is_dir in (True, False))
    both = F.explode(F.when(F.col("target") == "", F.array(F.lit(""))).otherwise(F.array(as_dir, as_file))).alias("sort_key")
    marks = targets.select("project", "target").distinct().select("project", "target", both)
    end = F.when(F.col("target") == "", F.lit("2")).otherwise(F.concat("sort_key", F.lit(_END)))
    rows = with_place(index.drop(PLACE), index, F.col("sort_key"))
    own = F.struct(*[c for c in rows.columns if c not in ("project", "sort_key", PLACE)]).alias("row")
    mark = F.struct(end.alias("end"), "target").alias("mark")
    marks = with_place(marks, index, F.col("sort_key")).select("project", "sort_key", PLACE, mark)
    rows = rows.select("project", "sort_key", PLACE, own)
    events = rows.withColumn("mark", F.lit(None).cast(marks.schema["mark"].dataType)).unionByName(
        marks.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType))
    )
    # Marks come before the files they are equal to.
    events = events.withColumn("is_file", F.col("row").isNotNull())
    reached = with_running_max(events, ["project"], ["sort_key", "is_file"], "mark", "reach", [PLACE])
    found = reached.filter("is_file AND sort_key < reach.end")
    return found.select("project", "sort_key", PLACE, "row.*", F.col("reach.target").alias("target"))
