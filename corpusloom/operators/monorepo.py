"""Sub-projects of a monorepo and its root files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths, rules
from corpusloom.functions.languages import language
from corpusloom.functions.rules import Profile
from corpusloom.operators.tree import BRANCH, GAP, LAST_BRANCH, PIPE
from corpusloom.plans.ancestry import below
from corpusloom.plans.ranking import PLACE, with_position
from corpusloom.plans.skew import join_facts
from corpusloom.sources.files import is_unread

# The folders sub-projects live in, in listing order; their marker file.
FOLDERS = ("apps", "libs", "tools", "packages")
MARKER = "project.json"

# Root files a run may list as important.
IMPORTANT_CHOICES = ("package.json", "nx.json", "project.json", "tsconfig.base.json")

MONOREPO_ROOT = "nx-monorepo/"


def subprojects(files: DataFrame) -> DataFrame:
    """``(project, name, type, root)``: outermost directories with a marker file."""
    path = F.col("path")
    top = F.substring_index(path, "/", 1)
    roots = files.filter(
        (paths.base_name(path) == MARKER) & path.contains("/") & top.isin(*FOLDERS)
    ).select("project", paths.parent(path).alias("root"))
    # In tree order what lies below a root follows it without a break: a root is inside another if one before it has not ended.
    walk = paths.tree_key(F.col("root"), F.lit(True))
    earlier = Window.partitionBy("project").orderBy("walk").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.max(F.concat("walk", F.lit("\x01"))).over(earlier)
    outermost = roots.withColumn("walk", walk).withColumn("ends", ends).filter("ends IS NULL OR ends <= walk")
    root = F.col("root")
    return outermost.select(
        "project", paths.base_name(root).alias("name"), F.substring_index(root, "/", 1).alias("type"), "root"
    )


def listed(subs: DataFrame) -> DataFrame:
    """Adds ``idx``, the 1-based number of each sub-project in its project's listing."""
    keyed = subs.withColumn("__folder", F.array_position(F.array(*map(F.lit, FOLDERS)), F.col("type"))).withColumn(
        "__walk", F.replace("root", F.lit("/"), F.lit(paths.SEP))
    )
    return with_position(keyed, ["project"], ["__walk"], "idx", ["__folder"]).drop("__folder", "__walk")


def pick(numbered: DataFrame, choices: DataFrame) -> DataFrame:
    """The chosen sub-projects with ``pick``, their position in the choice.

    ``choices`` is ``(project, input)``: ``all`` in any case or nothing means
    every one in listing order, else 1-based numbers separated by commas; a
    repeated number repeats, anything else is ignored.
    """
    typed = choices.select("project", paths.strip(F.col("input")).alias("input"))
    everything = (F.col("input") == "") | (F.lower("input") == "all")
    tokens = typed.filter(~everything).select("project", F.posexplode(paths.split_list(F.col("input"))))
    numbers = tokens.filter(F.col("col").rlike(r"^[+-]?[0-9]+\z")).select(
        "project", (F.col("pos") + 1).cast("bigint").alias("pick"), F.expr("try_cast(col AS BIGINT)").alias("idx")
    )
    columns = numbered.columns
    some = numbered.join(numbers, ["project", "idx"]).select(*columns, "pick")
    whole = join_facts(numbered, typed.filter(everything), ["project"], "left_semi")
    return whole.withColumn("pick", F.col("idx")).unionByName(some)


def root_files(files: DataFrame, profile: Profile) -> DataFrame:
    """Files directly at the project root, own artifacts and user excludes left out."""
    path = F.col("path")
    named = globs.matches_name(path, [p for p in profile.excluded_patterns if "/" not in p])
    dropped = rules.is_own_artifact(path, profile) | (named & ~rules.is_important(path, profile.important_files))
    return files.filter(~path.contains("/") & ~dropped)


def important_root_files(files: DataFrame, important: Sequence[str], profile: Profile) -> DataFrame:
    """The listed root files that exist, in list order (``pos``), with ``lang`` and ``skipped``."""
    names = F.array(*map(F.lit, important)).cast("array<string>")
    found = files.filter(F.col("path").isin(*important)) if important else files.limit(0)
    placed = found.select("*", F.posexplode(names).alias("__at", "__name")).filter("__name = path")
    unread = F.coalesce(
        is_unread(F.col("size"), F.col("content"), profile.max_file_size), F.lit(True)
    ) | rules.is_own_config(F.col("path"), profile.config_stem)
    return (
        placed.withColumn("pos", (F.col("__at") + 1).cast("bigint"))
        .withColumn("lang", language(F.col("path")))
        .withColumn("skipped", unread)
        .withColumn("content", F.when(~F.col("skipped"), F.col("content")))
        .drop("__at", "__name")
    )


def assign(index: DataFrame, subs: DataFrame) -> DataFrame:
    """Files of ``index`` (``ranking.path_index``) below a sub-project root, with the columns of ``subs``; others are left out.

    Roots lie beside each other, not within. One that is picked several times gives its files as often.
    """
    found = below(index, subs.select("project", F.col("root").alias("target")))
    return join_facts(found.withColumnRenamed("target", "root"), subs, ["project", "root"])


def by_type(subs: DataFrame) -> DataFrame:
    """Sub-projects by type, sorted, with ``pos``, the position within the type."""
    return with_position(subs, ["project", "type"], ["name", "root"], "pos")


def _connector(is_last: Column) -> Column:
    return F.when(is_last, F.lit(LAST_BRANCH)).otherwise(F.lit(BRANCH))


def overview(subs: DataFrame, roots: DataFrame) -> DataFrame:
    """Overview of each monorepo, ``(project, ord, line)``.

    Types with their sub-projects come first, then the root files. ``roots`` is
    ``(project, path)``, with ``place`` where it is known. Every entry is a row;
    only the last name of a list and a few flags are looked up per entry. A
    ``pick`` column tells repeated sub-projects apart.
    """
    if "pick" not in subs.columns:
        subs = subs.withColumn("pick", F.lit(0).cast("bigint"))
    entry = F.struct("name", "root", "pick")
    types = subs.groupBy("project", "type").agg(F.max(entry).alias("last_sub"))
    last_file = roots.groupBy("project").agg(F.max("path").alias("last_file"))
    last_type = types.groupBy("project").agg(F.max("type").alias("last_type"))
    ends = last_type.join(last_file, "project", "full")
    closes = (F.col("type") == F.col("last_type")) & F.col("last_file").isNull()
    typed = types.join(ends, "project").withColumn("closes", closes)

    def rows(df: DataFrame, part: int, line: Column, **place: str) -> DataFrame:
        keys = [F.expr(place.get(k, "''")).cast("string").alias(k) for k in ("kind", "label", "root")]
        pick = F.expr(place.get("pick", "0")).cast("bigint").alias("pick")
        at = F.col(PLACE) if part == 3 else F.lit(0).alias(PLACE)
        return df.select("project", F.lit(part).alias("part"), *keys, pick, at, line.alias("line"))

    members = join_facts(
        subs.select("project", "type", "name", "root", "pick"),
        typed.select("project", "type", "last_sub", "closes"),
        ["project", "type"],
    )
    member_line = F.concat(
        F.when(F.col("closes"), F.lit(GAP)).otherwise(F.lit(PIPE)),
        _connector(entry == F.col("last_sub")),
        F.col("name"),
    )
    type_line = F.concat(_connector(F.col("closes")), F.col("type"), F.lit("/"))
    if PLACE not in roots.columns:
        roots = roots.withColumn(PLACE, F.lit(0))
    files = join_facts(roots.select("project", "path", PLACE), last_file, ["project"])
    file_line = F.concat(_connector(F.col("path") == F.col("last_file")), F.col("path"))
    both = ends.filter("last_type IS NOT NULL AND last_file IS NOT NULL")
    every = (
        rows(ends, 0, F.lit(MONOREPO_ROOT))
        .unionByName(rows(typed, 1, type_line, kind="type"))
        # The empty label of a type line sorts it before its members.
        .unionByName(rows(members, 1, member_line, kind="type", label="concat('+', name)", root="root", pick="pick"))
        .unionByName(rows(both, 2, F.lit(PIPE.strip())))
        .unionByName(rows(files, 3, file_line, label="path"))
    )
    numbered = with_position(every, ["project"], ["label", "root", "pick"], blocks=["part", "kind", PLACE])
    return numbered.select("project", "ord", "line")
