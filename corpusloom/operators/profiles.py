"""Rule profiles kept as a table, one row per project."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import globs, paths, rules
from corpusloom.functions.languages import language
from corpusloom.functions.rules import Profile
from corpusloom.operators import tree
from corpusloom.plans.skew import join_facts
from corpusloom.schemas import PROFILES
from corpusloom.session import materialize, ship_package

# Defaults of the settings that are not rules.
DEFAULT_OUTPUT = {"output_format": "markdown", "output_filename": "project_docs.md", "append_timestamp": True}
DEFAULT_MODE = "full"

# Suggestions by project type. Types not named get GENERAL.
GO_TYPES = ("go",)
FRONTEND_TYPES = ("angular", "browser-extension", "react", "vue", "svelte", "javascript", "js", "nx")
SUGGESTED = {
    "go": ("vendor/**", "*.exe", "*.dll", "*.so", "*.dylib"),
    "frontend": ("dist/**", "build/**", ".angular/**", ".nx/**", "coverage/**"),
    "general": ("*.log", "*.tmp", "*.bak"),
}


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def resolve(projects: DataFrame, overrides: DataFrame) -> DataFrame:
    """A complete profile per project: each unset field takes its default.

    Unset means null for flags, 0 for sizes, empty for texts, null or empty for
    ``excluded_patterns``, and null for the other lists. Both inputs have one
    row per project. Columns that ``overrides`` lacks are unset, so the profiles
    of ``suggest`` are resolved like any others.
    """
    default = Profile()
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in PROFILES.fields if f.name not in overrides.columns}
    overrides = overrides.withColumns(lacking).select(*PROFILES.names) if lacking else overrides

    def text(name: str, value: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)).alias(name)

    def flag(name: str, value: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    def listing(name: str) -> Column:
        return F.coalesce(F.col(name), _strings([])).alias(name)

    return projects.join(overrides, "project", "left").select(
        "project",
        F.coalesce(F.nullif(F.col("max_file_size"), F.lit(0)), F.lit(rules.DEFAULT_MAX_FILE_SIZE))
        .cast("bigint")
        .alias("max_file_size"),
        *[flag(name, getattr(default, name)) for name in rules.CATEGORIES],
        F.when(F.size("excluded_patterns") > 0, F.col("excluded_patterns"))
        .otherwise(_strings(default.excluded_patterns))
        .alias("excluded_patterns"),
        text("documentation_mode", DEFAULT_MODE),
        text("selection_mode", default.selection_mode),
        listing("included_paths"),
        listing("include_patterns"),
        listing("important_files"),
        flag("show_full_structure", False),
        text("output_format", DEFAULT_OUTPUT["output_format"]),
        text("output_filename", DEFAULT_OUTPUT["output_filename"]),
        flag("append_timestamp", DEFAULT_OUTPUT["append_timestamp"]),
    )


def suggest(projects: DataFrame) -> DataFrame:
    """``(project, type)`` -> default toggles and extra exclude patterns of the type."""
    kind = F.lower("type")
    is_go, is_front = kind.isin(*GO_TYPES), kind.isin(*FRONTEND_TYPES)
    wide = F.when(is_go, F.lit(False)).otherwise(F.lit(True))
    extra = (
        F.when(is_go, _strings(SUGGESTED["go"]))
        .when(is_front, _strings(SUGGESTED["frontend"]))
        .otherwise(_strings(SUGGESTED["general"]))
    )
    return projects.select(
        "project",
        "type",
        F.lit(False).alias("include_tests"),
        F.lit(True).alias("include_configs"),
        wide.alias("include_markup"),
        wide.alias("include_styles"),
        F.lit(False).alias("include_docs"),
        F.concat(_strings(rules.DEFAULT_EXCLUDED), extra).alias("excluded_patterns"),
    )


def output_stem(filename: Column) -> Column:
    """Output name without directory and extension."""
    return F.regexp_replace(paths.base_name(filename), r"\.[^.]*\z", "")


def effective_excludes(excluded: Column, filename: Column, include_docs: Column) -> Column:
    """User patterns, earlier outputs, system names, documents when off; order kept, no duplicates."""
    stem = output_stem(filename)
    outputs = F.when(stem != "", F.array(F.concat(stem, F.lit(rules.DOC_PATTERN)))).otherwise(_strings([]))
    docs = F.when(include_docs, _strings([])).otherwise(_strings([rules.DOC_PATTERN]))
    user = F.array_union(F.array_distinct(excluded), outputs)
    return F.array_union(F.array_union(user, _strings(rules.SYSTEM_NAMES)), docs)


def _exclude_regex(directory: bool):  # noqa: ANN202
    @F.pandas_udf(T.StringType())
    def regex(excludes: pd.Series, important: pd.Series) -> pd.Series:
        rows = zip(excludes, important)
        return pd.Series([rules.exclude_regex(list(e), list(i), directory=directory) for e, i in rows])

    return regex


def compile_rules(profiles: DataFrame) -> DataFrame:
    """A stored copy of the profiles with the regexes of their pattern lists.

    Python is called once per profile, and the stored table has a known size:
    Spark sends it to every task only if it is small. A ``max_depth`` column is
    optional; without one no project has a depth limit.
    """
    ship_package(profiles.sparkSession)
    if "exclude_re" in profiles.columns:
        return profiles
    if "max_depth" not in profiles.columns:
        profiles = profiles.withColumn("max_depth", F.lit(None).cast("int"))
    excludes = effective_excludes(F.col("excluded_patterns"), F.col("output_filename"), F.col("include_docs"))
    compiled = (
        profiles.withColumn("exclude_re", _exclude_regex(False)(excludes, F.col("important_files")))
        .withColumn("prune_re", _exclude_regex(True)(excludes, F.col("important_files")))
        .withColumn("roots_re", globs.regex_column(F.col("included_paths"), "roots"))
        .withColumn("patterns_re", globs.regex_column(F.col("include_patterns"), "paths"))
    )
    return materialize(compiled, "profiles")


def _finds(path: Column, regex: str) -> Column:
    """The row's own regex finds a match. Unlike ``rlike``, this keeps the compiled pattern between rows."""
    return F.regexp_instr(path, F.col(regex)) > 0


def is_selected(path: Column) -> Column:
    """Selection by the compiled profile columns of the row."""
    mode = F.col("selection_mode")
    return (
        F.when((mode == "list") & (F.size("included_paths") > 0), _finds(path, "roots_re"))
        .when((mode == "patterns") & (F.size("include_patterns") > 0), _finds(path, "patterns_re"))
        .otherwise(True)
    )


def select(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """The files each project's own selection mode lets in."""
    rules_of = compile_rules(profiles).select(
        "project", "selection_mode", "included_paths", "include_patterns", "roots_re", "patterns_re"
    )
    joined = join_facts(files, rules_of, ["project"])
    return joined.filter(is_selected(F.col("path"))).select(*files.columns)


def _within_depth(path: Column) -> Column:
    return F.col("max_depth").isNull() | (paths.depth(path) <= F.col("max_depth") + 1)


def _is_listed(path: Column, config_stem: str) -> Column:
    """The name rules of tree and sections, by the compiled profile columns of the row."""
    filename = F.col("output_filename")
    outputs = rules.is_own_output(paths.base_name(path), filename, output_stem(filename))
    return _within_depth(path) & ~rules.is_own_config(path, config_stem) & ~outputs & ~_finds(path, "exclude_re")


def _is_off(path: Column) -> Column:
    """Dropped by a category toggle, unless the path ends in an important name."""
    important = F.exists(F.col("important_files"), lambda item: path.endswith(item))
    return rules.is_toggled_off(path, {flag: F.col(flag) for flag in rules.CATEGORIES}) & ~important


def listed(index: DataFrame, compiled: DataFrame, config_stem: str = Profile().config_stem) -> DataFrame:
    """The files of ``index`` that each project's own profile shows in its tree."""
    path = F.col("path")
    joined = join_facts(index, compiled, ["project"])
    return joined.filter(_is_listed(path, config_stem) & ~_is_off(path)).select(*index.columns)


def directories(index: DataFrame, compiled: DataFrame, config_stem: str = Profile().config_stem) -> DataFrame:
    """The directories that each project's own profile enters, ``(project, path, place)``; ``index`` is the whole scan."""
    found = tree.directories(index)
    path = F.col("path")
    pruned = _finds(path, "prune_re") | rules.is_own_config(path, config_stem)
    return join_facts(found, compiled, ["project"]).filter(_within_depth(path) & ~pruned).select(*found.columns)


def decided(index: DataFrame, compiled: DataFrame, config_stem: str = Profile().config_stem) -> DataFrame:
    """The files of ``index`` that get a section, with ``lang, skipped, documentation_mode``, by compiled profiles."""
    path, name = F.col("path"), paths.base_name(F.col("path"))
    leftovers = rules.is_leftover(name) & ~F.array_contains("important_files", name)
    kept = join_facts(index, compiled, ["project"]).filter(_is_listed(path, config_stem) & ~leftovers & is_selected(path))
    too_large = F.coalesce(F.col("size") > F.col("max_file_size"), F.lit(False))
    return kept.select(*index.columns, language(path).alias("lang"), (_is_off(path) | too_large).alias("skipped"), "documentation_mode")


def decide(files: DataFrame, profiles: DataFrame, config_stem: str = Profile().config_stem) -> DataFrame:
    """Per kept file ``project, path, size, lang, skipped`` under its project's profile.

    Only path, size and the presence of content are looked at, so the text
    itself is not shuffled; join it back by ``(project, path)`` where needed.
    """
    slim = files.select("project", "path", "size", F.col("content").isNull().alias("unreadable"))
    rows = decided(slim, compile_rules(profiles), config_stem)
    return rows.select("project", "path", "size", "lang", (F.col("skipped") | F.col("unreadable") | F.col("size").isNull()).alias("skipped"))
