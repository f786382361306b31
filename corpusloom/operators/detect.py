"""Project types and frameworks, from which files a project has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "package.json"

# The files and dependencies that tell project types apart.
NX_FILES = ("nx.json", "workspace.json")
NX_DIRS = ("apps", "libs")
EXTENSION_FILES = ("manifest.json", "background.js", "content-script.js", "popup.html", "service-worker.js")
ANGULAR_FILES = ("angular.json", "src/main.ts", "src/index.html")
ANGULAR_DEPENDENCY = "@angular/core"
GO_MODULE = "go.mod"
JS_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
JS_DIRS = ("src", "app", "lib")

# Per framework its files, how many of them suffice, its dependency.
FRAMEWORKS = (
    ("Angular", ("angular.json", "src/main.ts"), 2, None),
    ("React", ("src/App.jsx", "src/App.tsx", "src/index.js"), 2, "react"),
    ("Vue", ("vue.config.js", "src/App.vue", "src/main.js"), 2, "vue"),
    ("Svelte", ("svelte.config.js", "src/App.svelte"), 2, "svelte"),
)
PLAIN_FRAMEWORK = "JavaScript"

CONFLICT, UNSUPPORTED, OK = "conflict", "unsupported", "ok"


def _has(paths: tuple[str, ...]) -> Column:
    return F.coalesce(F.bool_or(F.col("path").isin(*paths)), F.lit(False))


def _found(paths: tuple[str, ...]) -> Column:
    """How many of the listed paths exist; paths are unique within a project."""
    return F.count_if(F.col("path").isin(*paths))


def _has_dir(name: str) -> Column:
    return F.bool_or(F.col("path").startswith(name + "/"))


def dependencies(files: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """``(project, dependency)`` for each name that the root manifest mentions in quotes."""
    manifest = files.filter(F.col("path") == MANIFEST).select("project", "content")
    probes = F.explode(F.array(*map(F.lit, names))).alias("dependency")
    quoted = F.concat(F.lit('"'), F.col("dependency"), F.lit('"'))
    return manifest.select("project", "content", probes).filter(F.contains("content", quoted)).drop("content")


def _with_dependencies(files: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``deps``, the found ones among ``names`` (a fixed list, so a small array)."""
    found = dependencies(files, names).groupBy("project").agg(F.collect_set("dependency").alias("deps"))
    none = F.array().cast("array<string>")
    return facts.join(found, "project", "left").withColumn("deps", F.coalesce("deps", none))


def project_types(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(project, type, status)``; the first rule that holds decides.

    Paths are taken from ``index`` if it is given, and only manifests from ``files``.

    ``status`` is ``conflict`` for a Go module that is also a package (the type
    is then empty) and ``unsupported`` when nothing matches. Paths are read in
    one pass that combines before the shuffle; text is read for the root
    manifests only.
    """
    path = F.col("path")
    at_root = ~path.contains("/")
    lower = F.lower(path)
    is_script = F.lit(False)
    for ext in JS_EXTENSIONS:
        is_script = is_script | lower.endswith(ext)
    facts = (files if index is None else index).groupBy("project").agg(
        _has((GO_MODULE,)).alias("go_mod"),
        _has((MANIFEST,)).alias("manifest"),
        (_has(NX_FILES) | (_has_dir(NX_DIRS[0]) & _has_dir(NX_DIRS[1]))).alias("nx"),
        (_found(EXTENSION_FILES) >= 3).alias("browser"),
        (_found(ANGULAR_FILES) >= 2).alias("angular"),
        F.bool_or(at_root & path.endswith(".go")).alias("go_files"),
        F.bool_or((at_root & is_script) | F.substring_index(path, "/", 1).isin(*JS_DIRS) & ~at_root).alias("js_files"),
    )
    known = _with_dependencies(files, facts, [ANGULAR_DEPENDENCY])
    conflict = F.col("go_mod") & F.col("manifest")
    kind = (
        F.when(conflict, F.lit(""))
        .when(F.col("nx"), F.lit("nx"))
        .when(F.col("browser"), F.lit("browser-extension"))
        .when(F.col("angular") | F.array_contains("deps", ANGULAR_DEPENDENCY), F.lit("angular"))
        .when(F.col("go_mod") | F.col("go_files"), F.lit("go"))
        .when(F.col("manifest") | F.col("js_files"), F.lit("js"))
        .otherwise(F.lit("unknown"))
    )
    status = F.when(conflict, F.lit(CONFLICT)).when(F.col("type") == "unknown", F.lit(UNSUPPORTED)).otherwise(F.lit(OK))
    return known.withColumn("type", kind).select("project", "type", status.alias("status"))


def conflicts(files: DataFrame) -> DataFrame:
    """Projects holding both a Go module file and a package manifest at the root."""
    return (
        files.filter(F.col("path").isin(GO_MODULE, MANIFEST))
        .groupBy("project")
        .agg(F.count_distinct("path").alias("n"))
        .filter("n = 2")
        .select("project")
    )


def frameworks(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(project, framework)``; the first framework whose files or dependency are found. ``index`` as in ``project_types``."""
    counts = [_found(paths).alias(f"n{i}") for i, (_, paths, _, _) in enumerate(FRAMEWORKS)]
    facts = (files if index is None else index).groupBy("project").agg(*counts)
    known = _with_dependencies(files, facts, [d for *_, d in FRAMEWORKS if d])
    name = F.lit(PLAIN_FRAMEWORK)
    for i, (label, _, enough, dependency) in reversed(list(enumerate(FRAMEWORKS))):
        hit = F.col(f"n{i}") >= enough
        if dependency:
            hit = hit | F.array_contains("deps", dependency)
        name = F.when(hit, F.lit(label)).otherwise(name)
    return known.select("project", name.alias("framework"))
