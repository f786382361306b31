"""Globs, excludes, toggles and the keep/skip decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import globs, rules
from corpusloom.functions.paths import base_name
from corpusloom.functions.rules import Profile
from corpusloom.operators import scan, tree
from corpusloom.queries.registry import (
    FILES,
    default_user_sql,
    excluded_sql,
    language_sql,
    pruned_sql,
    query,
    system_dir_sql,
    system_name_sql,
)
from corpusloom.sources.derived import corpus


def _flags(spark: SparkSession, sf: str, tests: dict) -> DataFrame:
    columns = [test.alias(name) for name, test in tests.items()]
    return corpus(spark, sf).select("project", "path", *columns)


@query(
    "glob_basename",
    f"""
WITH {FILES}
SELECT project, path,
       regexp_matches(name, '\\.go$') AS any_go,
       regexp_matches(name, '^[a-m][^/]*_[^/][^/]?\\.[a-z]+$') AS early_short,
       regexp_matches(name, '^[^a-m][^/]*$') AS not_early,
       starts_with(name, '~$') AS temp,
       name = 'package.json' AS package,
       false AS broken
FROM files
""",
)
def glob_basename(spark: SparkSession, sf: str) -> DataFrame:
    name = base_name(F.col("path"))
    return _flags(
        spark,
        sf,
        {
            "any_go": globs.matches_name(name, ["*.go"]),
            "early_short": globs.matches_name(name, [f"[a-m]*_{n}.{e}" for n in ("?", "??") for e in ("[a-z]*",)])
            & ~globs.matches_name(name, ["*.*.*"]),
            "not_early": globs.matches_name(name, ["[^a-m]*"]),
            "temp": globs.matches_name(name, ["~$*"]),
            "package": globs.matches_name(name, ["package\\.json"]),
            "broken": globs.matches_name(name, ["[a-", "x[", "*\\"]),
        },
    )


@query(
    "glob_segments",
    f"""
WITH {FILES}
SELECT project, path,
       len(seg) = 1 AND regexp_matches(name, '\\.md$') AS root_md,
       len(seg) = 2 AND seg[1] = 'docs' AND regexp_matches(name, '\\.md$') AS docs_md,
       len(seg) = 4 AND seg[1] = 'src' AND seg[3] = 'deep' AND name LIKE '%.go' AS deep_go,
       (len(seg) = 1 AND name LIKE '%.json') OR (len(seg) = 2 AND seg[1] LIKE 'src' AND name LIKE 'v_ew%') AS either
FROM files
""",
)
def glob_segments(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _flags(
        spark,
        sf,
        {
            "root_md": globs.matches_path(path, ["*.md"]),
            "docs_md": globs.matches_path(path, ["docs/*.md"]),
            "deep_go": globs.matches_path(path, ["src/*/deep/*.go"]),
            "either": globs.matches_path(path, ["*.json", "s[q-s]c/v?ew*"]),
        },
    )


@query(
    "glob_doublestar",
    f"""
WITH {FILES}
SELECT project, path,
       name LIKE '%.go' AS any_go,
       seg[1] = 'src' AND len(seg) >= 2 AND name LIKE '%.ts' AS src_ts,
       seg[1] = 'src' AND len(seg) >= 2 AS under_src,
       list_contains(seg, 'vendor') AS vendored,
       seg[1] = 'src' AND len(seg) >= 3 AND seg[-2] = 'deep' AND name LIKE '%.js' AS deep_js,
       true AS everything
FROM files
""",
)
def glob_doublestar(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _flags(
        spark,
        sf,
        {
            "any_go": globs.matches_path(path, ["**/*.go"]),
            "src_ts": globs.matches_path(path, ["src/**/*.ts"]),
            "under_src": globs.matches_path(path, ["src/**"]),
            "vendored": globs.matches_path(path, ["**/vendor/**"]),
            "deep_js": globs.matches_path(path, ["src/**/deep/*.js"]),
            "everything": globs.matches_path(path, ["**"]),
        },
    )


PLAIN = Profile(excluded_patterns=(), output_filename="", include_docs=True)


@query(
    "system_excludes",
    f"""
WITH {FILES}
SELECT project, path,
       (len(list_filter(seg, lambda s: {system_name_sql("s")})) > 0
        OR len(list_filter(seg[:-2], lambda s: {system_dir_sql("s")})) > 0) AS excluded
FROM files
""",
)
def system_excludes(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf, {"excluded": rules.is_excluded(F.col("path"), PLAIN)})


USER = Profile(
    excluded_patterns=("user_*", "internal", "docs/**/*.md", "src/app/*.tsx"), output_filename="", include_docs=True
)


@query(
    "user_excludes",
    f"""
WITH {FILES}
SELECT project, path FROM files
WHERE NOT {excluded_sql("seg", "(starts_with(s, 'user_') OR s = 'internal')").replace(default_user_sql("s"), "false")}
  AND NOT (seg[1] = 'docs' AND len(seg) > 1 AND name LIKE '%.md')
  AND NOT (len(seg) = 3 AND seg[1] = 'src' AND seg[2] = 'app' AND name LIKE '%.tsx')
""",
)
def user_excludes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).filter(~rules.is_excluded(F.col("path"), USER)).select("project", "path")


PRUNE = Profile(excluded_patterns=("uti*", "docs/api"), include_docs=True)


@query(
    "dir_prune",
    f"""
WITH {FILES},
dirs AS (
  SELECT DISTINCT project, seg[:i] AS dseg FROM (SELECT project, seg, unnest(range(1, len(seg))) AS i FROM files)
)
SELECT project, array_to_string(dseg, '/') AS dir,
       ({pruned_sql("dseg", "starts_with(s, 'uti')").replace(default_user_sql("s"), "false")}
        OR (dseg[1] = 'docs' AND dseg[2] = 'api') IS TRUE) AS pruned
FROM dirs
""",
)
def dir_prune(spark: SparkSession, sf: str) -> DataFrame:
    dirs = tree.directories(corpus(spark, sf))
    return dirs.select("project", F.col("path").alias("dir"), rules.is_pruned(F.col("path"), PRUNE).alias("pruned"))


ARTIFACTS = Profile(output_filename="out/guide.md", config_stem="Settings", important_files=("go.sum",))


@query(
    "own_artifacts",
    f"""
WITH {FILES}
SELECT project, path,
       (contains(lower(name), 'settings') OR regexp_matches(name, '^guide.*\\.md$') OR starts_with(name, '~$')
        OR name IN ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml')) AS own
FROM files
""",
)
def own_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf, {"own": rules.is_own_artifact(base_name(F.col("path")), ARTIFACTS)})


@query(
    "type_toggles",
    f"""
WITH {FILES}
SELECT project, path,
       regexp_matches(lower(name), '\\.(css|scss|sass|less)$') AS style,
       regexp_matches(lower(name), '\\.html?$') AS markup,
       regexp_matches(lower(name), '\\.(json|ya?ml)$') OR contains(lower(name), 'config') AS config,
       contains(lower(name), '.spec.') OR contains(lower(name), '.test.') AS test,
       regexp_matches(lower(name), '\\.(md|markdown)$') AS doc,
       regexp_matches(lower(name), '\\.(css|scss|sass|less|html|htm)$') OR contains(lower(name), '.spec.')
         OR contains(lower(name), '.test.') AS off
FROM files
""",
)
def type_toggles(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    off = Profile(include_styles=False, include_markup=False, include_docs=True)
    return _flags(
        spark,
        sf,
        {
            "style": rules.is_style(path),
            "markup": rules.is_markup(path),
            "config": rules.is_config(path),
            "test": rules.is_test(path),
            "doc": rules.is_doc(path),
            "off": rules.is_type_skipped(path, off),
        },
    )


OVERRIDE = Profile(
    excluded_patterns=("*.json", "src", "go.mod"),
    important_files=("package.json", "go.mod", "node_modules", "main.ts"),
    include_configs=False,
    include_docs=True,
    output_filename="",
)


@query(
    "important_override",
    f"""
WITH {FILES}
SELECT project, path,
       {excluded_sql("seg", "(s LIKE '%.json' OR s = 'src' OR s = 'go.mod')", "['package.json', 'go.mod', 'node_modules', 'main.ts']").replace(default_user_sql("s"), "false")} AS excluded,
       ((regexp_matches(lower(name), '\\.(json|ya?ml)$') OR contains(lower(name), 'config') OR contains(lower(name), '.spec.')
         OR contains(lower(name), '.test.'))
        AND NOT (ends_with(path, 'package.json') OR ends_with(path, 'go.mod') OR ends_with(path, 'node_modules')
                 OR ends_with(path, 'main.ts'))) AS type_skipped
FROM files
""",
)
def important_override(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _flags(
        spark,
        sf,
        {"excluded": rules.is_excluded(path, OVERRIDE), "type_skipped": rules.is_type_skipped(path, OVERRIDE)},
    )


@query(
    "depth_limit",
    f"""
WITH {FILES},
nested AS (SELECT project, repeat('n/', (length(path) % 25)::INT) || path AS path FROM files)
SELECT project, path FROM nested WHERE len(string_split(path, '/')) <= 21
""",
)
def depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    nested = corpus(spark, sf).select(
        "project", F.concat(F.expr("repeat('n/', length(path) % 25)"), F.col("path")).alias("path")
    )
    return nested.filter(rules.within_depth(F.col("path"), 20))


STUBS = Profile(
    excluded_patterns=("*.txt", "*.log"),
    include_styles=False,
    include_docs=True,
    important_files=("theme_0.scss",),
)

STUBS_SQL = f"""
  SELECT project, path, {language_sql()} AS lang, size, content,
         ((regexp_matches(lower(name), '\\.(css|scss|sass|less)$') OR contains(lower(name), '.spec.')
           OR contains(lower(name), '.test.')) AND NOT ends_with(path, 'theme_0.scss')) AS skipped
  FROM files
  WHERE NOT {excluded_sql("seg", "s LIKE '%.txt' OR s LIKE '%.log'", "['theme_0.scss']").replace(default_user_sql("s"), "false")}
    AND NOT starts_with(name, '~$')
"""


@query(
    "kept_or_skipped",
    f"""
WITH {FILES}
SELECT project, path, lang, skipped, CASE WHEN NOT skipped THEN size END AS shown_bytes FROM ({STUBS_SQL})
""",
)
def kept_or_skipped(spark: SparkSession, sf: str) -> DataFrame:
    files = scan.classify(corpus(spark, sf), STUBS)
    shown = F.octet_length("content").cast("bigint").alias("shown_bytes")
    return files.select("project", "path", "lang", "skipped", shown)
