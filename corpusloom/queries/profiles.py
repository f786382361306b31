"""Profiles as a table: defaults, suggestions by type, decisions per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import detect, profiles
from corpusloom.queries.detect import TYPES_SQL
from corpusloom.queries.registry import FILES, language_sql, query, system_dir_sql, system_name_sql
from corpusloom.queries.trees import nodes_sql
from corpusloom.sources.derived import corpus

# Partial profiles for most projects, varied by the project's number of files n.
OVERRIDES = {
    "max_file_size": "CASE n % 3 WHEN 0 THEN 0 WHEN 2 THEN 3000 END",
    "include_tests": "CASE WHEN n % 2 = 1 THEN n % 4 = 1 END",
    "include_configs": "CASE WHEN n % 5 = 0 THEN false END",
    "include_markup": "CASE WHEN n % 3 = 0 THEN false END",
    "include_styles": "n % 4 <> 0",
    "include_docs": "CASE WHEN n % 2 = 0 THEN true END",
    "documentation_mode": "CASE WHEN n % 2 = 0 THEN '' ELSE 'headers' END",
    "selection_mode": "CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN 'list' WHEN 2 THEN 'patterns' WHEN 3 THEN 'all' ELSE 'interactive' END",
    "show_full_structure": "n % 2 = 0",
    "output_format": "CASE WHEN n % 2 = 0 THEN '' END",
    "output_filename": "CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'guide.md' ELSE 'out/notes.md' END",
    "append_timestamp": "CASE WHEN n % 2 = 1 THEN false END",
}
LISTS = {
    "excluded_patterns": ("n % 4", {1: [], 2: ["*.txt", "docs/api/**"], 3: ["user_*", "src/**/deep/*.go"]}),
    "included_paths": ("n % 10", {1: ["src/app", "docs/"], 6: []}),
    "include_patterns": ("n % 10", {2: ["**/*.go", "docs/*.md", "*.json"], 7: []}),
    "important_files": ("n % 3", {1: ["package.json", "go.mod"]}),
}


def _lists(opening: str, closing: str) -> dict[str, str]:
    out = {}
    for name, (selector, choices) in LISTS.items():
        arms = [
            f"WHEN {value} THEN {opening}{', '.join(repr(i) for i in items)}{closing}" for value, items in choices.items()
        ]
        out[name] = f"CASE {selector} {' '.join(arms)} END"
    return out


def overrides(files: DataFrame) -> DataFrame:
    sizes = files.groupBy("project").agg(F.count("*").alias("n")).filter("n % 7 <> 0")
    columns = {**OVERRIDES, **_lists("array(", ")")}
    return sizes.select("project", *[F.expr(sql).alias(name) for name, sql in columns.items()])


def profile_table(files: DataFrame) -> DataFrame:
    return profiles.resolve(files.select("project").distinct(), overrides(files))


def _oracle_columns() -> str:
    columns = {**OVERRIDES, **{k: v.replace("]", "]::VARCHAR[]") for k, v in _lists("[", "]").items()}}
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


PROFILES_SQL = f"""
overrides AS (
  SELECT project, {_oracle_columns()} FROM (SELECT project, count(*) AS n FROM files GROUP BY project) WHERE n % 7 <> 0
),
profiles AS (
  SELECT p.project,
         CASE WHEN coalesce(max_file_size, 0) = 0 THEN 2097152 ELSE max_file_size END::BIGINT AS max_file_size,
         coalesce(include_tests, false) AS include_tests, coalesce(include_configs, true) AS include_configs,
         coalesce(include_markup, true) AS include_markup, coalesce(include_styles, true) AS include_styles,
         coalesce(include_docs, false) AS include_docs,
         CASE WHEN coalesce(len(excluded_patterns), 0) = 0
              THEN ['.gitignore', '.DS_Store', 'Thumbs.db', '*.log', '*.tmp', '*.bak'] ELSE excluded_patterns END AS excluded_patterns,
         CASE WHEN coalesce(documentation_mode, '') = '' THEN 'full' ELSE documentation_mode END AS documentation_mode,
         CASE WHEN coalesce(selection_mode, '') = '' THEN 'all' ELSE selection_mode END AS selection_mode,
         coalesce(included_paths, []::VARCHAR[]) AS included_paths,
         coalesce(include_patterns, []::VARCHAR[]) AS include_patterns,
         coalesce(important_files, []::VARCHAR[]) AS important_files,
         coalesce(show_full_structure, false) AS show_full_structure,
         CASE WHEN coalesce(output_format, '') = '' THEN 'markdown' ELSE output_format END AS output_format,
         CASE WHEN coalesce(output_filename, '') = '' THEN 'project_docs.md' ELSE output_filename END AS output_filename,
         coalesce(append_timestamp, true) AS append_timestamp
  FROM (SELECT DISTINCT project FROM files) p LEFT JOIN overrides o ON p.project = o.project
)
"""
ARRAYS = ("excluded_patterns", "included_paths", "include_patterns", "important_files")


@query(
    "resolve_profiles",
    f"""
WITH {FILES}, {PROFILES_SQL}
SELECT * REPLACE ({", ".join(f"array_to_string({a}, ',') AS {a}" for a in ARRAYS)}) FROM profiles
""",
)
def resolve_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return profile_table(corpus(spark, sf)).withColumns({a: F.array_join(a, ",") for a in ARRAYS})


@query(
    "type_profiles",
    f"""
WITH {FILES},
typed AS (
  SELECT project, (['Go', 'angular', 'NX', 'browser-extension', 'rust', 'React', 'go', 'unknown'])[count(*) % 8 + 1] AS type
  FROM files GROUP BY project
)
SELECT project, type, false AS include_tests, true AS include_configs, lower(type) <> 'go' AS include_markup,
       lower(type) <> 'go' AS include_styles, false AS include_docs,
       '.gitignore,.DS_Store,Thumbs.db,*.log,*.tmp,*.bak,' || CASE
         WHEN lower(type) = 'go' THEN 'vendor/**,*.exe,*.dll,*.so,*.dylib'
         WHEN lower(type) IN ('angular', 'nx', 'browser-extension', 'react') THEN 'dist/**,build/**,.angular/**,.nx/**,coverage/**'
         ELSE '*.log,*.tmp,*.bak' END AS excluded_patterns
FROM typed
""",
)
def type_profiles(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["Go", "angular", "NX", "browser-extension", "rust", "React", "go", "unknown"]))
    typed = (
        corpus(spark, sf)
        .groupBy("project")
        .agg(F.element_at(kinds, (F.count("*") % 8 + 1).cast("int")).alias("type"))
    )
    return profiles.suggest(typed).withColumn("excluded_patterns", F.array_join("excluded_patterns", ","))


@query(
    "suggested_profiles",
    f"""
WITH {FILES}, {TYPES_SQL}
SELECT project, 2097152::BIGINT AS max_file_size, false AS include_tests, true AS include_configs, type <> 'go' AS include_markup,
       type <> 'go' AS include_styles, false AS include_docs,
       '.gitignore,.DS_Store,Thumbs.db,*.log,*.tmp,*.bak,' || CASE
         WHEN type = 'go' THEN 'vendor/**,*.exe,*.dll,*.so,*.dylib'
         WHEN type IN ('angular', 'nx', 'browser-extension', 'js') THEN 'dist/**,build/**,.angular/**,.nx/**,coverage/**'
         ELSE '*.log,*.tmp,*.bak' END AS excluded_patterns,
       'full' AS documentation_mode, 'all' AS selection_mode, '' AS included_paths, '' AS include_patterns, '' AS important_files,
       false AS show_full_structure, 'markdown' AS output_format, 'project_docs.md' AS output_filename, true AS append_timestamp
FROM types
""",
)
def suggested_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """What a project's detected type suggests, made a whole profile."""
    files = corpus(spark, sf)
    table = profiles.resolve(files.select("project").distinct(), profiles.suggest(detect.project_types(files)))
    return table.withColumns({a: F.array_join(a, ",") for a in ARRAYS})


@query(
    "effective_excludes",
    f"""
WITH {FILES}, {PROFILES_SQL},
parts AS (
  SELECT project, 1 AS part, i, p FROM (SELECT project, unnest(excluded_patterns) AS p, unnest(range(len(excluded_patterns))) AS i FROM profiles)
  UNION ALL SELECT project, 2, 0, regexp_replace(string_split(output_filename, '/')[-1], '\\.[^.]*$', '') || '*.md' FROM profiles
  UNION ALL SELECT project, 3, i, p FROM profiles CROSS JOIN (
    SELECT unnest(['node_modules', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'go.sum', '.git', '.idea', '.vscode',
      'dist', 'build', 'out', 'bin', 'obj', '__pycache__', '.pytest_cache', 'coverage', '.nyc_output', '.angular', '.nx',
      '.next', '.nuxt', '__tests__', '__snapshots__', 'e2e', '*.log', '*.tmp', '*.bak', '*.png', '*.jpg', '*.jpeg', '*.gif',
      '*.ico', '*.svg', '*.bmp', '*.webp', 'project_structure.txt']) AS p, unnest(range(36)) AS i)
  UNION ALL SELECT project, 4, 0, '*.md' FROM profiles WHERE NOT include_docs
),
firsts AS (SELECT project, p, min((part, i)) AS place FROM parts GROUP BY project, p)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY place) AS ord, p AS pattern FROM firsts
""",
)
def effective_excludes(spark: SparkSession, sf: str) -> DataFrame:
    table = profile_table(corpus(spark, sf))
    merged = profiles.effective_excludes(F.col("excluded_patterns"), F.col("output_filename"), F.col("include_docs"))
    items = table.select("project", F.posexplode(merged).alias("pos", "pattern"))
    return items.select("project", (F.col("pos") + 1).cast("bigint").alias("ord"), "pattern")


SELECTED_SQL = """
  CASE WHEN selection_mode = 'list' AND len(included_paths) > 0
         THEN len(list_filter(included_paths, lambda r: path = rtrim(r, '/') OR starts_with(path, rtrim(r, '/') || '/'))) > 0
       WHEN selection_mode = 'patterns' AND len(include_patterns) > 0
         THEN path LIKE '%.go' OR regexp_matches(path, '^docs/[^/]*\\.md$') OR regexp_matches(path, '^[^/]*\\.json$')
       ELSE true END
"""


@query(
    "select_mode",
    f"""
WITH {FILES}, {PROFILES_SQL}
SELECT f.project, path, selection_mode FROM files f JOIN profiles p ON f.project = p.project WHERE {SELECTED_SQL}
""",
)
def select_mode(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    table = profile_table(files)
    chosen = profiles.select(files.select("project", "path"), table)
    return chosen.join(table.select("project", "selection_mode"), "project")


def _entry(s: str) -> str:
    """A segment excluded by a project's own profile, written out for the patterns in use."""
    return f"""({system_name_sql(s)}
      OR (list_contains(excluded_patterns, '*.txt') AND {s} LIKE '%.txt')
      OR (list_contains(excluded_patterns, 'user_*') AND starts_with({s}, 'user_'))
      OR (list_contains(excluded_patterns, '.gitignore') AND {s} IN ('.gitignore', '.DS_Store', 'Thumbs.db'))
      OR (NOT include_docs AND {s} LIKE '%.md')
      OR regexp_matches({s}, '^' || stem || '.*\\.md$'))"""


def _no_own_pattern_sql() -> str:
    """Not excluded by a pattern with a slash, nor an output of the project's own."""
    return """NOT (list_contains(excluded_patterns, 'docs/api/**') AND starts_with(path, 'docs/api/'))
    AND NOT (list_contains(excluded_patterns, 'src/**/deep/*.go') AND regexp_matches(path, '^src/(.*/)?deep/[^/]*\\.go$'))
    AND name <> string_split(output_filename, '/')[-1]
    AND NOT regexp_matches(name, '^' || stem || '.*\\.md$')"""


TOGGLED_SQL = """(((NOT include_styles AND regexp_matches(lower(name), '\\.(css|scss|sass|less)$'))
           OR (NOT include_markup AND regexp_matches(lower(name), '\\.html?$'))
           OR (NOT include_configs AND (regexp_matches(lower(name), '\\.(json|ya?ml)$') OR contains(lower(name), 'config')))
           OR (NOT include_tests AND (contains(lower(name), '.spec.') OR contains(lower(name), '.test.')))
           OR (NOT include_docs AND regexp_matches(lower(name), '\\.(md|markdown)$')))
          AND len(list_filter(important_files, lambda x: ends_with(path, x))) = 0)"""


DECIDED_SQL = f"""
joined AS (
  SELECT f.*, p.* EXCLUDE (project),
         regexp_replace(string_split(output_filename, '/')[-1], '\\.[^.]*$', '') AS stem
  FROM files f JOIN profiles p ON f.project = p.project
),
decided AS (
  SELECT project, path, size, {language_sql()} AS lang,
         {TOGGLED_SQL}
         OR size > max_file_size AS skipped
  FROM joined
  WHERE len(list_filter(seg, lambda s: {_entry("s")} AND NOT list_contains(important_files, s))) = 0
    AND len(list_filter(seg[:-2], lambda s: {system_dir_sql("s")} AND NOT list_contains(important_files, s))) = 0
    AND {_no_own_pattern_sql()}
    AND NOT starts_with(name, '~$')
    AND {SELECTED_SQL}
)
"""


def tree_by_profile_sql() -> str:
    """Nodes, order and drawn lines of each project's tree under its own profile."""
    dirs = """(SELECT DISTINCT project, seg[:i] AS seg FROM (SELECT project, seg, unnest(range(1, len(seg))) AS i FROM files))"""
    nodes = f"""
nodes AS (
  SELECT project, seg, true AS is_dir FROM (
    SELECT d.project, d.seg, p.*  EXCLUDE (project), array_to_string(d.seg, '/') AS path,
           regexp_replace(string_split(output_filename, '/')[-1], '\\.[^.]*$', '') AS stem
    FROM {dirs} d JOIN profiles p ON p.project = d.project)
  WHERE len(list_filter(seg, lambda s: ({_entry("s")} OR {system_dir_sql("s")}) AND NOT list_contains(important_files, s))) = 0
    AND NOT (list_contains(excluded_patterns, 'docs/api/**') AND starts_with(path || '/', 'docs/api/'))
  UNION ALL
  SELECT project, seg, false FROM joined
  WHERE len(list_filter(seg, lambda s: {_entry("s")} AND NOT list_contains(important_files, s))) = 0
    AND len(list_filter(seg[:-2], lambda s: {system_dir_sql("s")} AND NOT list_contains(important_files, s))) = 0
    AND {_no_own_pattern_sql()} AND NOT {TOGGLED_SQL}
)"""
    rest = nodes_sql()
    return f"{nodes},{rest[rest.index('keyed AS') :].rstrip()}"


@query(
    "profile_decisions",
    f"WITH {FILES}, {PROFILES_SQL}, {DECIDED_SQL} SELECT * FROM decided",
)
def profile_decisions(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return profiles.decide(files, profile_table(files))


@query(
    "rule_counts",
    f"""
WITH {FILES}, {PROFILES_SQL}
SELECT project, selection_mode, CASE selection_mode WHEN 'list' THEN len(included_paths)
       WHEN 'patterns' THEN len(include_patterns) ELSE 0 END::BIGINT AS n_rules,
       selection_mode IN ('list', 'patterns', 'interactive') AS selects,
       selection_mode IN ('all', 'list', 'patterns', 'interactive') AS valid
FROM profiles
""",
)
def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    from corpusloom.functions import rules

    mode = F.col("selection_mode")
    return profile_table(corpus(spark, sf)).select(
        "project",
        "selection_mode",
        rules.rule_count(mode, F.col("included_paths"), F.col("include_patterns")).alias("n_rules"),
        rules.has_selection(mode).alias("selects"),
        rules.is_valid_mode(mode).alias("valid"),
    )
