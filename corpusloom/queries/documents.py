"""Whole documents and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rules import Profile
from corpusloom.operators import render, saved
from corpusloom.plans import jobs
from corpusloom.plans.ranking import path_index
from corpusloom.queries.detect import FRAMEWORK_SQL, TYPES_SQL
from corpusloom.queries.monorepo import CHOICE_SQL, OVERVIEW_SQL, WIDE_SQL, choices, wide
from corpusloom.queries.headers import LINES_SQL
from corpusloom.queries.profiles import DECIDED_SQL, PROFILES_SQL, profile_table, tree_by_profile_sql
from corpusloom.queries.registry import FILES, excluded_sql, pruned_sql, query
from corpusloom.queries.sections import (
    HEADERS_SQL,
    MODULES,
    ROOT_CONFIGS,
    SECTION_SQL,
    STAMP,
    TREE_CLOSE,
    TREE_OPEN,
    head_sql,
    n,
    run_ts,
)
from corpusloom.queries.trees import nodes_sql
from corpusloom.session import materialize
from corpusloom.sources.derived import corpus
from corpusloom.sources.documents import pieces

PROFILE = Profile(
    include_styles=False,
    include_docs=True,
    important_files=("package.json", "nx.json"),
    excluded_patterns=("*.log", "*.txt"),
)
ENTRY = "(s LIKE '%.log' OR s LIKE '%.txt' OR (starts_with(s, 'project_docs') AND s LIKE '%.md'))"
KEEP = "['package.json', 'nx.json', 'go.mod']"
OFF_SQL = """((regexp_matches(lower(name), '\\.(css|scss|sass|less)$') OR contains(lower(name), '.spec.')
  OR contains(lower(name), '.test.')) AND NOT (ends_with(path, 'package.json') OR ends_with(path, 'nx.json')))"""


def body_sql(files: str, type_rule: str) -> str:
    """Nodes, tree lines and sections of the files of one CTE."""
    stay = f"NOT {excluded_sql('seg', ENTRY, KEEP)}"
    drop = f"AND NOT {OFF_SQL}" if type_rule == "remove" else ""
    stub = "false" if type_rule == "remove" else OFF_SQL
    return f"""
{nodes_sql(files, f"{stay} AND NOT {OFF_SQL}", pruned_sql("seg", ENTRY, KEEP))},
classified AS (
  SELECT project, path, content, {stub} AS skipped,
         list_transform(seg, lambda s, i: CASE WHEN i < len(seg) THEN '0' ELSE '1' END || s) AS key
  FROM {files} WHERE {stay} AND NOT starts_with(name, '~$') {drop}
),
body AS (
  SELECT project, 1 AS step, []::VARCHAR[] AS key, 0 AS line, {{open}} AS markdown FROM wanted
  UNION ALL SELECT project, 2, [], ord, line || chr(10) FROM tree_lines
  UNION ALL SELECT project, 2, [], 0, '.' || chr(10) FROM wanted WHERE project NOT IN (SELECT project FROM placed)
  UNION ALL SELECT project, 3, [], 0, {n(TREE_CLOSE)} FROM wanted
  UNION ALL SELECT project, 4, [], 0, {n(MODULES)} FROM wanted
  UNION ALL SELECT project, 5, key, 0, {SECTION_SQL} FROM classified
)"""


def document_sql(type_rule: str, before: str, wanted: str) -> str:
    return f"""
WITH {FILES}, {TYPES_SQL}, {before}
wanted AS ({wanted}),
{body_sql("files", type_rule).replace("{open}", n(TREE_OPEN))},
every AS (
  SELECT project, 0 AS step, []::VARCHAR[] AS key, 0 AS line, {head_sql("kind")} AS markdown FROM wanted
  UNION ALL SELECT * FROM body WHERE project IN (SELECT project FROM wanted)
)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY step, key, line) AS ord, markdown FROM every
"""


@query("document_lines", document_sql("remove", "", "SELECT project, type AS kind FROM types WHERE status = 'ok'"))
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return jobs.number(jobs.document(files, PROFILE, run_ts()))


@query("document_go", document_sql("stub", "", "SELECT project, 'Go проект' AS kind FROM types WHERE type = 'go'"))
def document_go(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return jobs.number(jobs.document_go(files, PROFILE, run_ts()))


@query(
    "document_js",
    document_sql(
        "stub",
        FRAMEWORK_SQL + ",",
        "SELECT project, framework || ' проект' AS kind FROM types JOIN frameworks USING (project) "
        "WHERE type IN ('js', 'angular', 'browser-extension')",
    ),
)
def document_js(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    return jobs.number(jobs.document_js(files, PROFILE, run_ts()))


#: Whole documents under each project's own profile, before they are numbered: rows of (project, step, key, line, markdown).
BY_PROFILE_SQL = f"""
{TYPES_SQL},
wanted AS (SELECT project, type AS kind FROM types WHERE status = 'ok'),
{tree_by_profile_sql()},
{LINES_SQL}, {HEADERS_SQL},
classified AS (
  SELECT d.project, d.path, d.skipped, f.content, f.seg, p.documentation_mode, s.markdown AS brief,
         list_transform(f.seg, lambda s, i: CASE WHEN i < len(f.seg) THEN '0' ELSE '1' END || s) AS key
  FROM decided d JOIN files f ON f.project = d.project AND f.path = d.path JOIN profiles p ON p.project = d.project
  JOIN short s ON s.project = d.project AND s.path = d.path
),
every AS (
  SELECT project, 0 AS step, []::VARCHAR[] AS key, 0 AS line, {head_sql("kind")} AS markdown FROM wanted
  UNION ALL SELECT project, 1, [], 0, {n(TREE_OPEN)} FROM wanted
  UNION ALL SELECT project, 2, [], ord, line || chr(10) FROM tree_lines WHERE ord > 0
  UNION ALL SELECT project, 2, [], 0, '.' || chr(10) FROM wanted
  UNION ALL SELECT project, 3, [], 0, {n(TREE_CLOSE)} FROM wanted
  UNION ALL SELECT project, 4, [], 0, {n(MODULES)} FROM wanted
  UNION ALL SELECT project, 5, key, 0, CASE WHEN NOT skipped AND documentation_mode = 'headers' THEN brief ELSE {SECTION_SQL} END FROM classified
),
documents_by_profile AS (SELECT * FROM every WHERE project IN (SELECT project FROM wanted))
"""
OUTPUT_SQL = f"""CASE WHEN append_timestamp THEN regexp_replace(output_filename, '\\.[^./]*$', '') || '_{STAMP}' ||
         regexp_extract(output_filename, '\\.[^./]*$') ELSE output_filename END"""


def outputs(table: DataFrame) -> DataFrame:
    """``(project, output)`` of a profile table."""
    return table.select("project", render.output_name(F.col("output_filename"), F.col("append_timestamp"), run_ts()).alias("output"))


@query(
    "document_profiles",
    f"""
WITH {FILES}, {PROFILES_SQL}, {DECIDED_SQL}, {BY_PROFILE_SQL}
SELECT project, {OUTPUT_SQL} AS output, row_number() OVER (PARTITION BY project ORDER BY step, key, line) AS ord, markdown
FROM documents_by_profile JOIN profiles USING (project)
""",
)
def document_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of every project under its own profile: tree and sections, mode, selection, toggles, excludes and output name."""
    files, table = corpus(spark, sf), profile_table(corpus(spark, sf))
    numbered = jobs.number(jobs.document_by_profile(files, table, run_ts()))
    return numbered.join(outputs(table), "project").select("project", "output", "ord", "markdown")


#: Small enough that most documents of the table have several pieces.
PIECE_BYTES = 20_000


@query(
    "document_pieces",
    f"""
WITH {FILES}, {PROFILES_SQL}, {DECIDED_SQL}, {BY_PROFILE_SQL},
sized AS (
  SELECT project, row_number() OVER ord AS ord, strlen(markdown) AS bytes, sum(strlen(markdown)) OVER ord - strlen(markdown) AS start
  FROM documents_by_profile WINDOW ord AS (PARTITION BY project ORDER BY step, key, line)
)
SELECT project, {OUTPUT_SQL} AS output,
       (2 * (start // {PIECE_BYTES // 2}) + CASE WHEN bytes > {PIECE_BYTES // 2} THEN 1 ELSE 0 END)::BIGINT AS piece, ord, bytes
FROM sized JOIN profiles USING (project)
""",
)
def document_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Where each section of those documents is written: name, piece, position, bytes."""
    files, table = corpus(spark, sf), profile_table(corpus(spark, sf))
    placed = pieces(jobs.document_by_profile(files, table, run_ts()), PIECE_BYTES)
    return placed.join(outputs(table), "project").select("project", "output", "piece", "ord", "bytes")


#: What a project asks for, by its number of files n: the last selection, one by name, paths, nothing, or one that was never saved.
ASKED = {
    "use_last": "n % 5 = 0",
    "name": "CASE n % 5 WHEN 1 THEN 'the docs' WHEN 2 THEN 'never saved' END",
    "paths": "CASE WHEN n % 5 = 3 THEN 'src/app , package.json' END",
}


@query(
    "document_selected",
    f"""
WITH {FILES}, {PROFILES_SQL.replace("profiles AS (", "own_profiles AS (")},
counted AS (SELECT project, count(*) AS n, max(path) AS top FROM files GROUP BY project),
asked AS (SELECT project, top, {", ".join(f"{sql} AS {name}" for name, sql in ASKED.items())} FROM counted),
profiles AS (
  SELECT p.* REPLACE (
           CASE WHEN use_last OR name = 'the docs' OR paths <> '' THEN 'list' WHEN name <> '' THEN selection_mode
                WHEN selection_mode IN ('list', 'patterns', 'interactive') THEN selection_mode ELSE 'all' END AS selection_mode,
           CASE WHEN use_last THEN ['src', top] WHEN name = 'the docs' THEN ['docs/'] WHEN paths <> '' THEN ['src/app', 'package.json']
                ELSE included_paths END AS included_paths),
         CASE WHEN name = 'never saved' THEN 'not_found' ELSE 'ok' END AS status
  FROM own_profiles p JOIN asked a ON a.project = p.project
),
{DECIDED_SQL}, {BY_PROFILE_SQL}
SELECT project, 'ok' AS status, row_number() OVER (PARTITION BY project ORDER BY step, key, line) AS ord, markdown
FROM documents_by_profile WHERE project IN (SELECT project FROM profiles WHERE status = 'ok')
UNION ALL SELECT project, status, 0, NULL FROM profiles WHERE status <> 'ok'
""",
)
def document_selected(spark: SparkSession, sf: str) -> DataFrame:
    """From requests and the log of saved selections to documents; a request that found nothing is a row of its own."""
    files = corpus(spark, sf)
    counted = files.groupBy("project").agg(F.count("*").alias("n"), F.max("path").alias("top"))
    requests = counted.select("project", *[F.expr(sql).alias(name) for name, sql in ASKED.items()])
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created")
    text = F.lit("").alias("description")
    docs, src = F.array(F.lit("docs/")).alias("paths"), F.array(F.lit("src"), F.col("top")).alias("paths")
    entries = (
        counted.select("project", F.lit(1).cast("bigint").alias("seq"), F.lit("the_docs").alias("name"), text, stamp, docs)
        .unionByName(counted.select("project", F.lit(2).cast("bigint").alias("seq"), F.lit("newest").alias("name"), text, stamp, src))
    )
    table = materialize(saved.dispatch(profile_table(files), requests, saved.saves(entries)), "dispatched")
    numbered = jobs.number(jobs.document_by_profile(files, table, run_ts()))
    failed = table.filter("status <> 'ok'").select("project", "status", F.lit(0).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("markdown"))
    return numbered.select("project", F.lit("ok").alias("status"), "ord", "markdown").unionByName(failed)


def line_counts(path: str, content: str | None) -> list[str]:
    """A section of one's own: the lines of a Go file, and its longest."""
    if not path.endswith(".go") or content is None:
        return []
    lines = content.split("\n")
    return [f"- `{path}`: {len(lines)} lines\n", f"  - longest: {max(map(len, lines))}\n"]


@query(
    "document_custom",
    document_sql("remove", "", "SELECT project, type AS kind FROM types WHERE status = 'ok'").replace(
        "UNION ALL SELECT * FROM body WHERE",
        """UNION ALL SELECT project, 6, [], 0, '## Lines' || chr(10) FROM wanted
  UNION ALL SELECT project, 7, key, line, text FROM (
    SELECT project, list_transform(seg, lambda s, i: CASE WHEN i < len(seg) THEN '0' ELSE '1' END || s) AS key, unnest([0, 1]) AS line,
           unnest(['- `' || path || '`: ' || len(string_split(content, chr(10))) || ' lines' || chr(10),
                   '  - longest: ' || list_max(list_transform(string_split(content, chr(10)), lambda x: length(x))) || chr(10)]) AS text
    FROM files WHERE name LIKE '%.go') WHERE project IN (SELECT project FROM wanted)
  UNION ALL SELECT * FROM body WHERE""",
    ),
)
def document_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A document with a section kind of the user's own after the file sections."""
    files = corpus(spark, sf)
    index = path_index(files)
    whole = jobs.document(files, PROFILE, run_ts(), index=index)
    projects = whole.filter("part = 0").select("project")
    own = render.custom_fragments(files.join(projects, "project", "left_semi"), line_counts, 1, step=7)
    title = render.fragments(projects, "## Lines\n", 1, step=6)
    return jobs.number(whole.unionByName(title).unionByName(own))


@query(
    "document_monorepo",
    f"""
WITH {FILES}, {WIDE_SQL}, {CHOICE_SQL}, {TYPES_SQL.replace("FROM files", "FROM wide")},
repos AS (SELECT project FROM types WHERE type = 'nx'),
picked_subs AS (SELECT * FROM picked WHERE project IN (SELECT project FROM repos)),
chosen AS (SELECT DISTINCT project FROM picked_subs),
root_list AS (
  SELECT project, path FROM wide WHERE len(seg) = 1 AND project IN (SELECT project FROM chosen) AND NOT starts_with(name, '~$')
    AND name NOT LIKE '%.log' AND name NOT LIKE '%.txt' AND name NOT IN ('go.sum', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml')
),
{OVERVIEW_SQL.replace("s.root,\n", "s.root || '#' || lpad(s.pick::VARCHAR, 9, '0'),\n").replace("s.root DESC)", "s.root DESC, s.pick DESC)")},
unit_files AS (
  SELECT project, path, content, size, string_split(path, '/') AS seg, string_split(path, '/')[-1] AS name FROM (
    SELECT w.project || '#' || p.pick AS project, substring(w.path, length(p.root) + 2) AS path, w.content, w.size
    FROM wide w JOIN picked_subs p ON p.project = w.project AND starts_with(w.path, p.root || '/'))
),
wanted AS (SELECT project || '#' || pick AS project FROM picked_subs),
{body_sql("unit_files", "stub").replace("{open}", n("#" + TREE_OPEN))},
configs AS (
  SELECT project, pos, path, content, false AS skipped
  FROM wide JOIN (VALUES (1, 'package.json'), (2, 'nx.json')) l(pos, listed) ON path = listed
  WHERE project IN (SELECT project FROM chosen)
),
every AS (
  SELECT project, 0 AS part, 0 AS unit, 0 AS step, []::VARCHAR[] AS key, 0 AS line, {head_sql("'NX Monorepo'")} AS markdown FROM chosen
  UNION ALL SELECT project, 1, 0, 0, [], 0, {n("## Общая структура Nx Monorepo" + chr(10) * 2 + "```" + chr(10))} FROM chosen
  UNION ALL SELECT project, 2, 0, 0, [], ord, line || chr(10) FROM overview
  UNION ALL SELECT project, 3, 0, 0, [], 0, {n("```" + chr(10) * 2)} FROM chosen
  UNION ALL SELECT DISTINCT project, 4, 0, 0, []::VARCHAR[], 0, {n(ROOT_CONFIGS)} FROM configs
  UNION ALL SELECT project, 5, pos, 0, [], 0, {SECTION_SQL} FROM configs
  UNION ALL SELECT project, 6, pick, 0, [], 0, chr(10) || '## Проект: ' || name || ' (' || type || ')' ||
    {n(chr(10) * 2 + "**Путь:** ")} || root || {n(chr(10) * 2)} FROM picked_subs
  UNION ALL SELECT string_split(project, '#')[1], 6, string_split(project, '#')[2]::BIGINT, step, key, line, markdown FROM body
)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, unit, step, key, line) AS ord, markdown FROM every
""",
)
def document_monorepo(spark: SparkSession, sf: str) -> DataFrame:
    files = wide(spark, sf)
    return jobs.number(jobs.document_monorepo(files, choices(corpus(spark, sf)), PROFILE, run_ts()))


@query(
    "output_name",
    f"""
WITH {FILES}, {PROFILES_SQL},
named AS (SELECT project, CASE WHEN length(project) % 3 = 0 THEN '' ELSE output_filename END AS f, append_timestamp FROM profiles)
SELECT project, CASE WHEN f = '' THEN 'project_docs_{STAMP}.md'
  WHEN append_timestamp THEN regexp_replace(f, '\\.[^./]*$', '') || '_{STAMP}' || regexp_extract(f, '\\.[^./]*$')
  ELSE f END AS output FROM named
""",
)
def output_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = profile_table(corpus(spark, sf))
    name = F.when(F.length("project") % 3 == 0, F.lit("")).otherwise(F.col("output_filename"))
    output = render.output_name(name, F.col("append_timestamp"), run_ts())
    return rows.select("project", output.alias("output"))
