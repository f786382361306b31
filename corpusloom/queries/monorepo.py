"""Sub-projects, root files and the monorepo overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.rules import Profile
from corpusloom.operators import monorepo
from corpusloom.plans.ranking import path_index
from corpusloom.queries.registry import FILES, language_sql, query
from corpusloom.session import materialize
from corpusloom.sources.derived import corpus

# Besides the marker projects, every folder of a file named config_* or settings_* below
# the project counts as one, so that the number of sub-projects grows with the table.
WIDE_SQL = """
wide AS (
  SELECT project, path, content, size, seg, name FROM files
  UNION ALL
  SELECT project, npath, '{}', 2, string_split(npath, '/'), 'project.json' FROM (
    SELECT DISTINCT project, (['apps/', 'libs/', 'tools/', 'packages/'])[length(name) % 4 + 1] ||
           CASE WHEN length(parent) % 2 = 0 THEN '' ELSE 'group/' END || name || '/project.json' AS npath
    FROM files WHERE starts_with(name, 'config_') OR starts_with(name, 'settings_'))
),
roots AS (
  SELECT project, array_to_string(seg[:-2], '/') AS root, seg[:-2] AS rseg FROM wide
  WHERE name = 'project.json' AND len(seg) > 1 AND seg[1] IN ('apps', 'libs', 'tools', 'packages')
),
subs AS (
  SELECT project, rseg[-1] AS name, rseg[1] AS type, root, rseg FROM roots r
  WHERE NOT EXISTS (SELECT 1 FROM roots o WHERE o.project = r.project AND starts_with(r.root, o.root || '/'))
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY list_position(['apps', 'libs', 'tools', 'packages'], type), rseg) AS idx
  FROM subs
)
"""


def wide(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf)
    name = F.substring_index("path", "/", -1)
    folder = F.element_at(F.array(*map(F.lit, ["apps/", "libs/", "tools/", "packages/"])), F.length(name) % 4 + 1)
    up = F.greatest(F.length("path") - F.length(name) - 1, F.lit(0))
    middle = F.when(up % 2 == 0, F.lit("")).otherwise(F.lit("group/"))
    markers = (
        files.filter(name.startswith("config_") | name.startswith("settings_"))
        .select("project", F.concat(folder, middle, name, F.lit("/project.json")).alias("path"))
        .distinct()
        .select("project", "path", F.lit(2).cast("bigint").alias("size"), F.lit("{}").alias("content"))
    )
    return files.unionByName(markers)


@query("subprojects", f"WITH {FILES}, {WIDE_SQL} SELECT project, idx, name, type, root FROM numbered")
def subprojects(spark: SparkSession, sf: str) -> DataFrame:
    return monorepo.listed(monorepo.subprojects(wide(spark, sf)))


ROOTS = Profile(excluded_patterns=("*.tmp", "page_*"), output_filename="output.md")


@query(
    "root_files",
    f"""
WITH {FILES}
SELECT project, path FROM files WHERE len(seg) = 1 AND NOT starts_with(name, 'page_') AND NOT starts_with(name, '~$')
  AND name NOT LIKE '%.tmp' AND name NOT IN ('go.sum', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml')
""",
)
def root_files(spark: SparkSession, sf: str) -> DataFrame:
    return monorepo.root_files(corpus(spark, sf), ROOTS).select("project", "path")


EVERY = Profile()
LISTED = ("package.json", "nx.json", "tsconfig.base.json", "go.mod", "nx.json")


@query(
    "important_root_files",
    f"""
WITH {FILES}
SELECT project, pos::BIGINT AS pos, path, {language_sql()} AS lang, false AS skipped, content
FROM files JOIN (VALUES (1, 'package.json'), (2, 'nx.json'), (3, 'tsconfig.base.json'), (4, 'go.mod'), (5, 'nx.json')) l(pos, listed)
  ON path = listed
""",
)
def important_root_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = monorepo.important_root_files(corpus(spark, sf), LISTED, EVERY)
    return rows.select("project", "pos", "path", "lang", "skipped", "content")


@query(
    "subproject_files",
    f"""
WITH {FILES}, {WIDE_SQL}
SELECT f.project, f.path, s.name AS subproject, s.type, s.root
FROM wide f JOIN subs s ON s.project = f.project AND starts_with(f.path, s.root || '/')
""",
)
def subproject_files(spark: SparkSession, sf: str) -> DataFrame:
    index = path_index(wide(spark, sf))
    subs = monorepo.subprojects(index).withColumnRenamed("name", "subproject")
    return monorepo.assign(index, subs).select("project", "path", "subproject", "type", "root")


CHOICE_SQL = """
choices AS (
  SELECT project, CASE count(*) % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN '' WHEN 2 THEN '1, 3,2' WHEN 3 THEN ' 2 ,x,1,99999999,2'
                       ELSE '0,-1,+1' END AS input
  FROM files GROUP BY project
),
picked AS (
  SELECT n.*, n.idx AS pick FROM numbered n JOIN choices c USING (project) WHERE lower(trim(input)) IN ('', 'all')
  UNION ALL
  SELECT n.*, t.pos FROM numbered n
  JOIN (SELECT project, unnest(range(1, len(string_split(input, ',')) + 1)) AS pos,
               try_cast(trim(unnest(string_split(input, ','))) AS BIGINT) AS idx
        FROM choices WHERE lower(trim(input)) NOT IN ('', 'all')) t
    ON t.project = n.project AND t.idx = n.idx
)
"""


def choices(files: DataFrame) -> DataFrame:
    n = F.count("*") % 5
    typed = (
        F.when(n == 0, F.lit("ALL"))
        .when(n == 1, F.lit(""))
        .when(n == 2, F.lit("1, 3,2"))
        .when(n == 3, F.lit(" 2 ,x,1,99999999,2"))
        .otherwise(F.lit("0,-1,+1"))
    )
    return files.groupBy("project").agg(typed.alias("input"))


@query("subproject_pick", f"WITH {FILES}, {WIDE_SQL}, {CHOICE_SQL} SELECT project, pick, idx, name, type, root FROM picked")
def subproject_pick(spark: SparkSession, sf: str) -> DataFrame:
    # Listed sub-projects are looked up by number and taken whole: stored, so that both read one listing.
    numbered = materialize(monorepo.listed(monorepo.subprojects(wide(spark, sf))), "listed")
    return monorepo.pick(numbered, choices(corpus(spark, sf)))


@query(
    "subprojects_by_type",
    f"""
WITH {FILES}, {WIDE_SQL}
SELECT project, type, row_number() OVER (PARTITION BY project, type ORDER BY name, root) AS pos, name, root FROM subs
""",
)
def subprojects_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return monorepo.by_type(monorepo.subprojects(wide(spark, sf)))


OVERVIEW_SQL = """
types_seen AS (SELECT project, type, max(type) OVER (PARTITION BY project) = type AS is_last_type FROM (SELECT DISTINCT project, type FROM picked_subs)),
with_files AS (SELECT DISTINCT project, true AS has_files FROM root_list),
overview_rows AS (
  SELECT project, 0 AS part, '' AS a, '' AS b, '' AS c, 'nx-monorepo/' AS line
  FROM (SELECT project FROM picked_subs UNION SELECT project FROM root_list)
  UNION ALL
  SELECT project, 1, type, '', '', CASE WHEN is_last_type AND has_files IS NULL THEN '└── ' ELSE '├── ' END || type || '/'
  FROM types_seen LEFT JOIN with_files USING (project)
  UNION ALL
  SELECT s.project, 1, s.type, '+' || s.name, s.root,
         CASE WHEN t.is_last_type AND has_files IS NULL THEN '    ' ELSE '│   ' END ||
         CASE WHEN row_number() OVER (PARTITION BY s.project, s.type ORDER BY s.name DESC, s.root DESC) = 1 THEN '└── ' ELSE '├── ' END || s.name
  FROM picked_subs s JOIN types_seen t ON t.project = s.project AND t.type = s.type LEFT JOIN with_files w ON w.project = s.project
  UNION ALL
  SELECT project, 2, '', '', '', '│' FROM with_files WHERE project IN (SELECT project FROM picked_subs)
  UNION ALL
  SELECT project, 3, '', path, '', CASE WHEN max(path) OVER (PARTITION BY project) = path THEN '└── ' ELSE '├── ' END || path
  FROM root_list
),
overview AS (
  SELECT project, row_number() OVER (PARTITION BY project ORDER BY part, a, b, c) AS ord, line FROM overview_rows
)
"""


@query(
    "section_monorepo",
    f"""
WITH {FILES}, {WIDE_SQL},
picked_subs AS (SELECT * FROM subs),
root_list AS (SELECT project, path FROM files WHERE len(seg) = 1 AND path LIKE '%.json'),
{OVERVIEW_SQL}
SELECT * FROM overview
""",
)
def section_monorepo(spark: SparkSession, sf: str) -> DataFrame:
    index = path_index(wide(spark, sf))
    roots = index.filter("path NOT LIKE '%/%' AND path LIKE '%.json'")
    return monorepo.overview(monorepo.subprojects(index), roots)
