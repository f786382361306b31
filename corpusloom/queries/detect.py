"""Project types, conflicts, frameworks and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import detect
from corpusloom.queries.registry import FILES, query
from corpusloom.sources.derived import corpus

TYPES_SQL = """
facts AS (
  SELECT project,
         bool_or(path = 'go.mod') AND bool_or(path = 'package.json') AS conflict,
         bool_or(path IN ('nx.json', 'workspace.json')) OR (bool_or(path LIKE 'apps/%') AND bool_or(path LIKE 'libs/%')) AS nx,
         count(*) FILTER (path IN ('manifest.json', 'background.js', 'content-script.js', 'popup.html', 'service-worker.js')) >= 3 AS browser,
         count(*) FILTER (path IN ('angular.json', 'src/main.ts', 'src/index.html')) >= 2
           OR bool_or(path = 'package.json' AND contains(content, '"@angular/core"')) AS angular,
         bool_or(path = 'go.mod') OR bool_or(regexp_matches(path, '^[^/]*\\.go$')) AS go,
         bool_or(path = 'package.json') OR bool_or(regexp_matches(lower(path), '^[^/]*\\.(js|ts|jsx|tsx|mjs|cjs)$'))
           OR bool_or(regexp_matches(path, '^(src|app|lib)/')) AS js
  FROM files GROUP BY project
),
types AS (
  SELECT project, CASE WHEN conflict THEN '' WHEN nx THEN 'nx' WHEN browser THEN 'browser-extension' WHEN angular THEN 'angular'
                       WHEN go THEN 'go' WHEN js THEN 'js' ELSE 'unknown' END AS type,
         CASE WHEN conflict THEN 'conflict' WHEN nx OR browser OR angular OR go OR js THEN 'ok' ELSE 'unsupported' END AS status
  FROM facts
)
"""

FRAMEWORK_SQL = """
frameworks AS (
  SELECT project, CASE
    WHEN count(*) FILTER (path IN ('angular.json', 'src/main.ts')) >= 2 THEN 'Angular'
    WHEN count(*) FILTER (path IN ('src/App.jsx', 'src/App.tsx', 'src/index.js')) >= 2
      OR bool_or(path = 'package.json' AND contains(content, '"react"')) THEN 'React'
    WHEN count(*) FILTER (path IN ('vue.config.js', 'src/App.vue', 'src/main.js')) >= 2
      OR bool_or(path = 'package.json' AND contains(content, '"vue"')) THEN 'Vue'
    WHEN count(*) FILTER (path IN ('svelte.config.js', 'src/App.svelte')) >= 2
      OR bool_or(path = 'package.json' AND contains(content, '"svelte"')) THEN 'Svelte'
    ELSE 'JavaScript' END AS framework
  FROM files GROUP BY project
)
"""


@query("project_type", f"WITH {FILES}, {TYPES_SQL} SELECT * FROM types")
def project_type(spark: SparkSession, sf: str) -> DataFrame:
    return detect.project_types(corpus(spark, sf))


@query("project_conflicts", f"WITH {FILES}, {TYPES_SQL} SELECT project FROM types WHERE status = 'conflict'")
def project_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return detect.conflicts(corpus(spark, sf))


@query("js_framework", f"WITH {FILES}, {FRAMEWORK_SQL} SELECT * FROM frameworks")
def js_framework(spark: SparkSession, sf: str) -> DataFrame:
    return detect.frameworks(corpus(spark, sf))


@query(
    "dependency_probe",
    f"""
WITH {FILES}
SELECT project, dependency FROM files JOIN (VALUES ('react'), ('vue'), ('svelte'), ('@angular/core')) d(dependency)
  ON path = 'package.json' AND contains(content, '"' || dependency || '"')
""",
)
def dependency_probe(spark: SparkSession, sf: str) -> DataFrame:
    return detect.dependencies(corpus(spark, sf), ["react", "vue", "svelte", "@angular/core"])
