"""Header extraction from Go sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import headers
from corpusloom.functions.languages import language
from corpusloom.operators import render
from corpusloom.queries.registry import FILES, language_sql, query
from corpusloom.sources.derived import corpus

# The same extraction line by line: block state from the markers before each line.
LINES_SQL = """
lines AS (
  SELECT project, path, pos, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM (
    SELECT project, path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS pos,
           unnest(string_split(content, chr(10))) AS line
    FROM files WHERE name LIKE '%.go')
),
marked AS (
  SELECT *, CASE WHEN regexp_matches(t, '^import\\s*\\(') THEN 1 WHEN t = ')' THEN 0 END AS marker FROM lines
),
stated AS (
  SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (
    PARTITION BY project, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_block FROM marked
),
found AS (
  SELECT project, path, pos, kind, symbol FROM (
    SELECT project, path, pos, 'dependency' AS kind, regexp_extract(t, '"([^"]+)"', 1) AS symbol FROM stated
      WHERE NOT starts_with(t, '//') AND (in_block OR regexp_matches(t, '^import\\s+([^\\s"(]+\\s+)?"'))
    UNION ALL SELECT project, path, pos, 'function', trim(regexp_extract(t, '^func\\s+([A-Z][^(]*)\\(', 1)) FROM stated WHERE NOT in_block
    UNION ALL SELECT project, path, pos, 'type', regexp_extract(t, '^type\\s+([A-Z][^ =]*)', 1) FROM stated WHERE NOT in_block
    UNION ALL SELECT project, path, pos, 'constant', regexp_extract(t, '^const\\s+([A-Z][^ =]*)', 1) FROM stated WHERE NOT in_block
  ) WHERE symbol <> ''
),
symbols AS (
  SELECT project, path, kind, row_number() OVER (PARTITION BY project, path, kind ORDER BY pos) AS pos, symbol FROM found
),
counts AS (
  SELECT f.project, f.path, count(*) FILTER (kind = 'function') AS n_functions, count(*) FILTER (kind = 'type') AS n_types,
         count(*) FILTER (kind = 'constant') AS n_constants, count(*) FILTER (kind = 'dependency') AS n_dependencies,
         coalesce(string_agg(symbol, ',' ORDER BY pos) FILTER (kind = 'dependency'), '') AS dependencies
  FROM files f LEFT JOIN symbols s USING (project, path) GROUP BY f.project, f.path
),
headers AS (
  SELECT c.*, CASE WHEN path NOT LIKE '%.go' THEN
           CASE {lang} WHEN 'javascript' THEN 'JavaScript/TypeScript' WHEN 'typescript' THEN 'JavaScript/TypeScript'
                WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' ELSE {lang} END || ' file - header extraction not yet implemented'
         WHEN n_types + n_functions + n_constants = 0 THEN 'Go source file'
         ELSE 'Go file with ' || concat_ws(', ', CASE WHEN n_types > 0 THEN n_types || ' types' END,
           CASE WHEN n_functions > 0 THEN n_functions || ' functions' END, CASE WHEN n_constants > 0 THEN n_constants || ' constants' END)
         END AS summary
  FROM counts c
)
""".replace("{lang}", language_sql())


def go_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).filter(language(F.col("path")) == "go").select("project", "path", "content")


@query("import_blocks", f"WITH {FILES}, {LINES_SQL} SELECT project, path, pos, line, in_block FROM stated")
def import_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = go_files(spark, sf).select(
        "project", "path", F.posexplode(headers.line_blocks(F.col("content"))).alias("pos", "row")
    )
    return rows.select("project", "path", (F.col("pos") + 1).cast("bigint").alias("pos"), "row.line", "row.in_block")


@query("go_symbols", f"WITH {FILES}, {LINES_SQL} SELECT project, path, kind, pos, symbol FROM symbols")
def go_symbols(spark: SparkSession, sf: str) -> DataFrame:
    found = go_files(spark, sf).select("project", "path", headers.symbols(F.col("content")).alias("s"))
    lists = F.create_map(
        *[x for kind, field in (("function", "functions"), ("type", "types"), ("constant", "constants"), ("dependency", "dependencies"))
          for x in (F.lit(kind), F.col("s")[field])]
    )
    rows = found.select("project", "path", F.explode(lists).alias("kind", "symbols"))
    long = rows.select("project", "path", "kind", F.posexplode("symbols").alias("at", "symbol"))
    return long.select("project", "path", "kind", (F.col("at") + 1).cast("bigint").alias("pos"), "symbol")


@query("header_summary", f"WITH {FILES}, {LINES_SQL} SELECT * FROM headers")
def header_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = render.with_header(corpus(spark, sf).withColumn("lang", language(F.col("path"))))
    return files.select(
        "project",
        "path",
        F.size("header.functions").cast("bigint").alias("n_functions"),
        F.size("header.types").cast("bigint").alias("n_types"),
        F.size("header.constants").cast("bigint").alias("n_constants"),
        F.size("header.dependencies").cast("bigint").alias("n_dependencies"),
        F.array_join("header.dependencies", ",").alias("dependencies"),
        "header.summary",
    )
