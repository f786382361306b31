"""The Markdown sections of a document, one query per kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.languages import language
from corpusloom.functions.rules import Profile
from corpusloom.operators import detect, monorepo, render, scan, tree
from corpusloom.queries.detect import TYPES_SQL
from corpusloom.queries.headers import LINES_SQL
from corpusloom.queries.monorepo import WIDE_SQL, wide
from corpusloom.queries.registry import FILES, fence_sql, language_sql, query
from corpusloom.queries.rules import STUBS, STUBS_SQL
from corpusloom.queries.trees import nodes_sql, indexed_nodes
from corpusloom.sources.derived import corpus

RUN_TS = "2024-05-06 07:08:09"
STAMP = "20240506_070809"


def run_ts() -> Column:
    return F.to_timestamp(F.lit(RUN_TS))


def n(text: str) -> str:
    """SQL literal with ``\\n`` as line breaks."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def head_sql(kind: str) -> str:
    return (
        f"'# Проект: ' || project || {n(chr(10) * 2 + '**Дата генерации:** ' + RUN_TS)} || "
        f"{n(chr(10) * 2 + '**Полнота:** Полная структура проекта и исходный код' + chr(10) * 2 + '**Тип:** ')} || {kind} || "
        + n("\n\n## Содержание\n- [Структура проекта](#структура-проекта)\n- [Основные модули](#основные-модули)\n")
    )


TREE_OPEN = "## Структура проекта\n\n```\n"
TREE_CLOSE = "\n```\n\n"
MODULES = "## Основные модули\n\nВ этом разделе представлены ключевые файлы проекта с их исходным кодом:\n\n"
SKIPPED = "```\n[Содержимое файла пропущено]\n```\n\n_Файл был пропущен по настройкам документации._\n\n"
ROOT_CONFIGS = "\n## Корневые конфигурационные файлы\n\nВ этом разделе представлены основные конфигурационные файлы проекта:\n\n"
FULL_SQL = (
    f"'### ' || path || {n(chr(10) * 2 + '```')} || {fence_sql()} || chr(10) || content || "
    f"CASE WHEN content = '' OR ends_with(content, chr(10)) THEN '' ELSE chr(10) END || {n('```' + chr(10) * 2)}"
)
SECTION_SQL = f"CASE WHEN skipped THEN '### ' || path || {n(chr(10) * 2 + SKIPPED)} ELSE {FULL_SQL} END"


@query(
    "section_header",
    f"WITH {FILES}, {TYPES_SQL} SELECT project, {head_sql('type')} AS markdown FROM types WHERE status = 'ok'",
)
def section_header(spark: SparkSession, sf: str) -> DataFrame:
    typed = detect.project_types(corpus(spark, sf)).filter("status = 'ok'")
    head = render.document_head(F.col("project"), F.col("type"), run_ts())
    return typed.select("project", head.alias("markdown"))


@query(
    "section_tree",
    f"""
WITH {FILES}, {nodes_sql()}
SELECT project, 1::BIGINT AS step, 0::BIGINT AS line, {n(TREE_OPEN)} AS markdown FROM (SELECT DISTINCT project FROM placed)
UNION ALL SELECT project, 2, ord, line || chr(10) FROM tree_lines
UNION ALL SELECT DISTINCT project, 3, 0, {n(TREE_CLOSE)} FROM placed
""",
)
def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    nodes = indexed_nodes(spark, sf)
    projects = nodes.select("project").distinct()
    lines = F.concat("line", F.lit("\n"))
    rows = (
        render.fragments(projects, render.tree_open(), 1, step=1)
        .unionByName(render.fragments(tree.lines(nodes), lines, 1, step=2, line=F.col("ord")))
        .unionByName(render.fragments(projects, render.TREE_CLOSE, 1, step=3))
    )
    return rows.select("project", F.col("step").cast("bigint").alias("step"), "line", "markdown")


@query("section_modules", f"WITH {FILES} SELECT DISTINCT project, {n(MODULES)} AS markdown FROM files")
def section_modules(spark: SparkSession, sf: str) -> DataFrame:
    projects = corpus(spark, sf).select("project").distinct()
    return projects.select("project", F.lit(render.modules_head()).alias("markdown"))


WHOLE = Profile(include_tests=True, include_docs=True, excluded_patterns=(), output_filename="")


@query(
    "section_file_full",
    f"WITH {FILES} SELECT project, path, {FULL_SQL} AS markdown FROM files",
)
def section_file_full(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).withColumns({"lang": language(F.col("path")), "skipped": F.lit(False)})
    return render.with_section(files, render.FULL).select("project", "path", "markdown")


HEADERS_SQL = f"""
lists AS (
  SELECT project, path, string_agg(symbol || chr(10), '' ORDER BY pos) FILTER (kind = 'function') AS functions,
         string_agg(symbol || chr(10), '' ORDER BY pos) FILTER (kind = 'type') AS types,
         string_agg('- `' || symbol || '`' || chr(10), '' ORDER BY pos) FILTER (kind = 'dependency') AS imports
  FROM symbols GROUP BY project, path
),
short AS (
  SELECT project, path, '### ' || path || {n(chr(10) * 2 + '**File Type:** ')} || upper({language_sql()}) ||
         {n(chr(10) * 2 + '**Summary:** ')} || summary || {n(chr(10) * 2)} ||
         coalesce({n('**Exported Functions:**' + chr(10) + '```go' + chr(10))} || functions || {n('```' + chr(10) * 2)}, '') ||
         coalesce({n('**Exported Types:**' + chr(10) + '```go' + chr(10))} || types || {n('```' + chr(10) * 2)}, '') ||
         coalesce({n('**Dependencies:**' + chr(10))} || imports || chr(10), '') ||
         '_To view full file content, use the tag: `[FILE:' || path || ']`_' || {n(chr(10) * 2)} AS markdown
  FROM headers LEFT JOIN lists USING (project, path)
)
"""


@query("section_file_headers", f"WITH {FILES}, {LINES_SQL}, {HEADERS_SQL} SELECT * FROM short")
def section_file_headers(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).withColumns({"lang": language(F.col("path")), "skipped": F.lit(False)})
    return render.with_section(files, render.HEADERS).select("project", "path", "markdown")


@query(
    "section_skipped",
    f"WITH {FILES} SELECT project, path, {SECTION_SQL} AS markdown FROM ({STUBS_SQL}) WHERE skipped",
)
def section_skipped(spark: SparkSession, sf: str) -> DataFrame:
    files = scan.classify(corpus(spark, sf), STUBS).filter("skipped")
    return render.with_section(files, render.FULL).select("project", "path", "markdown")


@query(
    "section_mode",
    f"""
WITH {FILES}, {LINES_SQL}, {HEADERS_SQL}
SELECT project, path, CASE WHEN project LIKE '%-en' THEN s.markdown ELSE {FULL_SQL} END AS markdown
FROM files JOIN short s USING (project, path)
""",
)
def section_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The documentation mode as a column of the row."""
    files = corpus(spark, sf).withColumns({"lang": language(F.col("path")), "skipped": F.lit(False)})
    mode = F.when(F.col("project").endswith("-en"), F.lit(render.HEADERS)).otherwise(F.lit(render.FULL))
    return render.with_section(files, mode).select("project", "path", "markdown")


@query(
    "section_subproject",
    f"""
WITH {FILES}, {WIDE_SQL}
SELECT project, root, chr(10) || '## Проект: ' || name || ' (' || type || ')' || {n(chr(10) * 2 + '**Путь:** ')} || root || {n(chr(10) * 2)} AS markdown
FROM subs
""",
)
def section_subproject(spark: SparkSession, sf: str) -> DataFrame:
    subs = monorepo.subprojects(wide(spark, sf))
    head = render.subproject_head(F.col("name"), F.col("type"), F.col("root"))
    return subs.select("project", "root", head.alias("markdown"))


@query(
    "section_root_config",
    f"""
WITH {FILES}
SELECT DISTINCT project, {n(ROOT_CONFIGS)} AS markdown FROM files WHERE path IN ('package.json', 'nx.json', 'tsconfig.base.json')
""",
)
def section_root_config(spark: SparkSession, sf: str) -> DataFrame:
    found = monorepo.important_root_files(corpus(spark, sf), ("package.json", "nx.json", "tsconfig.base.json"), WHOLE)
    return found.select("project").distinct().select("project", F.lit(render.root_configs_head()).alias("markdown"))
