"""Selections: listed paths, patterns, bulk commands, roll-ups, the saved log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import globs, paths
from corpusloom.functions.rules import Profile
from corpusloom.operators import saved, scan, selection
from corpusloom.plans.skew import join_facts
from corpusloom.queries.registry import FILES, default_user_sql, excluded_sql, query
from corpusloom.session import materialize
from corpusloom.sources.derived import corpus

# Each project lists a folder, a folder with a slash, and two of its files.
TARGETS_SQL = """
targets AS (
  SELECT project, unnest(['src/app', 'docs/', min(path), max(path)]) AS target FROM files GROUP BY project
)
"""


def targets(files: DataFrame) -> DataFrame:
    picks = F.array(F.lit("src/app"), F.lit("docs/"), F.min("path"), F.max("path"))
    return files.groupBy("project").agg(picks.alias("t")).select("project", F.explode("t").alias("target"))


@query(
    "select_list",
    f"""
WITH {FILES}, {TARGETS_SQL}
SELECT f.project, f.path, f.size FROM files f
WHERE EXISTS (SELECT 1 FROM targets t WHERE t.project = f.project
              AND (f.path = rtrim(t.target, '/') OR starts_with(f.path, rtrim(t.target, '/') || '/')))
""",
)
def select_list(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("project", "path", "size")
    return selection.select_listed(files, targets(files))


@query(
    "select_patterns",
    f"""
WITH {FILES}
SELECT project, path FROM files
WHERE (project LIKE '%-en' AND (name LIKE '%.go' OR (len(seg) = 2 AND seg[1] = 'docs' AND name LIKE '%.md')))
   OR (project LIKE '%-fr' AND seg[1] = 'src' AND len(seg) > 1 AND name LIKE '%.ts%')
""",
)
def select_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns that come from a table: one compiled regex per project row."""
    files = corpus(spark, sf).select("project", "path")
    lang = F.substring_index("project", "-", -1)
    lists = F.when(lang == "en", F.array(F.lit("**/*.go"), F.lit("docs/*.md"))).when(
        lang == "fr", F.array(F.lit("src/**/*.ts*"))
    )
    projects = files.select("project").distinct().select("project", lists.alias("patterns"))
    compiled = projects.filter("patterns IS NOT NULL").select(
        "project", globs.regex_column(F.col("patterns"), "paths").alias("re")
    )
    rows = materialize(compiled, "patterns")
    return join_facts(files, rows, ["project"]).filter(F.regexp_instr("path", F.col("re")) > 0).select("project", "path")


VISIBLE = Profile(excluded_patterns=("temp_*",), output_filename="", include_docs=True)
VISIBLE_SQL = f"NOT {excluded_sql('seg').replace(default_user_sql('s'), 'false')}"
TREE_KEY_SQL = "list_transform(seg, lambda s, i: CASE WHEN i < len(seg) THEN '0' ELSE '1' END || s)"


@query(
    "quick_select",
    f"""
WITH {FILES}
SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY {TREE_KEY_SQL}) AS ord FROM files
WHERE {VISIBLE_SQL} AND ((len(seg) = 2 AND seg[1] = 'src' AND name LIKE '%.go') OR (len(seg) = 1 AND name LIKE '%.md')
                         OR seg[1] = 'docs' OR name LIKE '%.ts')
""",
)
def quick_select(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("project", "path")
    chosen = selection.quick_select(files, ["src/*.go", "*.md", "docs/**", "**/*.ts"], VISIBLE)
    return selection.in_tree_order(chosen)


# Patterns kept as a table: every directory asks for its own files of one kind, a third of the
# files are named in full, and every project takes a folder whole.
PATTERNS_SQL = """
ruled AS (
  SELECT DISTINCT project, 'ext' AS how, parent AS a, CASE WHEN length(parent) % 2 = 0 THEN '.go' ELSE '.md' END AS b FROM files WHERE parent <> ''
  UNION ALL SELECT project, 'name', name, '' FROM files WHERE length(name) % 3 = 0
  UNION ALL SELECT DISTINCT project, 'top', CASE WHEN project LIKE '%-en' THEN 'src' ELSE 'docs' END, '' FROM files
  UNION ALL SELECT DISTINCT project, 'any', '_1', '' FROM files WHERE project LIKE '%-de'
)
"""


def pattern_table(files: DataFrame) -> DataFrame:
    parent, name = paths.parent(F.col("path")), paths.base_name(F.col("path"))
    ending = F.when(F.length(parent) % 2 == 0, F.lit("/*.go")).otherwise(F.lit("/*.md"))
    folder = F.when(F.col("project").endswith("-en"), F.lit("src/**")).otherwise(F.lit("docs/**"))
    rows = (
        files.filter(parent != "").select("project", F.concat(parent, ending).alias("pattern")),
        files.filter(F.length(name) % 3 == 0).select("project", F.concat(F.lit("**/"), name).alias("pattern")),
        files.select("project", folder.alias("pattern")),
        files.filter(F.col("project").endswith("-de")).select("project", F.lit("**/*_1*").alias("pattern")),
    )
    return reduce(DataFrame.unionByName, rows).distinct()


@query(
    "select_pattern_table",
    f"""
WITH {FILES}, {PATTERNS_SQL}
SELECT project, path FROM files f WHERE EXISTS (
  SELECT 1 FROM ruled r WHERE r.project = f.project AND r.how = 'ext' AND r.a = f.parent AND ends_with(f.name, r.b))
  OR EXISTS (SELECT 1 FROM ruled r WHERE r.project = f.project AND r.how = 'name' AND r.a = f.name)
  OR EXISTS (SELECT 1 FROM ruled r WHERE r.project = f.project AND r.how = 'top' AND r.a = f.seg[1])
  OR EXISTS (SELECT 1 FROM ruled r WHERE r.project = f.project AND r.how = 'any' AND contains(f.name, r.a))
""",
)
def select_pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns that are rows of a table, as many as directories and files give."""
    files = corpus(spark, sf).select("project", "path")
    return selection.select_matching(files, pattern_table(files))


EVENTS_SQL = """
commands AS (
  SELECT project, min(doc) AS seq, target, CASE WHEN min(doc) % 3 = 0 THEN 'deselect' ELSE 'select' END AS action
  FROM (
    SELECT project, length(path) * 7919 % 1009 * 1000 + length(parent) AS doc, parent AS target FROM files
    UNION ALL SELECT project, length(path) * 104729 % 1013 * 1000 + 777, path FROM files WHERE length(path) % 3 = 0
  ) GROUP BY project, target
)
"""


def commands(files: DataFrame) -> DataFrame:
    """Select and deselect commands on directories and on some files."""
    parent = F.expr("substring(path, 1, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))")
    on_dirs = files.select(
        "project", F.expr("length(path) * 7919 % 1009 * 1000").alias("base"), parent.alias("target")
    ).select("project", (F.col("base") + F.length("target")).alias("doc"), "target")
    on_files = files.filter("length(path) % 3 = 0").select(
        "project", F.expr("length(path) * 104729 % 1013 * 1000 + 777").alias("doc"), F.col("path").alias("target")
    )
    return (
        on_dirs.unionByName(on_files)
        .groupBy("project", "target")
        .agg(F.min("doc").cast("bigint").alias("seq"))
        .withColumn("action", F.when(F.col("seq") % 3 == 0, F.lit("deselect")).otherwise(F.lit("select")))
    )


SELECTED_SQL = """
hits AS (
  SELECT f.project, f.path, c.seq, c.action FROM files f JOIN commands c
    ON c.project = f.project AND (c.target = '' OR f.path = c.target OR starts_with(f.path, c.target || '/'))
),
selected AS (
  SELECT f.project, f.path, coalesce(h.action = 'select', false) AS selected
  FROM files f LEFT JOIN (
    SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY seq DESC, action DESC) = 1
  ) h ON h.project = f.project AND h.path = f.path
)
"""


@query("bulk_select", f"WITH {FILES}, {EVENTS_SQL}, {SELECTED_SQL} SELECT * FROM selected")
def bulk_select(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("project", "path")
    return selection.bulk_select(files, commands(files))


@query(
    "selection_rollup",
    f"""
WITH {FILES}, {EVENTS_SQL}, {SELECTED_SQL},
up AS (
  SELECT project, selected, array_to_string(seg[:i], '/') AS dir
  FROM (SELECT project, selected, string_split(path, '/') AS seg, unnest(range(0, len(string_split(path, '/')))) AS i FROM selected)
)
SELECT project, dir, count(*) AS n_files, count(*) FILTER (selected) AS n_selected,
       CASE WHEN bool_and(selected) THEN 'x' WHEN bool_or(selected) THEN '~' ELSE ' ' END AS state
FROM up GROUP BY project, dir
""",
)
def selection_rollup(spark: SparkSession, sf: str) -> DataFrame:
    files = corpus(spark, sf).select("project", "path")
    return selection.rollup(selection.bulk_select(files, commands(files)))


COUNTED = Profile(
    excluded_patterns=("*.css", "user_*"),
    selection_mode="list",
    included_paths=("src", "docs/", "package.json", "go.sum"),
    output_filename="",
)


@query(
    "selected_count",
    f"""
WITH {FILES}
SELECT project, count(*) AS n_files FROM files
WHERE (seg[1] IN ('src', 'docs') AND len(seg) > 1 OR path IN ('package.json', 'go.sum', 'src', 'docs'))
  AND NOT (name LIKE '%.css' OR starts_with(name, 'user_') OR starts_with(name, '~$') OR name IN ('go.sum', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml'))
GROUP BY project
""",
)
def selected_count(spark: SparkSession, sf: str) -> DataFrame:
    return scan.selected_count(corpus(spark, sf), COUNTED)


# A log of saves and deletes, one row per event: the user is the project.
LOG_SQL = """
log AS (
  SELECT 'u' || user_id AS project, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'save' END AS op,
         replace(name, ' ', '_') AS key, name,
         CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE 'set ' || event_id END END AS description,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS created,
         CASE WHEN event_id % 5 <> 0 THEN ['src/' || event_type, 'docs', 'n' || event_id][:event_id % 4] END AS paths
  FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'last' ELSE event_type || CASE WHEN event_id % 3 = 0 THEN '_' ELSE ' ' END
                       || (event_id % 4) END AS name FROM events)
),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY seq DESC) = 1)
"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("event_id")
    glue = F.when(number % 3 == 0, F.lit("_")).otherwise(F.lit(" "))
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("project"),
        number.alias("seq"),
        F.when(number % 11 == 0, F.lit("last"))
        .otherwise(F.concat("event_type", glue, (number % 4).cast("string")))
        .alias("name"),
        F.when(number % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("set "), number.cast("string"))).alias("description"),
        F.date_trunc("second", F.col("ts")).alias("created"),
        F.slice(
            F.array(F.concat(F.lit("src/"), "event_type"), F.lit("docs"), F.concat(F.lit("n"), number.cast("string"))),
            F.lit(1),
            (number % 4).cast("int"),
        ).alias("paths"),
    )
    is_delete = F.col("seq") % 5 == 0
    return saved.saves(rows.filter(~is_delete)).unionByName(
        saved.deletes(rows.filter(is_delete).select("project", "seq", "name", "created"))
    )


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Arrays joined and stamps formatted, to compare as text."""
    return rows.select(*columns).withColumns(
        {
            "paths": F.array_join("paths", ","),
            "created": F.date_format("created", "yyyy-MM-dd HH:mm:ss"),
        }
    )


@query(
    "selections_latest",
    f"""
WITH {LOG_SQL}
SELECT project, 'key' AS kind, key, seq, name, description, created, array_to_string(paths, ',') AS paths
FROM newest WHERE op = 'save'
UNION ALL
SELECT project, 'last', key, seq, name, description, created, array_to_string(paths, ',')
FROM (SELECT * FROM log WHERE op = 'save' QUALIFY row_number() OVER (PARTITION BY project ORDER BY seq DESC) = 1)
""",
)
def selections_latest(spark: SparkSession, sf: str) -> DataFrame:
    entries = log(spark, sf)
    columns = ("project", "kind", "key", "seq", "name", "description", "created", "paths")
    by_key = saved.current(entries).withColumn("kind", F.lit("key"))
    newest = saved.load(entries, "last").withColumn("kind", F.lit("last"))
    return _shown(by_key, *columns).unionByName(_shown(newest, *columns))


@query(
    "selections_list",
    f"""
WITH {LOG_SQL}
SELECT project, row_number() OVER (PARTITION BY project ORDER BY key) AS ord, name
FROM newest WHERE op = 'save' AND key <> 'last'
""",
)
def selections_list(spark: SparkSession, sf: str) -> DataFrame:
    return saved.catalogue(log(spark, sf)).select("project", "ord", "name")


@query("selections_deleted", f"WITH {LOG_SQL} SELECT project, key, seq FROM newest WHERE op = 'delete'")
def selections_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return saved.deleted(log(spark, sf)).select("project", "key", "seq")


@query(
    "selections_missing",
    f"""
WITH {LOG_SQL}
SELECT DISTINCT project, name FROM log l WHERE seq % 7 = 0
  AND NOT EXISTS (SELECT 1 FROM newest n WHERE n.project = l.project AND n.key = l.key AND n.op = 'save')
""",
)
def selections_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for selections that do not exist (any more)."""
    entries = log(spark, sf)
    asked = entries.filter("seq % 7 = 0").select("project", "name").distinct()
    return saved.missing(entries, asked)


@query(
    "selections_roundtrip",
    f"""
WITH {LOG_SQL}
SELECT project, seq + 1000000 AS seq, 'save' AS op, key, name, description, '2024-06-01 00:00:00' AS created,
       array_to_string(paths, ',') AS paths, CAST(NULL AS VARCHAR) AS patterns
FROM newest WHERE op = 'save'
""",
)
def selections_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Export to JSON and import again: new stamp, same name, description and paths."""
    existing = saved.current(log(spark, sf)).withColumn("patterns", F.array(F.lit("**/*.go")))
    documents = saved.to_json(existing).withColumn("seq", F.lit(0))
    numbered = existing.select("project", "key", (F.col("seq") + 1000000).alias("new_seq"))
    stamp = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    back = saved.from_json(documents, stamp, F.col("seq")).drop("seq").join(numbered, ["project", "key"])
    columns = ("project", "seq", "op", "key", "name", "description", "created", "paths", "patterns")
    shown = _shown(back.withColumnRenamed("new_seq", "seq"), *columns)
    return shown.withColumn("patterns", F.array_join("patterns", ","))


@query(
    "selection_catalogue",
    f"""
WITH {LOG_SQL}
SELECT project, row_number() OVER (PARTITION BY project ORDER BY key) AS ord, key, name, description,
       len(paths)::BIGINT AS n_paths,
       name || CASE WHEN description <> '' THEN ' - ' || description ELSE '' END || ' (' || len(paths) || ' files)' AS label
FROM newest WHERE op = 'save' AND key <> 'last'
""",
)
def selection_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return saved.catalogue(log(spark, sf))


MODE_SQL = "CASE n % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'patterns' WHEN 2 THEN 'unknown' ELSE 'list' END"
REQUESTS_SQL = {
    "use_last": "CASE WHEN n % 7 = 0 THEN true WHEN n % 7 = 1 THEN false END",
    "name": "CASE n % 7 WHEN 1 THEN 'click 1' WHEN 2 THEN 'last' WHEN 3 THEN 'nothing' WHEN 4 THEN '' WHEN 0 THEN 'view 2' END",
    "paths": "CASE WHEN n % 7 IN (1, 4, 5) THEN ' a , b/' END",
}


@query(
    "selection_dispatch",
    f"""
WITH {LOG_SQL},
asked AS (
  SELECT project, {MODE_SQL} AS own, {", ".join(f"{sql} AS {name}" for name, sql in REQUESTS_SQL.items())}
  FROM (SELECT project, count(*) AS n FROM log GROUP BY project)
),
lasts AS (SELECT * FROM log WHERE op = 'save' QUALIFY row_number() OVER (PARTITION BY project ORDER BY seq DESC) = 1),
way AS (
  SELECT *, CASE WHEN use_last THEN 'last' WHEN name = 'last' THEN 'last' WHEN name <> '' THEN 'name'
                 WHEN paths <> '' THEN 'paths' ELSE 'own' END AS way FROM asked
)
SELECT w.project,
       CASE WHEN way = 'last' AND l.project IS NOT NULL THEN 'list' WHEN use_last THEN 'all'
            WHEN way = 'name' AND s.project IS NOT NULL THEN 'list' WHEN way IN ('name', 'last') THEN own
            WHEN way = 'paths' THEN 'list' WHEN own IN ('list', 'patterns', 'interactive') THEN own ELSE 'all' END AS selection_mode,
       CASE WHEN way = 'last' AND l.project IS NOT NULL THEN array_to_string(l.paths, ',')
            WHEN way = 'name' AND s.project IS NOT NULL THEN array_to_string(s.paths, ',')
            WHEN way = 'paths' THEN 'a,b/' ELSE 'cfg' END AS included_paths,
       CASE WHEN (way = 'name' AND s.project IS NULL) OR (way = 'last' AND l.project IS NULL AND use_last IS NOT TRUE)
            THEN 'not_found' ELSE 'ok' END AS status
FROM way w LEFT JOIN lasts l ON l.project = w.project
LEFT JOIN newest s ON s.project = w.project AND s.op = 'save' AND s.key = replace(w.name, ' ', '_')
""",
)
def selection_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """What each user asked for decides over what the user's profile says."""
    entries = log(spark, sf)
    counted = entries.groupBy("project").agg(F.count("*").alias("n"))
    own = counted.select("project", F.expr(MODE_SQL).alias("selection_mode"), F.array(F.lit("cfg")).alias("included_paths"))
    requests = counted.select("project", *[F.expr(sql).alias(name) for name, sql in REQUESTS_SQL.items()])
    chosen = saved.dispatch(own, requests, entries)
    return chosen.withColumn("included_paths", F.array_join("included_paths", ","))
