"""Scans, bounded reads and path-derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.languages import fence_language, language
from corpusloom.functions.rules import Profile
from corpusloom.operators import scan, tree
from corpusloom.queries.registry import FILES, excluded_sql, fence_sql, language_sql, query
from corpusloom.sources.derived import corpus, page_corpus
from corpusloom.sources.files import bounded, with_path_parts

PAGE_LIMIT = 4000


@query(
    "scan_paths",
    f"""
WITH {FILES}
SELECT project, path, size, name, parent, regexp_extract(path, '\\.[^./]*$') AS ext, len(seg)::BIGINT AS depth
FROM files
""",
)
def scan_paths(spark: SparkSession, sf: str) -> DataFrame:
    files = with_path_parts(corpus(spark, sf))
    return files.select("project", "path", "size", "name", "parent", "ext", "depth")


@query(
    "scan_totals",
    f"""
WITH {FILES},
anc AS (
  SELECT DISTINCT project, array_to_string(seg[:i], '/') AS dir
  FROM (SELECT project, seg, unnest(range(1, len(seg))) AS i FROM files)
)
SELECT f.project, f.n_files, coalesce(d.n_dirs, 0)::BIGINT AS n_dirs
FROM (SELECT project, count(*) AS n_files FROM files GROUP BY project) f
LEFT JOIN (SELECT project, count(*) AS n_dirs FROM anc GROUP BY project) d USING (project)
""",
)
def scan_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One scan gives the files and the directories of the structure."""
    files = corpus(spark, sf)
    nodes = tree.nodes(files, tree.directories(files))
    return nodes.groupBy("project").agg(
        F.count_if(~F.col("is_dir")).alias("n_files"), F.count_if("is_dir").alias("n_dirs")
    )


@query(
    "bounded_read",
    f"""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS project,
       page_id || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^[^/]*', '') AS path,
       octet_length(encode(html))::BIGINT AS size,
       octet_length(encode(html)) > {PAGE_LIMIT} AS skipped,
       CASE WHEN octet_length(encode(html)) <= {PAGE_LIMIT} THEN html END AS content
FROM pages
""",
)
def bounded_read(spark: SparkSession, sf: str) -> DataFrame:
    files = bounded(page_corpus(spark, sf), PAGE_LIMIT)
    return files.select("project", "path", "size", "skipped", "content")


@query(
    "language_of",
    f"""
WITH {FILES}
SELECT project, path, {language_sql()} AS lang, upper({language_sql()}) AS file_type FROM files
""",
)
def language_of(spark: SparkSession, sf: str) -> DataFrame:
    lang = language(F.col("path"))
    return corpus(spark, sf).select("project", "path", lang.alias("lang"), F.upper(lang).alias("file_type"))


@query("fence_language", f"WITH {FILES} SELECT project, path, {fence_sql()} AS fence FROM files")
def fence_language_of(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("project", "path", fence_language(F.col("path")).alias("fence"))


@query(
    "path_lists",
    f"""
WITH {FILES},
lists AS (
  SELECT project, ' ' || min(path) || ' , ' || max(path) || chr(9) || ',' || count(*) AS input FROM files GROUP BY project
)
SELECT project, i::BIGINT AS pos, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS item
FROM (SELECT project, string_split(input, ',') AS parts, unnest(range(1, len(string_split(input, ',')) + 1)) AS i,
             unnest(string_split(input, ',')) AS part FROM lists)
""",
)
def path_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated path lists, one per project, as typed by a user."""
    typed = corpus(spark, sf).groupBy("project").agg(
        F.concat(
            F.lit(" "), F.min("path"), F.lit(" , "), F.max("path"), F.lit("\t,"), F.count("*").cast("string")
        ).alias("input")
    )
    items = typed.select("project", F.posexplode(paths.split_list(F.col("input"))).alias("pos", "item"))
    return items.select("project", (F.col("pos") + 1).cast("bigint").alias("pos"), "item")


@query(
    "slash_normalised",
    f"""
WITH {FILES}
SELECT project, path, replace(path, '/', chr(92)) AS raw FROM files
""",
)
def slash_normalised(spark: SparkSession, sf: str) -> DataFrame:
    raw = corpus(spark, sf).select("project", F.translate("path", "/", "\\").alias("raw"))
    return raw.select("project", paths.normalize(F.col("raw")).alias("path"), "raw")


KEPT = Profile(include_docs=True)


@query(
    "kept_files",
    f"""
WITH {FILES}
SELECT project, {language_sql()} AS lang, count(*) AS n_files, sum(size)::BIGINT AS n_bytes
FROM files
WHERE NOT {excluded_sql("seg")} AND len(seg) <= 21
  AND NOT starts_with(name, '~$') AND NOT regexp_matches(name, '^project_docs.*\\.md$')
  AND NOT contains(lower(path), 'corpusloom_config')
  AND NOT (contains(lower(name), '.spec.') OR contains(lower(name), '.test.'))
GROUP BY ALL
""",
)
def kept_files(spark: SparkSession, sf: str) -> DataFrame:
    return scan.language_totals(corpus(spark, sf), KEPT)
