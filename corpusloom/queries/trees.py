"""Directory nodes, tree order and drawn trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.rules import Profile
from corpusloom.operators import scan, tree
from corpusloom.plans.ranking import path_index
from corpusloom.queries.registry import FILES, excluded_sql, pruned_sql, query
from corpusloom.sources.derived import corpus

PROFILE = Profile(include_styles=False, include_docs=True, output_filename="notes.md")

LISTED_SQL = f"""
  NOT {excluded_sql("seg")} AND NOT regexp_matches(name, '^notes.*\\.md$')
  AND NOT regexp_matches(lower(name), '\\.(css|scss|sass|less)$')
  AND NOT (contains(lower(name), '.spec.') OR contains(lower(name), '.test.'))
"""


def nodes_sql(files: str = "files", listed: str = LISTED_SQL, pruned: str = pruned_sql("seg")) -> str:
    """Tree nodes with their order and last-sibling flag, then their drawn lines."""
    return f"""
nodes AS (
  SELECT project, seg, true AS is_dir FROM (
    SELECT DISTINCT project, seg[:i] AS seg FROM (SELECT project, seg, unnest(range(1, len(seg))) AS i FROM {files})
  ) WHERE NOT {pruned}
  UNION ALL
  SELECT project, seg, false FROM {files} WHERE {listed}
),
keyed AS (
  SELECT project, seg, is_dir, array_to_string(seg, '/') AS path, array_to_string(seg[:-2], '/') AS parent, seg[-1] AS name,
         list_transform(seg, lambda s, i: CASE WHEN is_dir OR i < len(seg) THEN '0' ELSE '1' END || s) AS key
  FROM nodes
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY key) AS ord,
         lead(path) OVER (PARTITION BY project, parent ORDER BY key) IS NULL AS is_last
  FROM keyed
),
indents AS (
  SELECT n.project, n.path, string_agg(CASE WHEN d.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY n.i) AS indent
  FROM (SELECT project, path, seg, unnest(range(1, len(seg))) AS i FROM placed) n
  JOIN placed d ON d.project = n.project AND d.path = array_to_string(n.seg[:n.i], '/')
  GROUP BY n.project, n.path
),
tree_lines AS (
  SELECT project, ord, coalesce(indent, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name
         || CASE WHEN is_dir THEN '/' ELSE '' END AS line
  FROM placed LEFT JOIN indents USING (project, path)
  UNION ALL
  SELECT DISTINCT project, 0, '.' FROM placed
)
"""


def _nodes(files: DataFrame) -> DataFrame:
    return tree.nodes(scan.listed(files, PROFILE), tree.directories(files, PROFILE))


def indexed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Ordering and drawing read paths several times, so those are stored once, in ranges."""
    return _nodes(path_index(corpus(spark, sf)))


@query(
    "dir_nodes",
    f"WITH {FILES}, {nodes_sql()} SELECT project, path, parent, name, len(seg)::BIGINT AS depth FROM keyed WHERE is_dir",
)
def dir_nodes(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusloom.functions.paths import depth

    dirs = _nodes(corpus(spark, sf)).filter("is_dir")
    return dirs.select("project", "path", "parent", "name", depth(F.col("path")).alias("depth"))


@query("tree_order", f"WITH {FILES}, {nodes_sql()} SELECT project, ord, path, is_dir FROM placed")
def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    return tree.in_order(indexed_nodes(spark, sf)).select("project", "ord", "path", "is_dir")


@query("tree_last_sibling", f"WITH {FILES}, {nodes_sql()} SELECT project, path, is_last FROM placed")
def tree_last_sibling(spark: SparkSession, sf: str) -> DataFrame:
    return tree.with_last_flag(indexed_nodes(spark, sf)).select("project", "path", "is_last")


@query("tree_lines", f"WITH {FILES}, {nodes_sql()} SELECT project, ord, line FROM tree_lines")
def tree_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tree.lines(indexed_nodes(spark, sf))
