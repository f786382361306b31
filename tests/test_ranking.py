"""Positions, places and running sums are exact however small the ranges are."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import tree_key
from corpusloom.plans.ranking import path_index, with_place, with_position
from corpusloom.plans.skew import join_facts


def skewed(spark):
    """Half of all files belong to one project; paths are long and unordered."""
    return spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 37)).alias("project"),
        F.concat(F.lit("d"), F.col("id") % 11, F.lit("/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"),
        F.col("id").alias("size"),
        F.lit("text").alias("content"),
    )


def keyed(df):
    return df.withColumn("k", tree_key(F.col("path"), F.lit(False)))


@pytest.mark.parametrize("ranges", [1, 3, 40, 500])
def test_position_and_sum_equal_a_plain_window(spark, ranges):
    df = keyed(skewed(spark))
    whole = Window.partitionBy("project").orderBy("k")
    plain = df.withColumn("ord", F.row_number().over(whole).cast("bigint")).withColumn(
        "start", F.coalesce(F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = with_place(df, path_index(skewed(spark), ranges), F.col("k"))
    got = with_position(placed, ["project"], ["k"], "ord", ["place"], {"start": "size"}).drop("place")
    assert got.columns == plain.columns
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_index_keeps_order_and_says_where_each_row_lies(spark):
    files = skewed(spark)
    index = path_index(files, 20)
    assert index.count() == 4000 and "content" not in index.columns
    found = with_place(keyed(files), index, F.col("k")).select("project", "path", F.col("place").alias("found"))
    both = index.join(found, ["project", "path"]).groupBy("project", "place").agg(F.min("found").alias("a"), F.max("found").alias("b")).collect()
    # A range of the index is one place of its project, and a large project has many.
    assert all(r["a"] == r["b"] for r in both)
    hot = sorted((r["place"], r["a"]) for r in both if r["project"] == "hot")
    assert len(hot) >= 8 and [b for _, b in hot] == sorted({b for _, b in hot})


def test_ranges_are_balanced(spark):
    rows = path_index(skewed(spark), 20).groupBy("place").count().collect()
    assert max(r["count"] for r in rows) < 3 * 4000 / 20


def test_empty_corpus(spark):
    files = skewed(spark).limit(0)
    placed = with_place(keyed(files), path_index(files), F.col("k"))
    assert with_position(placed, ["project"], ["k"], blocks=["place"]).count() == 0


def test_equal_keys_are_all_numbered(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") % 3).alias("k"), (F.col("id") % 3).alias("b"))
    ords = [r["ord"] for r in with_position(df, ["g"], ["k"], blocks=["b"]).orderBy("ord").collect()]
    assert ords == list(range(1, 501))


def test_content_is_shuffled_once_for_positions(spark):
    df = keyed(skewed(spark)).withColumn("text", F.repeat("k", 3))
    got = with_position(with_place(df, path_index(skewed(spark), 20), F.col("k")), ["project"], ["k"], blocks=["place"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Rows go straight to (project, place); by project alone only the small tables of cuts and counts are shuffled.
    with_text = [line for line in exchanges if "place" in line]
    assert len(with_text) <= 3, plan


def test_plans_are_built_without_jobs(spark):
    """Only the index, a stored table, runs anything: nothing is counted or collected."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    index = path_index(skewed(spark))
    stored = set(tracker.getJobIdsForGroup())
    assert len(stored - before) <= 4
    with_position(with_place(keyed(skewed(spark)), index, F.col("k")), ["project"], ["k"], blocks=["place"])
    assert set(tracker.getJobIdsForGroup()) == stored


def test_facts_are_joined_without_jobs(spark):
    rows = skewed(spark)
    facts = rows.groupBy("project").agg(F.count("*").alias("n"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    joined = join_facts(rows, facts, ["project"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert joined.filter("project = 'hot'").count() == 2000


def test_groups_above_a_union_are_whole_in_any_session(spark, sf_dir):
    """A session built elsewhere has Spark's own setting, under which a tree's directories were drawn twice."""
    from corpusloom.queries import QUERIES
    from corpusloom.session import UNION_PARTITIONING

    spark.conf.set(UNION_PARTITIONING, "true")
    rows = QUERIES["document_go"](spark, sf_dir).collect()
    assert spark.conf.get(UNION_PARTITIONING) == "false"
    assert len({(r["project"], r["ord"]) for r in rows}) == len(rows)
