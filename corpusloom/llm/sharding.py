"""Sharding: weighted rendezvous hashing of stable record keys.

Each shard draws a number from the key and its own name, and the key goes to
the shard with the largest score -weight / ln(draw), the first of equal ones. A
shard's draws do not depend on the others, so one more shard takes rows only
into itself, and removing one moves only its rows. Shards get rows in
proportion to their weights.

A row's slot counts the rows before it in its shard. Rows are first counted by
(key, size, checksum), so equal rows are one; a shard's rows are cut into
``BUCKETS`` buckets by hash, each numbered by itself and shifted by the counts
before it, so no task orders a whole shard.

Defined cases: a null text has size 16 and no checksum; a null key is a key
like any other; equal rows get slots next to each other; only the key and text
columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query

SHARDS = 40
#: Buckets of a shard; their counts, shards times this, are what every task gets.
BUCKETS = 1024
#: Slots of equal rows that are written out at once.
RUN = 1 << 16
ROW_BYTES = 16


def shard_of(key: str, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; a weight of 0 takes nothing."""
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            # 53 bits of the hash, moved off 0 and 1.
            draw = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(shard)), 11) + 0.5) * 2.0**-53
            scores.append(F.struct((-weight / F.log(draw)).alias("score"), F.lit(-shard).alias("shard")))
    if not scores:
        raise ValueError("no shard has a weight")
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["shard"]


def assign_shards(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: ``key, size, text_crc32, shard, slot, grown_shard`` (with one shard more)."""
    counted = (
        docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
        .select(
            "key", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        )
        .groupBy("key", "size", "text_crc32").agg(F.count("*").alias("rows"))
        .withColumn("shard", shard_of("key", weights))
        .withColumn("bucket", F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    )
    sizes = counted.groupBy("shard", "bucket").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("own", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    # At most shards times buckets rows of three numbers.
    placed = placed.join(F.broadcast(starts), ["shard", "bucket"])
    placed = placed.withColumn("first", F.col("start") + F.col("own")).withColumn("end", F.col("first") + F.col("rows"))
    # Equal rows come back in runs, so that no array holds more than a run's slots.
    runs = placed.select("*", F.explode(F.sequence("first", F.col("end") - 1, F.lit(RUN))).alias("run"))
    slots = F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("end")) - 1)).alias("slot")
    return runs.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", slots, shard_of("key", [*weights, new_weight]).alias("grown_shard"),
    )


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(tables.read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
