"""Positions and running sums in ordered groups, without putting a large group in one task.

A large group is cut into ranges of its order. Range partitioning of a corpus's
paths, stored once, gives them: ``path_index`` numbers its partitions, and the
first keys of partitions tell the range of any other row. Ranges only decide
which task sorts a row; positions are exact whatever they are. Nothing is counted
or collected when a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.session import materialize

#: Column of the range a row lies in; rows without one lie in a single range.
PLACE = "place"


def path_index(files: DataFrame, ranges: int | None = None) -> DataFrame:
    """``project, path, size, sort_key, place, leads``: a corpus's paths in tree order, stored once, without texts.

    ``place`` is the number of the range, ``leads`` marks its first row. There
    are as many ranges as shuffle partitions unless ``ranges`` is given.
    """
    slim = files.select("project", "path", "size", paths.tree_key(F.col("path"), F.lit(False)).alias("sort_key"))
    keys = ["project", "sort_key"]
    ordered = (slim.repartitionByRange(ranges, *keys) if ranges else slim.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    # Row numbers count from 0 in each partition, in their low 33 bits.
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return materialize(ordered.withColumn(PLACE, F.spark_partition_id()).withColumn("leads", leads), "paths")


def with_place(rows: DataFrame, index: DataFrame, key: Column) -> DataFrame:
    """Adds ``place`` to rows of ``project`` and a tree-order ``key``: how many ranges of ``index`` begin at or before it in its project.

    What is sent to every task is one key for each range of the index.
    """
    cuts = index.filter("leads").groupBy("project").agg(F.array_sort(F.collect_list("sort_key")).alias("__cuts"))
    found = rows.join(F.broadcast(cuts), "project", "left")
    return found.withColumn(PLACE, F.coalesce(_range_of("__cuts", key), F.lit(0))).drop("__cuts")


def _range_of(cuts: str, key: Column) -> Column:
    """How many cut points are at or below ``key``, by binary search; null without cut points."""
    between = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        above = (low < high) & (F.get(F.col(cuts), middle) <= key)
        return F.struct(
            F.when(above, middle + 1).otherwise(low).alias("low"),
            F.when((low < high) & ~above, middle).otherwise(high).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    return F.when(F.col(cuts).isNotNull(), F.aggregate(steps, between, halve, lambda state: state["low"]))


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "ord",
    blocks: Sequence[str] = (),
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Adds the 1-based position of each row in its group, ordered by ``blocks`` and then by ``order``.

    One task sorts the rows of a group that agree in ``blocks``, and what lies
    before them is added. ``sums`` names further columns: the sum of a column
    over the rows of the group before this one.
    """
    group, blocks, sums = list(group), list(blocks), dict(sums or {})
    inside = Window.partitionBy(*group, *blocks).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.row_number().over(inside).cast("bigint")}
    own.update({out: F.coalesce(F.sum(column).over(earlier), F.lit(0)) for out, column in sums.items()})
    numbered = df.withColumns(own)
    if not blocks:
        return numbered
    counts = df.groupBy(*group, *blocks).agg(F.count("*").alias(name), *[F.sum(column).alias(out) for out, column in sums.items()])
    before = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    facts = counts.select(*group, *blocks, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in own])
    whole = numbered.join(facts, [*group, *blocks])
    return whole.select(*df.columns, *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in own])


def with_running_max(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str, name: str, blocks: Sequence[str]) -> DataFrame:
    """Adds the largest ``column`` of the group's rows up to this one, in the order of ``blocks`` and then ``order``; null if there is none."""
    keys = [*group, *blocks]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    facts = df.groupBy(*keys).agg(F.max(column).alias("__most")).select(*keys, F.max("__most").over(before).alias("__before"))
    own = df.withColumn(name, F.max(column).over(inside)).join(facts, keys)
    return own.withColumn(name, F.greatest(name, "__before")).drop("__before")
