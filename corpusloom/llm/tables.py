"""Reading the given tables, stored intermediate tables, and Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom import session

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    session.guard(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read back: computed once, safe from lost executors.

    With ``clean`` Spark is asked to drop the shuffle files that only served to make it; it finds them by collecting garbage.
    """
    stored = session.materialize(df, f"llm-{name}")
    if clean:
        del df
        stored.sparkSession._jvm.System.gc()
    return stored


def on_executors(spark: SparkSession) -> None:
    """Lets Python workers import this package."""
    session.ship_package(spark)


def strings(column: pa.Array) -> pa.Array:
    """Text as large_string or binary as large_binary, without nulls."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    return column.fill_null(b"" if binary else "") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``text``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = strings(batch.column(batch.schema.get_field_index(text)))
        offsets = memoryview(ends.buffers()[1]).cast("q")[ends.offset : ends.offset + len(ends) + 1]
        first = 0
        while first < batch.num_rows:
            last = first + 1
            while last < batch.num_rows and offsets[last + 1] - offsets[first] <= limit:
                last += 1
            yield batch.slice(first, last - first)
            first = last
