"""The ``files`` table: one row per file of every project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.languages import language
from corpusloom.schemas import FILES
from corpusloom.session import guard


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as Parquet; paths are normalised on the way in."""
    guard(spark)
    files = spark.read.schema(FILES).parquet(path)
    return files.withColumn("path", paths.normalize(F.col("path")))


def with_path_parts(files: DataFrame) -> DataFrame:
    """Adds name, extension, parent directory, depth and language."""
    path = F.col("path")
    return files.withColumns(
        {
            "name": paths.base_name(path),
            "ext": paths.extension(path),
            "parent": paths.parent(path),
            "depth": paths.depth(path),
            "lang": language(path),
        }
    )


def is_unread(size: Column, content: Column, max_file_size: Column | int | None) -> Column:
    """Too large (strictly over the limit, if there is one), or no content could be read."""
    limit = F.lit(max_file_size).cast("bigint")
    return (limit.isNotNull() & (size > limit)) | content.isNull()


def bounded(files: DataFrame, max_file_size: Column | int | None) -> DataFrame:
    """Every file, with ``skipped`` set and the content dropped when it cannot be shown."""
    skipped = F.coalesce(is_unread(F.col("size"), F.col("content"), max_file_size), F.lit(True))
    return files.withColumn("skipped", skipped).withColumn(
        "content", F.when(~F.col("skipped"), F.col("content"))
    )
