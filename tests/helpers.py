from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import FILES


def files(spark: SparkSession, *entries) -> DataFrame:
    """``files`` rows from ``path`` or ``(path, content)`` entries of project p, or triples with a project."""
    rows = []
    for entry in entries:
        if isinstance(entry, str):
            entry = ("p", entry, "")
        elif len(entry) == 2:
            entry = ("p", *entry)
        project, path, content = entry
        size = len(content.encode()) if content is not None else 0
        rows.append((project, path, size, content))
    return spark.createDataFrame(rows, FILES)


def flags(spark: SparkSession, values, make) -> dict:
    """``make(column)`` evaluated for each string value."""
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r["v"]: r["flag"] for r in df.select("v", make(F.col("v")).alias("flag")).collect()}


def paths(df: DataFrame) -> set[str]:
    return {r["path"] for r in df.select("path").collect()}
