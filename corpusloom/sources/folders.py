"""Complete reads of folder trees: every file, whatever its name and size.

Folders are listed level by level, each level one job whose result is stored;
then the files small enough to show are read in parallel, once, into a stored
table whose columns are read as needed. Any file system that pyarrow opens will
do, as long as the executors reach it; a mounted one is listed entry by entry, so
a directory may hold any number of files.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, ship_package

ENTRIES = "path string, is_dir boolean, size bigint"
BODIES = "path string, size bigint, content string"

# Project of the files that lie beside the projects' folders.
LOOSE = "."

LIST_ROWS = 10_000
READ_BYTES = 64 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Path, whether a directory, and size of each entry; links that lead nowhere are files of no size."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    yield entry.path, entry.is_dir(), entry.stat().st_size
                except OSError:
                    yield entry.path, False, 0
    else:
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.path, info.type == fs.FileType.Directory, info.size or 0


def _lister(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(root)
        for batch in batches:
            for folder in batch["path"]:
                entries = _entries(system, folder)
                while part := list(islice(entries, LIST_ROWS)):
                    yield pd.DataFrame(part, columns=["path", "is_dir", "size"])

    return run


def _reader(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(system: fs.FileSystem, path: str) -> str | None:
        try:
            with system.open_input_stream(path) as stream:
                return stream.read().decode("utf-8", errors="replace")
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(root)
        for batch in batches:
            rows: list[tuple[str, int, str | None]] = []
            held = 0
            for path, size in zip(batch["path"], batch["size"]):
                rows.append((path, size, read(system, path)))
                held += size
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "size", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "size", "content"])

    return run


def list_folder(spark: SparkSession, root: str, prune: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(path, size)`` of all files below ``root``, however deep, paths relative to it.

    ``prune`` says of a relative directory path that it is not to be entered.
    """
    ship_package(spark)
    _, base = _open(root)
    frontier = spark.createDataFrame([(base,)], "path string")
    relative = F.expr(f"substring(path, {len(base.rstrip('/')) + 2})")
    found: DataFrame | None = None
    while True:
        listed = frontier.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_lister(root), ENTRIES)
        entries = materialize(listed, "listing")
        files = entries.filter("NOT is_dir").select(relative.alias("path"), "size")
        found = files if found is None else found.unionByName(files)
        dirs = entries.filter("is_dir")
        if prune is not None:
            dirs = dirs.filter(~prune(relative))
        frontier = dirs.select("path")
        if frontier.isEmpty():
            break
    return found


def read_folder(
    spark: SparkSession,
    root: str,
    max_file_size: int | None = None,
    project: str | None = None,
    prune: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The ``files`` table of a folder tree, stored: every body is read once, whatever is made of the table.

    Each directory directly below ``root`` is one project, unless ``project``
    names the whole of it; files lying in ``root`` itself are of the project
    ``LOOSE``. Files over ``max_file_size`` bytes, if that is set, and files that
    fail to open stay as rows without content. ``prune`` is asked about
    directory paths relative to their project; a project's own directory is
    never pruned.
    """
    inner = None
    if prune is not None:
        # One project: the path itself. Many: the part below the project's directory, if any.
        local = (lambda p: p) if project else (lambda p: F.regexp_replace(p, "^[^/]*/", ""))
        inner = (lambda p: prune(local(p))) if project else (lambda p: p.contains("/") & prune(local(p)))
    listing = list_folder(spark, root, inner)
    fits = F.lit(True) if max_file_size is None else F.col("size") <= max_file_size
    small = listing.filter(fits)
    total = small.agg(F.sum("size")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    _, base = _open(root)
    absolute = F.concat(F.lit(base.rstrip("/") + "/"), "path")
    bodies = small.select(absolute.alias("path"), "size").repartition(tasks, "path").mapInPandas(_reader(root), BODIES)
    shown = bodies.withColumn("path", F.expr(f"substring(path, {len(base.rstrip('/')) + 2})"))
    stubs = listing.filter(~fits).withColumn("content", F.lit(None).cast("string"))
    files = materialize(shown.unionByName(stubs), "files")
    if project:
        return files.select(F.lit(project).alias("project"), "path", "size", "content")
    return files.select(
        F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(LOOSE).alias("project"),
        F.regexp_replace("path", "^[^/]*/", "").alias("path"),
        "size",
        "content",
    )
