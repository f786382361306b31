"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Spark 4.1 takes a union of branches that are partitioned alike as partitioned itself. Where adaptive execution
#: then turns the join below one branch into a broadcast join, rows of one group stay in several partitions, and
#: aggregates above the union give a group several rows.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def guard(spark: SparkSession) -> None:
    """Turns that off for a session that was built elsewhere; results are wrong otherwise."""
    spark.conf.set(UNION_PARTITIONING, "false")


def build_session(master: str = "local[*]", app: str = "corpusloom", **conf: object) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for ``.``."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(UNION_PARTITIONING, "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without it only a session on one machine has a folder, in its warehouse; on a
    cluster that might be any machine's own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def _own_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark).rstrip('/')}/corpusloom/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    The result survives executor loss, is computed once however often it is
    used, and has a known size on disk: Spark then broadcasts it only when that
    size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    guard(spark)
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python helpers import it. Once per application.

    The archive is made where the driver runs; Spark hands it to the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
