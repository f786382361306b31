"""Saved selections: an append-only log of saves and deletes per project.

Saving again under the same key replaces, deleting leaves a tombstone, and the
most recent save of a project stays loadable as "last" whatever is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import split_list
from corpusloom.plans.ranking import with_position
from corpusloom.schemas import SELECTION_LOG

LAST = "last"
FIELDS = ("name", "description", "created", "paths", "patterns")


def key_of(name: Column) -> Column:
    """Names that differ only in spaces and underscores share a key."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def saves(requests: DataFrame) -> DataFrame:
    """Log rows for ``(project, seq, name, description, created, paths)``; patterns are not kept."""
    return _log_rows(requests.withColumn("patterns", F.lit(None).cast("array<string>")), "save")


def deletes(requests: DataFrame) -> DataFrame:
    """Log rows for ``(project, seq, name, created)``."""
    none = {"description": "string", "paths": "array<string>", "patterns": "array<string>"}
    return _log_rows(
        requests.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}), "delete"
    )


def _log_rows(rows: DataFrame, op: str) -> DataFrame:
    full = rows.withColumns({"op": F.lit(op), "key": key_of(F.col("name"))})
    return full.select(*[F.col(f.name).cast(f.dataType) for f in SELECTION_LOG.fields])


def append(log_rows: DataFrame, path: str) -> None:
    log_rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTION_LOG).parquet(path)


def _newest(log: DataFrame, by: list[str]) -> DataFrame:
    """The row with the highest ``seq`` per group, combined before the shuffle."""
    rest = [f.name for f in SELECTION_LOG.fields if f.name not in (*by, "seq")]
    newest = F.max_by(F.struct(*rest), F.col("seq"))
    grouped = log.groupBy(*by).agg(F.max("seq").alias("seq"), newest.alias("row"))
    return grouped.select(*by, "seq", "row.*")


def state(log: DataFrame) -> DataFrame:
    """Newest row per ``(project, key)``, deletions included."""
    return _newest(log, ["project", "key"])


def current(log: DataFrame) -> DataFrame:
    """The selections that exist, one row per ``(project, key)``."""
    return state(log).filter("op = 'save'")


def deleted(log: DataFrame) -> DataFrame:
    """The keys whose newest entry is a deletion."""
    return state(log).filter("op = 'delete'")


def missing(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete or load requests ``(project, name)`` that name no existing selection."""
    keyed = requests.withColumn("key", key_of(F.col("name")))
    return keyed.join(current(log).select("project", "key"), ["project", "key"], "left_anti").drop("key")


def last(log: DataFrame) -> DataFrame:
    """The most recent save of each project."""
    return _newest(log.filter("op = 'save'"), ["project"])


def load(log: DataFrame, name: str = "") -> DataFrame:
    """Every project's selection of that name; the most recent save for empty or ``last``."""
    if name in ("", LAST):
        return last(log)
    return current(log).filter(F.col("key") == key_of(F.lit(name)))


def dispatch(profiles: DataFrame, requests: DataFrame, log: DataFrame) -> DataFrame:
    """Profiles with the selection their project's request asks for, and a ``status``.

    ``requests`` is ``(project, use_last, name, paths)``, one row per project,
    any field unset. The first that is set decides: the most recent save (all
    files if there is none), a saved selection by name (``not_found`` if there
    is none), a comma-separated list of paths. Otherwise the profile's own mode
    stays, unknown modes becoming ``all``.
    """
    asked = requests.withColumn("key", key_of(F.coalesce("name", F.lit(""))))
    newest = last(log).select("project", F.col("paths").alias("last_paths"), F.lit(True).alias("has_last"))
    named = current(log).select("project", "key", F.col("paths").alias("named_paths"), F.lit(True).alias("has_named"))
    known = (
        profiles.join(asked, "project", "left").join(newest, "project", "left").join(named, ["project", "key"], "left")
    )
    is_last = F.coalesce("use_last", F.lit(False))
    is_name = ~is_last & (F.coalesce("key", F.lit("")) != "")
    by_last = is_last | (is_name & (F.col("key") == LAST))
    by_paths = ~is_last & ~is_name & (F.coalesce("paths", F.lit("")) != "")
    found = F.when(by_last, F.col("has_last")).when(is_name, F.col("has_named"))
    none = F.array().cast("array<string>")
    paths = (
        F.when(by_last & F.col("has_last"), F.coalesce("last_paths", none))
        .when(is_name & ~by_last & F.col("has_named"), F.coalesce("named_paths", none))
        .when(by_paths, split_list(F.col("paths")))
        .otherwise(F.col("included_paths"))
    )
    own = F.when(F.col("selection_mode").isin("list", "patterns", "interactive"), F.col("selection_mode"))
    mode = (
        F.when(found | by_paths, F.lit("list"))
        .when(is_last, F.lit("all"))
        .when(is_name, F.col("selection_mode"))
        .otherwise(F.coalesce(own, F.lit("all")))
    )
    status = F.when(is_name & found.isNull(), F.lit("not_found")).otherwise(F.lit("ok"))
    changed = {"selection_mode": mode.alias("selection_mode"), "included_paths": paths.alias("included_paths")}
    return known.select(*[changed.get(c, F.col(c)) for c in profiles.columns], status.alias("status"))


def catalogue(log: DataFrame) -> DataFrame:
    """Existing selections in key order: ``project, ord, key, name, description, n_paths, label``."""
    names = current(log).filter(F.col("key") != LAST)
    # Entries are ordered as the files they stand for, whose names continue with a dot.
    keyed = names.withColumn("__file", F.concat("key", F.lit(".")))
    listed = with_position(keyed, ["project"], ["__file"])
    n = F.coalesce(F.size("paths"), F.lit(0)).cast("bigint")
    note = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description"))
    label = F.concat(
        F.col("name"), F.coalesce(note, F.lit("")), F.lit(" ("), n.cast("string"), F.lit(" files)")
    )
    return listed.select(
        "project", "ord", "key", "name", "description", n.alias("n_paths"), label.alias("label")
    )


def to_json(selections: DataFrame) -> DataFrame:
    """One JSON text per selection, ``(project, document)``."""
    return selections.select("project", F.to_json(F.struct(*FIELDS)).alias("document"))


def from_json(documents: DataFrame, created: Column, first_seq: Column) -> DataFrame:
    """Log rows that save imported documents anew: new stamp and number, patterns dropped."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SELECTION_LOG.fields if f.name in FIELDS)
    parsed = documents.withColumn("s", F.from_json("document", fields))
    return saves(
        parsed.select(
            "project", first_seq.alias("seq"), "s.name", "s.description", created.alias("created"), "s.paths"
        )
    )


def export_to(selections: DataFrame, path: str) -> None:
    to_json(selections).write.json(path)


def import_from(spark: SparkSession, path: str, created: Column, first_seq: Column) -> DataFrame:
    documents = spark.read.schema("project string, document string").json(path)
    return from_json(documents, created, first_seq)
