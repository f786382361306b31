"""Keep, skip and select files under one run profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.globs import matches_name
from corpusloom.functions.languages import language
from corpusloom.functions.paths import base_name
from corpusloom.functions.rules import Profile
from corpusloom.sources.files import is_unread


def classify(files: DataFrame, profile: Profile, type_rule: str = "stub") -> DataFrame:
    """The files that get a section, with ``lang`` and ``skipped``.

    Name rules and the selection remove rows. Size and read failures keep the
    row as skipped. A category toggle does the same under ``type_rule="stub"``
    and removes the row under ``"remove"``.
    """
    path = F.col("path")
    kept = files.filter(rules.is_kept(path, profile) & rules.is_selected(path, profile))
    off = rules.is_type_skipped(path, profile)
    if type_rule == "remove":
        kept, off = kept.filter(~off), F.lit(False)
    elif type_rule != "stub":
        raise ValueError(f"type_rule {type_rule!r} is neither 'stub' nor 'remove'")
    unread = F.coalesce(
        is_unread(F.col("size"), F.col("content"), profile.max_file_size), F.lit(True)
    )
    return (
        kept.withColumn("lang", language(path))
        .withColumn("skipped", off | unread)
        .withColumn("content", F.when(~F.col("skipped"), F.col("content")))
    )


def decide(index: DataFrame, profile: Profile, type_rule: str = "stub") -> DataFrame:
    """The same decisions from paths and sizes alone; ``with_texts`` adds the contents."""
    return classify(index.withColumn("content", F.lit("")), profile, type_rule).drop("content")


def with_texts(decided: DataFrame, files: DataFrame, on: Sequence[str] = ("project", "path")) -> DataFrame:
    """Joins ``content`` to the files that are shown; those without any become skipped. Texts move once, by file."""
    texts = files.select(*on, "content")
    shown = decided.filter(~F.col("skipped")).join(texts, list(on)).withColumn("skipped", F.col("content").isNull())
    stubs = decided.filter("skipped").withColumn("content", F.lit(None).cast("string"))
    return shown.unionByName(stubs)


def listed(files: DataFrame, profile: Profile) -> DataFrame:
    """The files shown in the tree; the selection only decides about sections."""
    path = F.col("path")
    return files.filter(rules.is_listed(path, profile) & ~rules.is_type_skipped(path, profile))


def selected_count(files: DataFrame, profile: Profile) -> DataFrame:
    """Files per project that pass the artifact rule, the user's name patterns and the selection.

    Directories are not pruned here.
    """
    path = F.col("path")
    name = base_name(path)
    named = matches_name(name, [p for p in profile.excluded_patterns if "/" not in p])
    dropped = rules.is_own_artifact(name, profile) | (
        named & ~rules.is_important(name, profile.important_files)
    )
    return (
        files.filter(~dropped & rules.is_selected(path, profile))
        .groupBy("project")
        .agg(F.count("*").alias("n_files"))
    )


def language_totals(files: DataFrame, profile: Profile) -> DataFrame:
    """Kept files and bytes per project and language."""
    return (
        files.filter(rules.is_kept(F.col("path"), profile) & ~rules.is_type_skipped(F.col("path"), profile))
        .groupBy("project", language(F.col("path")).alias("lang"))
        .agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    )
