"""Path columns. Paths are relative to the project root and use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NUL cannot occur in a path and sorts before every other character, so a
# string key built with it orders like the list of path segments.
SEP = "\x00"


def normalize(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; empty for entries at the root."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.substring(path, F.lit(1), F.greatest(cut, F.lit(0)))


def depth(path: Column) -> Column:
    """Number of segments."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1).cast("bigint")


def extension(path: Column) -> Column:
    """From the last dot of the last segment, dot included; empty if none."""
    name = base_name(path)
    return F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def prefixes(path: Column, include_self: bool) -> Column:
    """Array of the ancestor directories of ``path``, outermost first."""
    seg = segments(path)
    last = F.size(seg) if include_self else F.size(seg) - 1
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.array_join(F.slice(seg, F.lit(1), i), "/"),
    )
    empty = F.array().cast("array<string>")
    return F.when((path == "") | (last < 1), empty).otherwise(chain)


def tree_key(path: Column, is_dir: Column) -> Column:
    """Sort key for tree order: parents first, directories before files, by name."""
    up = parent(path)
    head = F.when(up == "", F.lit("")).otherwise(
        F.concat(F.lit("0"), F.replace(up, F.lit("/"), F.lit(SEP + "0")), F.lit(SEP))
    )
    return F.concat(head, F.when(is_dir, F.lit("0")).otherwise(F.lit("1")), base_name(path))


def split_list(text: Column) -> Column:
    """``"a, b"`` -> ``["a", "b"]``: split on commas, white space trimmed."""
    return F.transform(F.split(text, ","), lambda item: strip(item))


def strip(text: Column) -> Column:
    """White space removed from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
