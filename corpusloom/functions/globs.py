"""Glob patterns as regular expressions.

The translation runs once per pattern on the driver (or once per profile row);
matching itself is a plain ``rlike`` on the executors.

``*`` and ``?`` stay within a segment, ``[a-z]`` and ``[^a-z]`` are classes,
``\\`` escapes in globs on names; in globs on paths it is another slash, as in
stored paths, and a class (``[*]``) takes a character literally. A segment that is exactly ``**`` stands for zero or more
directories. A malformed pattern matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import paths
from corpusloom.session import ship_package

NEVER = r"[^\s\S]"

_SPECIAL = frozenset("\\.^$|?*+()[]{}")


class MalformedGlob(ValueError):
    """The pattern breaks the glob syntax."""


def quote(text: str) -> str:
    """``text`` as a regex literal, in the subset Java and RE2 share."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def _class_char(pattern: str, at: int) -> tuple[str, int]:
    if at < len(pattern) and pattern[at] == "\\":
        at += 1
    elif at < len(pattern) and pattern[at] in "-]":
        raise MalformedGlob(pattern)
    if at >= len(pattern):
        raise MalformedGlob(pattern)
    char = pattern[at]
    return ("\\" + char if char in "\\[]^-&" else char), at + 1


def _char_class(pattern: str, at: int) -> tuple[str, int]:
    negated = at < len(pattern) and pattern[at] == "^"
    at += negated
    ranges: list[str] = []
    while True:
        if at < len(pattern) and pattern[at] == "]" and ranges:
            break
        low, at = _class_char(pattern, at)
        high = low
        if at < len(pattern) and pattern[at] == "-":
            high, at = _class_char(pattern, at + 1)
        if low[-1] <= high[-1]:
            ranges.append(low if low == high else f"{low}-{high}")
        elif not ranges:
            ranges.append("")
    body = "".join(ranges)
    if negated:
        return f"[^/{body}]", at + 1
    return (f"[{body}]" if body else NEVER), at + 1


def _segment(pattern: str) -> str:
    out: list[str] = []
    at = 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "*":
            if not out or out[-1] != "[^/]*":
                out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[":
            text, at = _char_class(pattern, at)
            out.append(text)
        elif char == "\\":
            if at >= len(pattern):
                raise MalformedGlob(pattern)
            out.append(quote(pattern[at]))
            at += 1
        else:
            out.append(quote(char))
    return "".join(out)


def name_regex(pattern: str) -> str:
    """Unanchored regex for a glob on one name; never crosses a slash."""
    try:
        return _segment(pattern)
    except MalformedGlob:
        return NEVER


def path_regex(pattern: str) -> str:
    """Unanchored regex for a glob on a whole path, ``**`` included."""
    parts: list[str] = []
    for part in pattern.replace("\\", "/").split("/"):
        if part == "**" and parts and parts[-1] == "**":
            continue
        parts.append(part)
    if parts == ["**"]:
        return r"[\s\S]*"
    out = ""
    for i, part in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        if part != "**":
            text = name_regex(part)
            if text == NEVER:
                return NEVER
            out += text if first or parts[i - 1] == "**" else "/" + text
        elif first:
            out += "(?:[^/]+/)*"
        elif last:
            out += r"(?:/[\s\S]*)?"
        else:
            out += "/(?:[^/]+/)*"
    return out


def any_of(regexes: Iterable[str]) -> str:
    """One anchored alternation; matches nothing when the list is empty."""
    body = "|".join(dict.fromkeys(regexes))
    return rf"^(?:{body})\z" if body else NEVER


def names_regex(patterns: Sequence[str]) -> str:
    return any_of(name_regex(p) for p in patterns)


def paths_regex(patterns: Sequence[str]) -> str:
    return any_of(path_regex(p) for p in patterns)


def matches_name(name: Column, patterns: Sequence[str]) -> Column:
    """A base name matches any of the globs."""
    return name.rlike(names_regex(patterns))


def matches_path(path: Column, patterns: Sequence[str]) -> Column:
    """A whole path matches any of the globs."""
    return path.rlike(paths_regex(patterns))


def under_any(path: Column, roots: Sequence[str]) -> Column:
    """The path is one of ``roots`` or lies below one."""
    return path.rlike(roots_regex(roots))


def roots_regex(roots: Sequence[str]) -> str:
    """Anchored regex for the listed paths and everything below them."""
    body = "|".join(dict.fromkeys(quote(r.replace("\\", "/").rstrip("/")) for r in roots))
    return rf"^(?:{body})(?:/[\s\S]*)?\z" if body else NEVER


def regex_column(arrays: Column, kind: str) -> Column:
    """Per-row regex for an ``array<string>`` column of patterns.

    For rule *tables*: one call per profile row, never per file.
    """
    ship_package(SparkSession.active())
    build = {"names": names_regex, "paths": paths_regex, "roots": roots_regex}[kind]

    @F.pandas_udf(T.StringType())
    def compile_patterns(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ps: build([p for p in ps if p is not None]) if ps is not None else NEVER)

    return compile_patterns(arrays)


# What a pattern and the paths it matches have in common, the most telling first.
BY_NAME, BY_BOTH, BY_EXTENSION, BY_TOP, BY_NOTHING = "name", "top-ext", "ext", "top", "any"
_WILD = set("*?[")


def index_key(pattern: str) -> tuple[str, str]:
    """A key that every path matched by the glob has too: its name, its first segment and extension or one of them, or nothing."""
    parts = pattern.replace("\\", "/").split("/")
    first, last = parts[0], parts[-1]
    if last and not _WILD & set(last):
        return BY_NAME, last
    ending = last[last.rfind(".") :] if "[" not in last and "." in last else ""
    ending = "" if _WILD & set(ending) else ending
    top = first if len(parts) > 1 and not _WILD & set(first) else ""
    if top and ending:
        return BY_BOTH, f"{top}/{ending}"
    if ending:
        return BY_EXTENSION, ending
    return (BY_TOP, top) if top else (BY_NOTHING, "")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "value", "regex")]))
def _indexed(patterns: pd.Series) -> pd.DataFrame:
    rows = [(*index_key(p), path_regex(p)) if p is not None else (None, None, None) for p in patterns]
    return pd.DataFrame(rows, columns=["kind", "value", "regex"])


def indexed(pattern: Column) -> Column:
    """``kind, value, regex`` of a glob on whole paths; one call per pattern, never per file."""
    ship_package(SparkSession.active())
    return _indexed(pattern)


def keys_of(path: Column) -> Column:
    """The keys that patterns matching this path may have, as an array of ``kind, value``."""
    ending, top = paths.extension(path), F.substring_index(path, "/", 1)
    found = {BY_NAME: paths.base_name(path), BY_BOTH: F.concat(top, F.lit("/"), ending), BY_EXTENSION: ending, BY_TOP: top, BY_NOTHING: F.lit("")}
    return F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in found.items()])
