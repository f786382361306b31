"""Which files count: excludes, own artifacts, category toggles, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import globs
from corpusloom.functions.paths import base_name, depth

# Names excluded wherever they occur, as file or directory.
SYSTEM_NAMES = (
    "node_modules", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum",
    ".git", ".idea", ".vscode", "dist", "build", "out", "bin", "obj",
    "__pycache__", ".pytest_cache", "coverage", ".nyc_output",
    ".angular", ".nx", ".next", ".nuxt", "__tests__", "__snapshots__", "e2e",
    "*.log", "*.tmp", "*.bak",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.bmp", "*.webp",
    "project_structure.txt",
)
DOC_PATTERN = "*.md"  # excluded too while documents are off

# Further names excluded as directories only.
SYSTEM_DIRS = ("vendor", "target", ".cache", "cypress")

# Lock files and temporary files a package manager or editor leaves.
LOCK_FILES = ("go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")
TEMP_PREFIX = "~$"

# Extensions of the optional categories.
STYLE_EXTENSIONS = (".css", ".scss", ".sass", ".less")
MARKUP_EXTENSIONS = (".html", ".htm")
CONFIG_EXTENSIONS = (".json", ".yaml", ".yml")
DOC_EXTENSIONS = (".md", ".markdown")

# The default profile. The size is what a stored profile without one resolves to.
DEFAULT_MAX_FILE_SIZE = 2 * 1024 * 1024
DEFAULT_EXCLUDED = (".gitignore", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.bak")

SELECTION_MODES = ("all", "interactive", "patterns", "list")


@dataclass(frozen=True)
class Profile:
    """Rules for one run, the same for every project.

    ``config_stem`` marks the engine's own config files: any name containing it
    is left out; an empty one marks none. Files over ``max_file_size`` bytes are
    shown without content, and entries of directories nested deeper than
    ``max_depth`` levels are left out; both are off unless set.
    """

    max_file_size: int | None = None
    max_depth: int | None = None
    include_tests: bool = False
    include_configs: bool = True
    include_markup: bool = True
    include_styles: bool = True
    include_docs: bool = False
    excluded_patterns: Sequence[str] = DEFAULT_EXCLUDED
    documentation_mode: str = "full"
    selection_mode: str = "all"
    included_paths: Sequence[str] = ()
    include_patterns: Sequence[str] = ()
    important_files: Sequence[str] = ()
    output_filename: str = "project_docs.md"
    config_stem: str = "corpusloom_config"

    @property
    def output_stem(self) -> str:
        """Output name without directory and extension."""
        return stem_of(self.output_filename)


def stem_of(filename: str) -> str:
    name = filename.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name else name


def effective_excludes(profile: Profile) -> list[str]:
    """User patterns, earlier outputs, system names, documents when they are off; no duplicates."""
    outputs = [profile.output_stem + DOC_PATTERN] if profile.output_stem else []
    docs = [] if profile.include_docs else [DOC_PATTERN]
    return list(dict.fromkeys([*profile.excluded_patterns, *outputs, *SYSTEM_NAMES, *docs]))


# --- name rules: these remove a file -------------------------------------------------


def _names(patterns: Sequence[str]) -> str:
    """Regex for one whole segment that matches any of the globs.

    ``*.ext`` globs, the most common kind, share one look back from the end of
    the segment instead of scanning it once each.
    """
    endings = [p[1:] for p in patterns if p[:1] == "*" and len(p) > 1 and not set(p[1:]) & set("*?[\\")]
    others = [globs.name_regex(p) for p in patterns if p[1:] not in endings or p[:1] != "*"]
    if endings:
        others.append(f"[^/]*+(?<={'|'.join(map(globs.quote, endings))})")
    return "|".join(others)


def exclude_regex(patterns: Sequence[str], important: Sequence[str], directory: bool) -> str:
    """Regex over a whole path that finds a match when the path is excluded.

    ``patterns`` are effective excludes. Patterns without a slash apply to every
    segment, patterns with one to the path and to each directory above it.
    ``directory`` says whether the last segment is a directory. An important
    name is never excluded by itself but goes with an excluded directory above
    it.
    """
    keep = "|".join(globs.quote(name) for name in important)
    end = r"(?:/|\z)"
    guard = f"(?!(?:{keep}){end})" if keep else ""
    patterns = list(dict.fromkeys(patterns))
    names = _names([p for p in patterns if "/" not in p])
    dirs = "(?:" + "|".join(map(globs.quote, SYSTEM_DIRS)) + ")" + (end if directory else "/")
    segment = f"(?:{names}){end}|{dirs}" if names else dirs
    alternatives = [f"(?:^|/){guard}(?:{segment})"]
    wholes = "|".join(globs.path_regex(p) for p in patterns if "/" in p)
    if wholes:
        not_kept = rf"(?!(?:[\s\S]*/)?(?:{keep})\z)" if keep else ""
        alternatives += [rf"^(?:{wholes})/[\s\S]", rf"^{not_kept}(?:{wholes})\z"]
    return "|".join(alternatives)


def is_excluded(path: Column, profile: Profile) -> Column:
    """A file removed by system or user excludes, by its own name or a directory's."""
    return path.rlike(exclude_regex(effective_excludes(profile), profile.important_files, directory=False))


def is_pruned(directory: Column, profile: Profile) -> Column:
    """A directory that is not descended into."""
    return directory.rlike(
        exclude_regex(effective_excludes(profile), profile.important_files, directory=True)
    ) | is_own_config(directory, profile.config_stem)


def is_own_config(path: Column, stem: str) -> Column:
    """Some name on the path carries the engine's own config stem, in any case."""
    return F.lower(path).contains(stem.lower()) if stem else F.lit(False)


def is_own_output(name: Column, output_filename: Column, output_stem: Column) -> Column:
    """The output file itself, or an earlier output ``<stem>*.md``."""
    current = (output_filename != "") & (name == base_name(output_filename))
    earlier = (
        (output_stem != "")
        & name.startswith(output_stem)
        & name.endswith(".md")
        & (F.length(name) >= F.length(output_stem) + 3)
    )
    return current | earlier


def is_leftover(name: Column) -> Column:
    """Lock files and editor temporaries."""
    return name.isin(*LOCK_FILES) | name.startswith(TEMP_PREFIX)


def is_own_artifact(name: Column, profile: Profile) -> Column:
    """Own config, own outputs, and leftovers; important names keep the latter."""
    outputs = is_own_output(name, F.lit(profile.output_filename), F.lit(profile.output_stem))
    leftovers = is_leftover(name) & ~is_important(name, profile.important_files)
    return is_own_config(name, profile.config_stem) | outputs | leftovers


def is_important(name: Column, important: Sequence[str]) -> Column:
    return name.isin(*important) if important else F.lit(False)


def within_depth(path: Column, max_depth: int | None) -> Column:
    return F.lit(True) if max_depth is None else depth(path) <= max_depth + 1


def is_listed(path: Column, profile: Profile) -> Column:
    """The file survives the name rules of the tree: excludes, own config and outputs, depth."""
    outputs = is_own_output(base_name(path), F.lit(profile.output_filename), F.lit(profile.output_stem))
    own = is_own_config(path, profile.config_stem) | outputs
    return within_depth(path, profile.max_depth) & ~own & ~is_excluded(path, profile)


def is_kept(path: Column, profile: Profile) -> Column:
    """The file survives every name rule and gets a section of its own."""
    return is_listed(path, profile) & ~is_own_artifact(base_name(path), profile)


# --- type rules ----------------------------------------------------------------------


def _ends(path: Column, extensions: Sequence[str]) -> Column:
    """The extension, in any case, is one of those listed."""
    lower = F.lower(path)
    return reduce(or_, [lower.endswith(ext) for ext in extensions])


def is_style(path: Column) -> Column:
    return _ends(path, STYLE_EXTENSIONS)


def is_markup(path: Column) -> Column:
    return _ends(path, MARKUP_EXTENSIONS)


def is_config(path: Column) -> Column:
    return _ends(path, CONFIG_EXTENSIONS) | F.lower(base_name(path)).contains("config")


def is_test(path: Column) -> Column:
    name = F.lower(base_name(path))
    return name.contains(".spec.") | name.contains(".test.")


def is_doc(path: Column) -> Column:
    return _ends(path, DOC_EXTENSIONS)


CATEGORIES = {
    "include_styles": is_style,
    "include_markup": is_markup,
    "include_configs": is_config,
    "include_tests": is_test,
    "include_docs": is_doc,
}


def is_toggled_off(path: Column, toggles: dict[str, Column]) -> Column:
    """In at least one category whose include flag is false."""
    off = F.lit(False)
    for flag, test in CATEGORIES.items():
        off = off | (~toggles[flag] & test(path))
    return off


def is_type_skipped(path: Column, profile: Profile) -> Column:
    """Dropped by a category toggle, unless the path ends in an important name."""
    off = F.lit(False)
    for flag, test in CATEGORIES.items():
        if not getattr(profile, flag):
            off = off | test(path)
    listed = F.lit(False)
    for name in profile.important_files:
        listed = listed | path.endswith(name)
    return off & ~listed


# --- selection -----------------------------------------------------------------------


def has_selection(mode: Column) -> Column:
    return mode.isin("list", "patterns", "interactive")


def is_valid_mode(mode: Column) -> Column:
    return mode.isin(*SELECTION_MODES)


def is_selected(path: Column, profile: Profile) -> Column:
    """The selection mode lets the file in; empty lists and other modes let all in."""
    if profile.selection_mode == "list" and profile.included_paths:
        return globs.under_any(path, profile.included_paths)
    if profile.selection_mode == "patterns" and profile.include_patterns:
        return globs.matches_path(path, profile.include_patterns)
    return F.lit(True)


def rule_count(mode: Column, paths: Column, patterns: Column) -> Column:
    """Length of the list the mode uses, else 0."""
    return (
        F.when(mode == "list", F.coalesce(F.size(paths), F.lit(0)))
        .when(mode == "patterns", F.coalesce(F.size(patterns), F.lit(0)))
        .otherwise(0)
        .cast("bigint")
    )
