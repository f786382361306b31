"""Language labels derived from file extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.paths import extension

# Extensions of each language label; every other extension is "text".
EXTENSIONS = {
    "javascript": (".js", ".mjs", ".cjs"),
    "jsx": (".jsx",),
    "typescript": (".ts",),
    "tsx": (".tsx",),
    "html": (".html", ".htm"),
    "scss": (".scss", ".sass"),
    "css": (".css",),
    "json": (".json",),
    "yaml": (".yaml", ".yml"),
    "markdown": (".md",),
    "go": (".go",),
    "python": (".py",),
    "java": (".java",),
    "c": (".c",),
    "cpp": (".cpp", ".cc", ".cxx"),
    "csharp": (".cs",),
    "php": (".php",),
    "ruby": (".rb",),
    "rust": (".rs",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "bash": (".sh", ".bash"),
    "xml": (".xml",),
    "sql": (".sql",),
}
DEFAULT_LANGUAGE = "text"

# Extensions whose code fence differs from the language label.
FENCES = {"scss": (".scss", ".sass", ".less"), "html": (".html", ".htm")}


def _lookup(key: Column, table: dict[str, tuple[str, ...]], default: Column) -> Column:
    pairs = [F.lit(x) for label, exts in table.items() for ext in exts for x in (ext, label)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def language(path: Column) -> Column:
    return _lookup(F.lower(extension(path)), EXTENSIONS, F.lit(DEFAULT_LANGUAGE))


def fence_language(path: Column) -> Column:
    """Label after the opening code fence."""
    return _lookup(F.lower(extension(path)), FENCES, language(path))
