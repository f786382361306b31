"""Markdown sections. Each function gives rows whose texts, in order, are the document."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import headers, paths
from corpusloom.functions.languages import fence_language
from corpusloom.plans.ranking import PLACE
from corpusloom.session import ship_package

FULL, HEADERS = "full", "headers"
FENCE = "```"

# What orders the rows of one project's document; a task sorts those that agree in the blocks.
BLOCKS = ("part", "unit", "step", PLACE)
ORDER = (*BLOCKS, "key", "line")


@dataclass(frozen=True)
class Texts:
    """The wording of a document; replace any of it for another language."""

    project: str = "Проект"
    generated: str = "Дата генерации"
    completeness: str = "Полнота"
    completeness_value: str = "Полная структура проекта и исходный код"
    kind: str = "Тип"
    contents: str = "Содержание"
    structure: str = "Структура проекта"
    structure_link: str = "#структура-проекта"
    modules: str = "Основные модули"
    modules_link: str = "#основные-модули"
    modules_intro: str = "В этом разделе представлены ключевые файлы проекта с их исходным кодом:"
    skipped_body: str = "[Содержимое файла пропущено]"
    skipped_note: str = "_Файл был пропущен по настройкам документации._"
    monorepo: str = "Общая структура Nx Monorepo"
    path: str = "Путь"
    root_configs: str = "Корневые конфигурационные файлы"
    root_configs_intro: str = "В этом разделе представлены основные конфигурационные файлы проекта:"
    go_kind: str = "Go проект"
    monorepo_kind: str = "NX Monorepo"
    framework_suffix: str = " проект"


TEXTS = Texts()


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- texts ---------------------------------------------------------------------------


def document_head(project: Column, kind: Column, run_ts: Column, texts: Texts = TEXTS) -> Column:
    """Title, time stamp, completeness, type and contents list."""
    return _join(
        f"# {texts.project}: ", project, f"\n\n**{texts.generated}:** ",
        F.date_format(run_ts, "yyyy-MM-dd HH:mm:ss"),
        f"\n\n**{texts.completeness}:** {texts.completeness_value}\n\n**{texts.kind}:** ", kind,
        f"\n\n## {texts.contents}\n- [{texts.structure}]({texts.structure_link})\n"
        f"- [{texts.modules}]({texts.modules_link})\n",
    )


def tree_open(level: int = 2, texts: Texts = TEXTS) -> str:
    return f"{'#' * level} {texts.structure}\n\n{FENCE}\n"


TREE_CLOSE = f"\n{FENCE}\n\n"


def modules_head(texts: Texts = TEXTS) -> str:
    return f"## {texts.modules}\n\n{texts.modules_intro}\n\n"


def monorepo_open(texts: Texts = TEXTS) -> str:
    return f"## {texts.monorepo}\n\n{FENCE}\n"


MONOREPO_CLOSE = f"{FENCE}\n\n"


def root_configs_head(texts: Texts = TEXTS) -> str:
    return f"\n## {texts.root_configs}\n\n{texts.root_configs_intro}\n\n"


def subproject_head(name: Column, kind: Column, root: Column, texts: Texts = TEXTS) -> Column:
    return _join(f"\n## {texts.project}: ", name, " (", kind, f")\n\n**{texts.path}:** ", root, "\n\n")


def file_title(path: Column) -> Column:
    return _join("### ", path, "\n\n")


def full_body(path: Column, content: Column) -> Column:
    """Fenced content; a missing final newline is added, an empty file stays empty."""
    ending = F.when((content == "") | content.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    return _join(FENCE, fence_language(path), "\n", content, ending, f"{FENCE}\n\n")


def skipped_body(texts: Texts = TEXTS) -> str:
    return f"{FENCE}\n{texts.skipped_body}\n{FENCE}\n\n{texts.skipped_note}\n\n"


def headers_body(path: Column, lang: Column, header: Column) -> Column:
    """Type, summary, for Go also the symbols and imports, and a tag naming the file."""

    def listing(title: str, items: Column) -> Column:
        block = _join(f"**{title}:**\n{FENCE}go\n", F.array_join(items, "\n"), f"\n{FENCE}\n\n")
        return F.when((lang == "go") & (F.size(items) > 0), block).otherwise(F.lit(""))

    imports = header["dependencies"]
    dependencies = _join(
        "**Dependencies:**\n", F.array_join(F.transform(imports, lambda d: _join("- `", d, "`\n")), ""), "\n"
    )
    return _join(
        "**File Type:** ", F.upper(lang), "\n\n**Summary:** ", header["summary"], "\n\n",
        listing("Exported Functions", header["functions"]),
        listing("Exported Types", header["types"]),
        F.when((lang == "go") & (F.size(imports) > 0), dependencies).otherwise(F.lit("")),
        "_To view full file content, use the tag: `[FILE:", path, "]`_\n\n",
    )


def with_header(files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds ``header``, the header struct of a row with ``lang, content``.

    The symbols are a column of their own, so that each regular expression runs
    once per file however often the header is read; rows that are no Go source
    (or not ``wanted``) hand it no text.
    """
    lang = F.col("lang")
    is_go = (lang == "go") if wanted is None else (lang == "go") & wanted
    found = files.withColumn("__symbols", headers.symbols(F.when(is_go, F.col("content"))))

    def listing(name: str) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.col(f"__symbols.{name}"), none).alias(name)

    counted = headers.counted_summary(
        F.size("__symbols.types"), F.size("__symbols.functions"), F.size("__symbols.constants")
    )
    summary = F.when(lang == "go", counted).otherwise(headers.stub_summary(lang))
    names = ("functions", "types", "constants", "dependencies")
    header = F.struct(*[listing(name) for name in names], summary.alias("summary"))
    return found.withColumn("header", header).drop("__symbols")


def with_section(files: DataFrame, mode: str | Column, texts: Texts = TEXTS) -> DataFrame:
    """Adds ``markdown``, the section of a row with ``path, lang, content, skipped``.

    Headers are only extracted where the mode asks for them.
    """
    path, lang = F.col("path"), F.col("lang")
    full = full_body(path, F.col("content"))
    if isinstance(mode, str) and mode != HEADERS:
        rows, shown = files, full
    else:
        short_mode = F.lit(True) if isinstance(mode, str) else mode == HEADERS
        rows = with_header(files, short_mode & ~F.col("skipped"))
        short = headers_body(path, lang, F.col("header"))
        shown = F.when(short_mode, short).otherwise(full)
    section = F.when(F.col("skipped"), F.lit(skipped_body(texts))).otherwise(shown)
    return rows.select(*files.columns, _join(file_title(path), section).alias("markdown"))


# --- rows ----------------------------------------------------------------------------


def fragments(
    df: DataFrame,
    markdown: Column | str,
    part: int,
    unit: Column | int = 0,
    step: int = 0,
    key: Column | str = "",
    line: Column | int = 0,
) -> DataFrame:
    """One text row per input row, with the columns that place it in the document.

    A ``place`` column of the input, the range that the row's key lies in, is kept.
    """

    def column(value: Column | str | int, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return df.select(
        "project",
        F.lit(part).alias("part"),
        column(unit, "bigint").alias("unit"),
        F.lit(step).alias("step"),
        F.col(PLACE) if PLACE in df.columns else F.lit(0).alias(PLACE),
        column(key, "string").alias("key"),
        column(line, "bigint").alias("line"),
        column(markdown, "string").alias("markdown"),
    )


def file_fragments(
    files: DataFrame,
    mode: str | Column,
    part: int,
    unit: Column | int = 0,
    step: int = 0,
    key: Column | None = None,
    texts: Texts = TEXTS,
) -> DataFrame:
    """The sections of files, in tree order unless another ``key`` is given."""
    place = paths.tree_key(F.col("path"), F.lit(False)) if key is None else key
    return fragments(with_section(files, mode, texts), F.col("markdown"), part, unit, step, place)


def custom_fragments(
    files: DataFrame, section: Callable[[str, str | None], Iterable[str]], part: int, unit: Column | int = 0, step: int = 0
) -> DataFrame:
    """Sections of one's own: ``section(path, content)`` gives the texts of a file, in order.

    It runs as a table function on the executors, once per file, so it must be
    importable there or have no module of its own; texts end in a newline. Add the
    result to a job's fragments by ``unionByName``: part, unit and step place it,
    and files follow in tree order.
    """

    class Section:
        def eval(self, path: str, content: str | None) -> Iterator[tuple[int, str]]:
            yield from enumerate(section(path, content))

    ship_package(files.sparkSession)
    texts = F.udtf(Section, returnType="line: bigint, markdown: string")
    rows = files.lateralJoin(texts(F.col("path").outer(), F.col("content").outer()))
    return fragments(rows, F.col("markdown"), part, unit, step, paths.tree_key(F.col("path"), F.lit(False)), F.col("line"))


def output_name(filename: Column, append_timestamp: Column, run_ts: Column) -> Column:
    """Name of the document: a stamp before the extension if asked for, a stamped default if unnamed."""
    stamp = F.date_format(run_ts, "yyyyMMdd_HHmmss")
    ext = paths.extension(filename)
    base = F.substring(filename, F.lit(1), F.length(filename) - F.length(ext))
    return (
        F.when(filename == "", _join("project_docs_", stamp, ".md"))
        .when(append_timestamp, _join(base, "_", stamp, ext))
        .otherwise(filename)
    )
