"""File headers: the exported symbols and imports of a source file.

Everything is a per-row expression over the file's text, so header extraction
needs no shuffle and no line explosion: import blocks are cut out by one regular
expression, the declarations of what remains by others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\r]"

# ``d`` and ``m``: lines end at newlines only, and ``^`` matches after each of them.
LINE = rf"(?dm)^{BLANK}*"

# From an opening ``import (`` line to the first line that is just ``)``, or to
# the end of the text; or a whole block written on one line.
IMPORT_BLOCK = (
    rf"{LINE}import{BLANK}*\("
    r'(?:(?:[^)\n"`]*(?:"[^"\n]*"|`[^`\n]*`))+[^)\n"`]*\)[^\n]*'
    rf"|[\s\S]*?(?:\n{BLANK}*\){BLANK}*(?=\n|\z)|\z))"
)
SINGLE_IMPORT = rf'{LINE}import{BLANK}+(?:[^\s"`(]+{BLANK}+)?(?:"[^"\n]+"|`[^`\n]+`)'
COMMENT_LINE = rf"{LINE}//[^\n]*"
QUOTED = r'["`]([^"`\n]+)["`]'
FIRST_QUOTED = rf'(?dm)^[^"`\n]*{QUOTED}'

# What a declaration of an exported symbol looks like.
FUNCTION = rf"{LINE}func{BLANK}+([A-Z][^(\n]*)\("
TYPE = rf"{LINE}type{BLANK}+([A-Z][^ =\r\n]*)"
CONSTANT = rf"{LINE}const{BLANK}+([A-Z][^ =\r\n]*)"

# Language labels whose summary names them differently.
SUMMARY_LABELS = {
    "javascript": "JavaScript/TypeScript",
    "typescript": "JavaScript/TypeScript",
    "python": "Python",
    "java": "Java",
}
NOT_IMPLEMENTED = " file - header extraction not yet implemented"

HEADER_TYPE = (
    "struct<functions:array<string>,types:array<string>,constants:array<string>,"
    "dependencies:array<string>,summary:string>"
)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.trim(s))


def imports(content: Column) -> Column:
    """Import paths in order of appearance; aliases dropped."""
    code = F.regexp_replace(content, COMMENT_LINE, "")
    either = rf"{IMPORT_BLOCK}|{SINGLE_IMPORT}"
    statements = F.regexp_extract_all(code, F.lit(either), F.lit(0))
    # In a block the path of a line is its first quoted text; a statement on one
    # line, in parentheses or not, has all its quoted texts as paths.
    def paths(s: Column) -> Column:
        first, every = (F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in (FIRST_QUOTED, QUOTED))
        return F.when(F.trim(s).contains("\n"), first).otherwise(every)

    return F.flatten(F.transform(statements, paths))


def body(content: Column) -> Column:
    """The text without its import blocks."""
    return F.regexp_replace(content, IMPORT_BLOCK, "")


def symbols(content: Column) -> Column:
    """Struct of the four symbol lists of a Go source text."""
    rest = body(content)
    return F.struct(
        _all(rest, FUNCTION).alias("functions"),
        _all(rest, TYPE).alias("types"),
        _all(rest, CONSTANT).alias("constants"),
        imports(content).alias("dependencies"),
    )


def counted_summary(types: Column, functions: Column, constants: Column) -> Column:
    """``Go file with 2 types, 1 functions``, non-zero parts only."""

    def part(n: Column, noun: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {noun}")))

    parts = F.concat_ws(", ", part(types, "types"), part(functions, "functions"), part(constants, "constants"))
    return F.when(parts == "", F.lit("Go source file")).otherwise(F.concat(F.lit("Go file with "), parts))


def stub_summary(lang: Column) -> Column:
    """Summary for languages without an extractor."""
    label = lang
    for name, text in SUMMARY_LABELS.items():
        label = F.when(lang == name, F.lit(text)).otherwise(label)
    return F.concat(label, F.lit(NOT_IMPLEMENTED))


def line_blocks(content: Column) -> Column:
    """Array of ``(line, in_block)`` structs; the flag is true from the line after an opening
    ``import (`` up to and including the closing ``)``.

    The text is cut at the import blocks and glued together again in order, so
    the cost is linear in the text and no state is carried between rows.
    """
    outside = F.split(content, IMPORT_BLOCK)
    blocks = F.regexp_extract_all(content, F.lit(IMPORT_BLOCK), F.lit(0))

    def lines(text: Column, in_block: bool) -> Column:
        return F.transform(
            F.split(text, "\n"),
            lambda line, j: F.struct(line.alias("line"), ((j > 0) & F.lit(in_block)).alias("in_block")),
        )

    def outside_lines(text: Column, i: Column) -> Column:
        # The newline before a block and the one after it are cut points, not lines.
        begin = F.when(i > 0, F.lit(2)).otherwise(F.lit(1))
        drop = begin - 1 + F.when(i < F.size(blocks), F.lit(1)).otherwise(F.lit(0))
        rows = lines(text, False)
        return F.slice(rows, begin, F.greatest(F.size(rows) - drop, F.lit(0)))

    none = F.array().cast("array<struct<line:string,in_block:boolean>>")
    return F.flatten(
        F.transform(
            outside,
            lambda text, i: F.concat(
                outside_lines(text, i), F.coalesce(lines(F.get(blocks, i), True), none)
            ),
        )
    )
