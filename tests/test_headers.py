"""Header extraction from Go sources, against a line-by-line model."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import headers
from corpusloom.functions.languages import language
from corpusloom.operators import render
from tests.helpers import files


def model(text):
    """The intended rules, one line at a time."""
    out = {"functions": [], "types": [], "constants": [], "dependencies": []}
    flags, inside = [], False
    for line in text.split("\n"):
        flags.append(inside)
        t = line.strip(" \t\r")
        if inside and t == ")":
            inside = False
            continue
        if t == "" or t.startswith("//"):
            continue
        if inside:
            found = re.search(r'"([^"\n]+)"', t)
            if found:
                out["dependencies"].append(found.group(1))
            continue
        if re.match(r"import[ \t\r]*\(", t):
            inside = True
            continue
        found = re.match(r'import[ \t\r]+(?:[^\s"(]+[ \t\r]+)?"([^"\n]+)"', t)
        if found:
            out["dependencies"].append(found.group(1))
        for kind, pattern in (
            ("functions", r"func[ \t\r]+([A-Z][^(\n]*)\("),
            ("types", r"type[ \t\r]+([A-Z][^ =\r\n]*)"),
            ("constants", r"const[ \t\r]+([A-Z][^ =\r\n]*)"),
        ):
            found = re.match(pattern, t)
            if found:
                out[kind].append(found.group(1).strip(" "))
    return out, flags


def extract(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    rows = df.select(
        "i", headers.symbols(F.col("content")).alias("s"), headers.line_blocks(F.col("content")).alias("l")
    ).orderBy("i").collect()
    return [
        (
            {k: list(r["s"][k]) for k in ("functions", "types", "constants", "dependencies")},
            [x["in_block"] for x in r["l"]],
            "\n".join(x["line"] for x in r["l"]),
        )
        for r in rows
    ]


CASES = [
    "",
    "package p",
    'package p\nimport (\n\t"fmt"\n\tal "x/y"\n\t_ "z" // "not this"\n)\n',
    'import "fmt"\nfunc Next() {}\n',
    'import al "fmt"\ntype T struct{}\n',
    "importer := 1\nfunc Shown() {}\n",
    "// import (\nfunc A() {}\n// func B() {}\n",
    "func (r T) Method() {}\nfunc hidden() {}\nfunc Open(a int) {}\nfunc\ntype\nconst\n",
    "type (\n\tGrouped int\n)\ntype Alias=int\ntype Set[T any] struct{}\ntype lower int\n",
    "const Max = 1\nconst min = 2\nconst (\n\tInner = 3\n)\nconst Typed int = 4\n",
    'import (\n\t"a"\nfunc Hidden() {}\n',
    'import (\n\t"a"\n)\nfunc A() {}\nimport (\n\t"b"\n)\nfunc B() {}',
    'import (\n\t// "commented"\n\n\t"real"\n)',
    "\tfunc Indented() {}\r\ntype Dos struct {\r\nconst Carriage\r\n",
    'import (\r\n\t"fmt"\r\n)\r\nfunc Dos() {}\r\n',
    "func Map[K comparable, V any](m map[K]V) {}\nfunc NoParen\n",
    "x func NotALine() {}\n",
    "import (\n)\nimport (\n)\n\n",
    "a\n" * 3,
]


def test_cases(spark):
    for text, (symbols, flags, glued) in zip(CASES, extract(spark, CASES)):
        want, want_flags = model(text)
        assert symbols == want, text
        assert flags == want_flags, text
        assert glued == text


def test_block_on_one_line(spark):
    (symbols, *_), = extract(spark, ['import ("a")\nfunc F() {}\n'])
    assert symbols["dependencies"] == ["a"] and symbols["functions"] == ["F"]


LINES = st.sampled_from(
    ["import (", ")", '\t"fmt"', '\tal "x"', 'import "one"', "func F() {}", "type T int", "const C = 1", "", "// import (",
     " ) ", "func f()", "import", "x"]
)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(LINES, max_size=12).map("\n".join), min_size=1, max_size=25))
def test_any_mix_of_lines(spark, texts):
    for text, (symbols, flags, glued) in zip(texts, extract(spark, texts)):
        want, want_flags = model(text)
        assert (symbols, flags, glued) == (want, want_flags, text), text


def test_long_lines_are_read_whole(spark):
    text = "// " + "x" * 200_000 + "\nfunc After() {}\n" + "y" * 200_000 + "\ntype Last int"
    (symbols, *_), = extract(spark, [text])
    assert symbols["functions"] == ["After"] and symbols["types"] == ["Last"]


@pytest.mark.parametrize(
    ("path", "content", "summary"),
    [
        ("a.go", "type T int\nfunc F() {}\nfunc G() {}\nconst C = 1", "Go file with 1 types, 2 functions, 1 constants"),
        ("a.go", "func F() {}", "Go file with 1 functions"),
        ("a.go", "package p", "Go source file"),
        ("a.js", "x", "JavaScript/TypeScript file - header extraction not yet implemented"),
        ("a.ts", "x", "JavaScript/TypeScript file - header extraction not yet implemented"),
        ("a.py", "x", "Python file - header extraction not yet implemented"),
        ("a.java", "x", "Java file - header extraction not yet implemented"),
        ("a.tsx", "x", "tsx file - header extraction not yet implemented"),
        ("Makefile", "x", "text file - header extraction not yet implemented"),
    ],
)
def test_summaries(spark, path, content, summary):
    rows = render.with_header(files(spark, (path, content)).withColumn("lang", language(F.col("path"))))
    assert rows.first()["header"]["summary"] == summary


def test_extraction_needs_no_shuffle(spark):
    data = files(spark, ("a.go", "func F() {}")).withColumns({"lang": F.lit("go"), "skipped": F.lit(False)})
    plan = render.with_section(data, render.HEADERS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_imports_on_one_line_and_in_backquotes(spark):
    cases = {
        'import ("a"; "b/c")\nfunc F() {}': ["a", "b/c"],
        "import `raw/path`\n": ["raw/path"],
        "import (\n\tx `q/r` // \"no\"\n\t\"s\"\n)\n": ["q/r", "s"],
        'import m "one/two"\nvar s = "three"\n': ["one/two"],
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = {r["c"]: r["i"] for r in df.select("c", headers.imports(F.col("c")).alias("i")).collect()}
    assert got == cases
