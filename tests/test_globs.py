"""Glob translation, checked through Spark's own regex engine."""

from __future__ import annotations

import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import globs

PATHS = [
    ("lib/**/*.rb", "lib/io.rb", True),
    ("lib/**/*.rb", "lib/net/http/get.rb", True),
    ("lib/**/*.rb", "bin/lib/io.rb", False),
    ("**/notes", "notes", True),
    ("**/notes", "2021/may/notes", True),
    ("**/notes", "2021/may/notes.old", False),
    ("q?/*.csv", "q1/sales.csv", True),
    ("q?/*.csv", "q1/north/sales.csv", False),
    ("[ab]/**/z", "b/x/y/z", True),
    ("[ab]/**/z", "c/z", False),
    ("*", "top", True),
    ("*", "top/below", False),
    ("**/gen/**", "a/gen/b/c", True),
    ("**/gen/**", "a/general/b", False),
    ("a[*]b.md", "a*b.md", True),
    ("a[*]b.md", "axb.md", False),
    ("**", "any/thing", True),
    ("**/**/x", "x", True),
    ("src/**", "src", True),
    ("src/**", "srcs/x", False),
    ("a/**/**/b", "a/c/d/b", True),
    ("src\\*.go", "src/main.go", True),
]

NAMES = [
    ("*", "", True),
    ("*.log", ".log", True),
    ("*.log", "a.log.txt", False),
    ("a?c", "abc", True),
    ("a?c", "ac", False),
    ("[a-c]x", "bx", True),
    ("[a-c]x", "dx", False),
    ("[^a-c]x", "dx", True),
    ("[^a-c]x", "ax", False),
    ("[!a]", "a", True),
    ("[!a]", "b", False),
    ("[a\\]]", "]", True),
    ("\\*", "*", True),
    ("\\*", "x", False),
    ("a+b.(c)", "a+b.(c)", True),
    ("a.b", "axb", False),
    ("{a,b}", "a", False),
    ("{a,b}", "{a,b}", True),
    ("$x^", "$x^", True),
    ("[z-a]", "m", False),
    ("[]a]", "a", False),
    ("[a-]", "a", False),
    ("[-a]", "a", False),
    ("[a", "a", False),
    ("[^]", "a", False),
    ("x\\", "x", False),
    ("é*", "écran", True),
    ("?", "é", True),
    ("?", "\n", True),
    ("x", "x\n", False),
]


def evaluate(spark, cases, build):
    df = None
    rows = [(p, t, build([p])) for p, t, _ in cases]
    df = spark.createDataFrame(rows, "p string, t string, re string")
    return {(r["p"], r["t"]): r["m"] for r in df.select("p", "t", F.expr("rlike(t, re)").alias("m")).collect()}


def test_paths(spark):
    got = evaluate(spark, PATHS, globs.paths_regex)
    assert got == {(p, t): want for p, t, want in PATHS}


def test_names(spark):
    got = evaluate(spark, NAMES, globs.names_regex)
    assert got == {(p, t): want for p, t, want in NAMES}


def test_several_patterns_and_none(spark):
    df = spark.createDataFrame([("a.go",), ("b.md",), ("c.txt",)], "n string")
    assert df.filter(globs.matches_name(F.col("n"), ["*.go", "*.md", "[bad"])).count() == 2
    assert df.filter(globs.matches_name(F.col("n"), [])).count() == 0
    assert df.filter(globs.under_any(F.col("n"), ["a.go/", "b"])).count() == 1


def test_pattern_table_agrees_with_literals(spark):
    rows = spark.createDataFrame([(["src/*.go", "**/x"],), ([],), (None,)], "ps array<string>")
    got = [r["re"] for r in rows.select(globs.regex_column(F.col("ps"), "paths").alias("re")).collect()]
    assert got == [globs.paths_regex(["src/*.go", "**/x"]), globs.NEVER, globs.NEVER]


@settings(max_examples=20, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.text(alphabet="ab*?.", min_size=1, max_size=6), st.text(alphabet="ab.x", min_size=0, max_size=6)
        ),
        min_size=1,
        max_size=30,
    )
)
def test_plain_globs_agree_with_shell_rules(spark, cases):
    df = spark.createDataFrame([(p, t, globs.names_regex([p])) for p, t in cases], "p string, t string, re string")
    for row in df.select("p", "t", F.expr("rlike(t, re)").alias("m")).collect():
        assert row["m"] == fnmatch.fnmatchcase(row["t"], row["p"]), (row["p"], row["t"])


@pytest.mark.parametrize("text", ["a.b", "x+y", "(", "[", "\\", "a|b", "^$", "{}"])
def test_quoted_text_matches_itself_only(spark, text):
    df = spark.createDataFrame([(text,), (text + "x",), ("x" + text,)], "t string")
    assert df.filter(F.col("t").rlike(globs.any_of([globs.quote(text)]))).count() == 1
