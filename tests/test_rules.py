"""Decision tables of the file rules."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, rules
from corpusloom.functions.languages import fence_language, language
from corpusloom.functions.rules import Profile
from corpusloom.operators import scan
from tests.helpers import files, flags
from tests.helpers import paths as paths_of

BARE = Profile(excluded_patterns=(), output_filename="", include_docs=True)


def test_language(spark):
    want = {
        "cmd/serve.GO": "go",
        "old/jquery.min.js": "javascript",
        "ui/Row.jsx": "jsx",
        "ui/Row.tsx": "tsx",
        "lib.d.ts": "typescript",
        "site/print.css": "css",
        "site/print.sass": "scss",
        "about.htm": "html",
        "deploy.yml": "yaml",
        "queries/top.sql": "sql",
        "Notes.MD": "markdown",
        "Makefile": "text",
        "A.MJS": "javascript",
        "x.less": "text",
        "x.h": "text",
        "src.d/x": "text",
        "x.bash": "bash",
    }
    assert flags(spark, want, language) == want


def test_fence_language(spark):
    want = {"a.less": "scss", "a.SASS": "scss", "a.htm": "html", "a.ts": "typescript", "a": "text"}
    assert flags(spark, want, fence_language) == want


def test_path_parts(spark):
    want = {".env": ".env", "a.": ".", "Makefile": "", "src.d/x": "", "a/b.tar.gz": ".gz"}
    assert flags(spark, want, paths.extension) == want
    assert flags(spark, ["a/b/c", "a"], paths.parent) == {"a/b/c": "a/b", "a": ""}
    assert flags(spark, ["a/b/c", "a"], paths.depth) == {"a/b/c": 3, "a": 1}
    assert flags(spark, ["a/b/c", "a", ""], lambda c: paths.prefixes(c, False)) == {"a/b/c": ["a", "a/b"], "a": [], "": []}
    assert flags(spark, ["a/b", ""], lambda c: paths.prefixes(c, True)) == {"a/b": ["a", "a/b"], "": []}
    assert flags(spark, [" a , b\t,"], paths.split_list) == {" a , b\t,": ["a", "b", ""]}


@pytest.mark.parametrize(
    ("name", "profile", "want"),
    [
        ("corpusloom_config.yaml", BARE, True),
        ("my_CORPUSLOOM_CONFIG.bak", BARE, True),
        ("go.sum", BARE, True),
        ("output.md", replace(BARE, output_filename="out/output.md"), True),
        ("project_docs_2023.md", replace(BARE, output_filename="project_docs.md"), True),
        ("project_docs_2023.txt", replace(BARE, output_filename="project_docs.md"), False),
        ("package-lock.json", BARE, True),
        ("package-lock.json", replace(BARE, important_files=("package-lock.json",)), False),
        ("corpusloom_config.yaml", replace(BARE, important_files=("corpusloom_config.yaml",)), True),
        ("output.md", replace(BARE, output_filename="output.md", important_files=("output.md",)), True),
        ("~$temp.docx", BARE, True),
        ("important.config", replace(BARE, important_files=("important.config",)), False),
        ("normal.txt", BARE, False),
    ],
)
def test_own_artifacts(spark, name, profile, want):
    assert flags(spark, [name], lambda c: rules.is_own_artifact(c, profile)) == {name: want}


def test_pruned_directories(spark):
    want = {
        ".git": True,
        "node_modules": True,
        "dist": True,
        "__pycache__": True,
        "excluded_dir": True,
        "src": False,
        "app": False,
        "a/vendor/b": True,
        "a/build": True,
        "builder": False,
        "vendors": False,
        "x/corpusloom_config_d": True,
        ".pytest_cache": True,
        "target": True,
    }
    profile = replace(BARE, excluded_patterns=("excluded_*",))
    assert flags(spark, want, lambda c: rules.is_pruned(c, profile)) == want


def test_excludes_with_slashes_apply_to_whole_paths(spark):
    profile = replace(BARE, excluded_patterns=("lib/**", "docs/*.md", "**/gen/*.go"), important_files=("keep.go",))
    want = {
        "lib/a.go": True,
        "lib/x/a.go": True,
        "lib/keep.go": True,  # its directory is excluded
        "libs/a.go": False,
        "docs/a.md": True,
        "docs/x/a.md": False,
        "src/gen/a.go": True,
        "src/gen/keep.go": False,
        "src/gen/sub/a.go": False,
    }
    assert flags(spark, want, lambda c: rules.is_excluded(c, profile)) == want


def test_important_names_escape_excludes(spark):
    profile = replace(BARE, excluded_patterns=("*.json", "tmp"), important_files=("package.json", "dist"))
    want = {
        "package.json": False,
        "a/package.json": False,
        "tmp/package.json": True,  # pruned with its directory
        "dist/a.go": False,  # a listed directory is entered
        "other.json": True,
        "my-package.json": True,
    }
    assert flags(spark, want, lambda c: rules.is_excluded(c, profile)) == want


@pytest.mark.parametrize(
    ("path", "profile", "want"),
    [
        ("styles.css", replace(BARE, include_styles=False), True),
        ("styles.scss", replace(BARE, include_styles=False), True),
        ("styles.LESS", replace(BARE, include_styles=False), True),
        ("index.html", replace(BARE, include_markup=False), True),
        ("config.json", replace(BARE, include_configs=False), True),
        ("webpack.Config.js", replace(BARE, include_configs=False), True),
        ("app.spec.js", BARE, True),
        ("app.test.json", replace(BARE, include_tests=True, include_configs=False), True),
        ("app_test.go", BARE, False),
        ("a.markdown", replace(BARE, include_docs=False), True),
        ("important.config", replace(BARE, include_configs=False, important_files=("important.config",)), False),
        ("very-important.config", replace(BARE, include_configs=False, important_files=("important.config",)), False),
        ("app.js", BARE, False),
    ],
)
def test_toggles(spark, path, profile, want):
    assert flags(spark, [path], lambda c: rules.is_type_skipped(c, profile)) == {path: want}


def test_names_in_the_tree(spark):
    profile = Profile(
        excluded_patterns=("*.log", "temp_*"),
        important_files=("important.config",),
        include_configs=False,
        include_tests=False,
    )
    listed = {
        "project_structure.txt": False,
        "app.js": True,
        ".hidden_file": True,
        "project_docs.md": False,
        "error.log": False,
        "temp_file.txt": False,
        "important.config": True,
        "config.yml": False,
        "test.spec.js": False,
        "~$x.docx": True,
    }
    got = paths_of(scan.listed(files(spark, *listed), profile))
    assert got == {name for name, stays in listed.items() if stays}
    dirs = {".git": True, "node_modules": True, "dist": True, "src": False, ".hidden": False, "config.yml": False}
    assert flags(spark, dirs, lambda c: rules.is_pruned(c, profile)) == dirs


def test_size_limit_is_strict(spark):
    profile = replace(BARE, max_file_size=1024)
    rows = scan.classify(files(spark, ("a", "x" * 1024), ("b", "x" * 1025), ("c", None), ("d", "")), profile)
    got = {r["path"]: (r["skipped"], r["content"] is None) for r in rows.collect()}
    assert got == {"a": (False, False), "b": (True, True), "c": (True, True), "d": (False, False)}


def test_stub_and_remove(spark):
    data = files(spark, ("a.go", "x"), ("a.spec.js", "y"), ("b.log", "z"))
    stub = {r["path"]: r["skipped"] for r in scan.classify(data, BARE).collect()}
    assert stub == {"a.go": False, "a.spec.js": True}
    removed = {r["path"]: r["skipped"] for r in scan.classify(data, BARE, "remove").collect()}
    assert removed == {"a.go": False}
    with pytest.raises(ValueError):
        scan.classify(data, BARE, "maybe")


def test_depth_limit(spark):
    shallow, deep = "/".join(["d"] * 20 + ["f"]), "/".join(["d"] * 21 + ["f"])
    assert flags(spark, [shallow, deep], lambda p: rules.within_depth(p, 20)) == {shallow: True, deep: False}
    assert flags(spark, [shallow, deep], lambda p: rules.is_listed(p, BARE)) == {shallow: True, deep: True}


def test_empty_config_stem_marks_nothing(spark):
    profile = replace(BARE, config_stem="")
    assert paths_of(scan.listed(files(spark, "a.go", "corpusloom_config.yml"), profile)) == {"a.go", "corpusloom_config.yml"}


def test_effective_excludes_have_no_duplicates():
    profile = Profile(excluded_patterns=("*.log", "mine", "dist"))
    merged = rules.effective_excludes(profile)
    assert merged[:4] == ["*.log", "mine", "dist", "project_docs*.md"]
    assert len(merged) == len(set(merged)) and merged[-1] == "*.md"
    assert "*.md" not in rules.effective_excludes(replace(profile, include_docs=True))


@pytest.mark.parametrize(
    ("mode", "want"), [("all", False), ("list", True), ("patterns", True), ("interactive", True), ("", False), ("unknown", False)]
)
def test_modes_that_select(spark, mode, want):
    assert spark.range(1).select(rules.has_selection(F.lit(mode)).alias("m")).first()["m"] is want
