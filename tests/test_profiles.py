"""Profile defaults, suggestions, and decisions by profile table."""

from __future__ import annotations


from corpusloom.functions.rules import Profile
from corpusloom.operators import profiles, scan
from corpusloom.schemas import PROFILES
from tests.helpers import files

# What a profile with nothing set resolves to.
DEFAULTS = {
    "max_file_size": 2 * 1024 * 1024,
    "include_tests": False,
    "include_configs": True,
    "include_markup": True,
    "include_styles": True,
    "include_docs": False,
    "excluded_patterns": [".gitignore", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.bak"],
    "documentation_mode": "full",
    "selection_mode": "all",
    "included_paths": [],
    "include_patterns": [],
    "important_files": [],
    "show_full_structure": False,
    "output_format": "markdown",
    "output_filename": "project_docs.md",
    "append_timestamp": True,
}


def resolved(spark, **fields):
    row = {f.name: fields.get(f.name) for f in PROFILES.fields} | {"project": "p"}
    projects = spark.createDataFrame([("p",), ("absent",)], "project string")
    table = profiles.resolve(projects, spark.createDataFrame([row], PROFILES))
    got = {r["project"]: r.asDict() for r in table.collect()}
    assert {k: v for k, v in got["absent"].items() if k != "project"} == DEFAULTS
    return {k: v for k, v in got["p"].items() if k != "project"}


def test_nothing_set(spark):
    assert resolved(spark) == DEFAULTS


def test_zero_and_empty_values(spark):
    got = resolved(
        spark, max_file_size=0, documentation_mode="", selection_mode="", output_format="", output_filename="",
        excluded_patterns=[], included_paths=[], include_patterns=[], important_files=[],
    )
    assert got == DEFAULTS


def test_everything_set(spark):
    values = {
        "max_file_size": 1024,
        "include_tests": True,
        "include_configs": False,
        "include_markup": False,
        "include_styles": False,
        "include_docs": True,
        "excluded_patterns": ["x"],
        "documentation_mode": "headers",
        "selection_mode": "list",
        "included_paths": ["a"],
        "include_patterns": ["b"],
        "important_files": ["c"],
        "show_full_structure": True,
        "output_format": "html",
        "output_filename": "o.md",
        "append_timestamp": False,
    }
    assert resolved(spark, **values) == values


def test_explicit_false_is_kept(spark):
    got = resolved(spark, include_configs=False, append_timestamp=False)
    assert got == DEFAULTS | {"include_configs": False, "append_timestamp": False}


def test_suggestions(spark):
    types = ["Go", "go", "Angular", "angular", "browser-extension", "React", "NX", "js", "JavaScript", "unknown"]
    rows = profiles.suggest(spark.createDataFrame([(t, t) for t in types], "project string, type string")).collect()
    got = {r["type"]: (r["include_markup"], r["include_styles"], r["excluded_patterns"][6:]) for r in rows}
    go = (False, False, ["vendor/**", "*.exe", "*.dll", "*.so", "*.dylib"])
    front = (True, True, ["dist/**", "build/**", ".angular/**", ".nx/**", "coverage/**"])
    assert got["Go"] == got["go"] == go
    assert all(got[t] == front for t in types[2:9])
    assert got["unknown"] == (True, True, ["*.log", "*.tmp", "*.bak"])


def test_table_decides_like_literals(spark):
    names = [
        "a.go", "b.css", "c.html", "d.json", "e.spec.ts", "f.md", "g.log", "vendor/h.go", "src/i.exe", "~$j.txt",
        "project_docs_1.md", "k.config.js", "go.sum", "node_modules/l.js", "src/important.config", "big.txt",
    ]
    data = files(spark, *[(n, "x" * (50 if n == "big.txt" else 5)) for n in names])
    variants = [
        Profile(),
        Profile(include_docs=True, include_tests=True, max_file_size=20),
        Profile(include_styles=False, include_markup=False, include_configs=False, important_files=("important.config", "go.sum")),
        Profile(excluded_patterns=("vendor/**", "*.exe", "src/*.config"), output_filename="big.txt"),
        Profile(selection_mode="patterns", include_patterns=("src/**", "*.css")),
    ]
    for profile in variants:
        row = {f.name: getattr(profile, f.name, None) for f in PROFILES.fields} | {"project": "p"}
        row = {k: list(v) if isinstance(v, tuple) else v for k, v in row.items()}
        table = spark.createDataFrame([row], PROFILES)
        want = {(r["path"], r["lang"], r["skipped"]) for r in scan.classify(data, profile).collect()}
        got = {(r["path"], r["lang"], r["skipped"]) for r in profiles.decide(data, table).collect()}
        assert got == want


def test_decisions_do_not_move_content(spark, tmp_path):
    files(spark, ("a.go", "x")).write.parquet(str(tmp_path / "f"))
    data = spark.read.parquet(str(tmp_path / "f"))
    table = profiles.resolve(data.select("project").distinct(), spark.createDataFrame([], PROFILES))
    plan = profiles.decide(data, table)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Join" in line:
            assert "content" not in line
