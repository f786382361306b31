"""Project detection and monorepo discovery."""

from __future__ import annotations

import pytest

from corpusloom.functions.rules import Profile
from corpusloom.operators import detect, monorepo
from corpusloom.plans.ranking import path_index
from tests.helpers import files

CASES = {
    "conflict": (["go.mod", "package.json", "nx.json"], "", "conflict"),
    "nx by file": (["apps/a/x", "nx.json"], "nx", "ok"),
    "nx by workspace": (["workspace.json"], "nx", "ok"),
    "nx by dirs": (["apps/a/x", "libs/b/x"], "nx", "ok"),
    "one dir is no nx": (["apps/a/x", "libs"], "unknown", "unsupported"),
    "go": (["go.mod", "main.go"], "go", "ok"),
    "go by file": (["main.go"], "go", "ok"),
    "go below root": (["cmd/main.go"], "unknown", "unsupported"),
    "js": (["package.json", "index.js"], "js", "ok"),
    "js by file": (["INDEX.MJS"], "js", "ok"),
    "js by dir": (["lib/readme.txt"], "js", "ok"),
    "angular": (["angular.json", "src/main.ts"], "angular", "ok"),
    "angular by html": (["src/index.html", "src/main.ts"], "angular", "ok"),
    "angular by dependency": ([("package.json", '{"dependencies": {"@angular/core": "1"}}')], "angular", "ok"),
    "angular below angular": (["angular.json"], "unknown", "unsupported"),
    "extension": (["manifest.json", "background.js", "popup.html"], "browser-extension", "ok"),
    "two of extension": (["manifest.json", "popup.html"], "unknown", "unsupported"),
    "extension before angular": (
        ["manifest.json", "background.js", "service-worker.js", "angular.json", "src/main.ts"],
        "browser-extension",
        "ok",
    ),
    "nothing": (["docs/a.md"], "unknown", "unsupported"),
    "realistic go": (["go.mod", "main.go", "internal/service/service.go"], "go", "ok"),
    "realistic react": ([("package.json", '{"dependencies": {"react": "^18"}}'), "src/App.tsx"], "js", "ok"),
}

FRAMEWORKS = {
    "react": ([("package.json", '{"dependencies": {"react": "^18.0.0"}}')], "React"),
    "react by files": (["src/App.jsx", "src/index.js"], "React"),
    "vue": (["src/App.vue", ("package.json", '{"dependencies": {"vue": "^3.0.0"}}')], "Vue"),
    "vue by files": (["vue.config.js", "src/main.js"], "Vue"),
    "svelte": (["svelte.config.js", ("package.json", '{"svelte": 1}')], "Svelte"),
    "svelte by files": (["svelte.config.js", "src/App.svelte"], "Svelte"),
    "angular": (["angular.json", "src/main.ts", ("package.json", '{"react": 1}')], "Angular"),
    "plain": (["index.js", ("package.json", '{"reactor": 1}')], "JavaScript"),
    "nested manifest": ([("web/package.json", '{"react": 1}')], "JavaScript"),
}


def build(spark, cases):
    entries = []
    for project, (items, *_) in cases.items():
        for item in items:
            path, content = item if isinstance(item, tuple) else (item, "")
            entries.append((project, path, content))
    return files(spark, *entries)


def test_types(spark):
    got = {r["project"]: (r["type"], r["status"]) for r in detect.project_types(build(spark, CASES)).collect()}
    assert got == {name: (kind, status) for name, (_, kind, status) in CASES.items()}


def test_conflicts(spark):
    assert [r["project"] for r in detect.conflicts(build(spark, CASES)).collect()] == ["conflict"]


def test_frameworks(spark):
    got = {r["project"]: r["framework"] for r in detect.frameworks(build(spark, FRAMEWORKS)).collect()}
    assert got == {name: label for name, (_, label) in FRAMEWORKS.items()}


REPO = [
    ("nx.json", "{}"),
    ("package.json", "{}"),
    ("notes.tmp", ""),
    ("go.sum", ""),
    ("apps/app1/project.json", "{}"),
    ("apps/app1/inner/project.json", "{}"),
    ("apps/app1/src/a.ts", "a"),
    ("apps/group/app2/project.json", "{}"),
    ("libs/lib1/project.json", "{}"),
    ("libs/lib1x/b.ts", "b"),
    ("tools/tool1/project.json", "{}"),
    ("other/o/project.json", "{}"),
    ("project.json", "{}"),
]


def test_subprojects_in_listing_order(spark):
    subs = monorepo.listed(monorepo.subprojects(files(spark, *REPO)))
    got = [(r["idx"], r["name"], r["type"], r["root"]) for r in subs.orderBy("idx").collect()]
    assert got == [
        (1, "app1", "apps", "apps/app1"),
        (2, "app2", "apps", "apps/group/app2"),
        (3, "lib1", "libs", "libs/lib1"),
        (4, "tool1", "tools", "tools/tool1"),
    ]


def test_marker_at_the_top_folder_hides_the_rest(spark):
    subs = monorepo.subprojects(files(spark, "apps/project.json", "apps/a/project.json"))
    assert [(r["name"], r["root"]) for r in subs.collect()] == [("apps", "apps")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("all", ["p1", "p2", "p3"]),
        (" ALL ", ["p1", "p2", "p3"]),
        ("", ["p1", "p2", "p3"]),
        ("1,3", ["p1", "p3"]),
        ("3, 1 ,3", ["p3", "p1", "p3"]),
        ("2", ["p2"]),
        ("invalid", []),
        ("0,-1,4,1.0,+2,", ["p2"]),
    ],
)
def test_pick(spark, text, want):
    subs = spark.createDataFrame(
        [("p", "p1", "apps", "apps/p1"), ("p", "p2", "apps", "apps/p2"), ("p", "p3", "libs", "libs/p3")],
        "project string, name string, type string, root string",
    )
    choices = spark.createDataFrame([("p", text)], "project string, input string")
    picked = monorepo.pick(monorepo.listed(subs), choices)
    assert [r["name"] for r in picked.orderBy("pick").collect()] == want


def test_root_files(spark):
    profile = Profile(excluded_patterns=("*.tmp",), output_filename="output.md")
    got = {r["path"] for r in monorepo.root_files(files(spark, *REPO), profile).collect()}
    assert got == {"nx.json", "package.json", "project.json"}
    profile = Profile(excluded_patterns=("*.tmp",), important_files=("notes.tmp", "go.sum"))
    got = {r["path"] for r in monorepo.root_files(files(spark, *REPO), profile).collect()}
    assert got == {"nx.json", "package.json", "project.json", "notes.tmp", "go.sum"}


def test_important_root_files(spark):
    data = files(spark, ("nx.json", "{}"), ("package.json", "x" * 50), ("a/nx.json", "{}"))
    rows = monorepo.important_root_files(data, ["package.json", "none", "nx.json"], Profile(max_file_size=10))
    got = [(r["pos"], r["path"], r["skipped"]) for r in rows.orderBy("pos").collect()]
    assert got == [(1, "package.json", True), (3, "nx.json", False)]
    assert monorepo.important_root_files(data, [], Profile()).isEmpty()


@pytest.mark.parametrize("ranges", [1, 4, 30])
def test_files_belong_to_their_subproject(spark, ranges):
    data = files(spark, *REPO)
    rows = monorepo.assign(path_index(data, ranges), monorepo.subprojects(data)).collect()
    assert {(r["path"], r["root"]) for r in rows} == {
        ("apps/app1/project.json", "apps/app1"),
        ("apps/app1/inner/project.json", "apps/app1"),
        ("apps/app1/src/a.ts", "apps/app1"),
        ("apps/group/app2/project.json", "apps/group/app2"),
        ("libs/lib1/project.json", "libs/lib1"),
        ("tools/tool1/project.json", "tools/tool1"),
    }


SUBS = "project string, name string, type string, root string"


def test_overview_with_root_files(spark):
    subs = spark.createDataFrame(
        [("p", "lib1", "libs", "libs/lib1"), ("p", "b", "apps", "apps/b"), ("p", "a", "apps", "apps/a")], SUBS
    )
    roots = spark.createDataFrame([("p", "package.json"), ("p", "nx.json")], "project string, path string")
    lines = [r["line"] for r in monorepo.overview(subs, roots).orderBy("ord").collect()]
    assert lines == [
        "nx-monorepo/",
        "├── apps/",
        "│   ├── a",
        "│   └── b",
        "├── libs/",
        "│   └── lib1",
        "│",
        "├── nx.json",
        "└── package.json",
    ]


def test_overview_without_root_files(spark):
    subs = spark.createDataFrame([("p", "b", "apps", "apps/b"), ("p", "t", "tools", "tools/t")], SUBS)
    roots = spark.createDataFrame([], "project string, path string")
    lines = [r["line"] for r in monorepo.overview(subs, roots, ).orderBy("ord").collect()]
    assert lines == ["nx-monorepo/", "├── apps/", "│   └── b", "└── tools/", "    └── t"]


def test_by_type(spark):
    subs = spark.createDataFrame([("p", "b", "x", "x/b"), ("p", "a", "x", "x/a"), ("p", "c", "a", "a/c")], SUBS)
    rows = monorepo.by_type(subs).orderBy("type", "pos").collect()
    assert [(r["type"], r["pos"], r["name"]) for r in rows] == [("a", 1, "c"), ("x", 1, "a"), ("x", 2, "b")]


def test_dependencies(spark):
    data = files(spark, ("package.json", '{"vue": 1, "@angular/core": 2}'))
    got = {r["dependency"] for r in detect.dependencies(data, ["vue", "react", "@angular/core"]).collect()}
    assert got == {"vue", "@angular/core"}


def test_text_is_read_for_manifests_only(spark, tmp_path):
    build(spark, CASES).write.parquet(str(tmp_path / "f"))
    plan = detect.project_types(spark.read.parquet(str(tmp_path / "f")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    slim, manifests = sorted(scans, key=lambda line: "content" in line)
    assert "content" not in slim
    assert "EqualTo(path,package.json)" in manifests
