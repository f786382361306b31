"""Selection rules, roll-ups and the saved-selection log."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.rules import Profile
from corpusloom.operators import profiles, saved, scan, selection
from corpusloom.plans.ranking import path_index
from corpusloom.schemas import PROFILES, SELECTION_EVENTS
from tests.helpers import files, flags, paths

BARE = Profile(excluded_patterns=(), output_filename="", include_docs=True, include_tests=True)


@pytest.mark.parametrize(
    ("profile", "want"),
    [
        (replace(BARE, selection_mode="all"), {"any/file.go": True}),
        (replace(BARE, selection_mode=""), {"any/file.go": True}),
        (replace(BARE, selection_mode="unknown", included_paths=("x",)), {"any/file.go": True}),
        (replace(BARE, selection_mode="interactive", included_paths=("x",)), {"any/file.go": True}),
        (replace(BARE, selection_mode="list"), {"any/file.go": True}),
        (replace(BARE, selection_mode="patterns"), {"any/file.go": True}),
        (
            replace(BARE, selection_mode="list", included_paths=("maps/", "lib/io", "LICENSE")),
            {
                "maps/north.svg": True, "maps/old/1900.svg": True, "lib/io/read.c": True, "lib/io": True, "LICENSE": True,
                "lib/ios/read.c": False, "lib/net.c": False, "old/maps/x": False, "LICENSE.txt": False,
            },
        ),
        (
            replace(BARE, selection_mode="patterns", include_patterns=("*.toml", "lib/*.c", "**/*_bench.c")),
            {
                "build.toml": True, "lib/net.c": True, "x_bench.c": True, "lib/io/y_bench.c": True,
                "conf/build.toml": False, "lib/io/read.c": False, "net.c": False,
            },
        ),
        (
            replace(BARE, selection_mode="list", included_paths=("maps\\old", "lib/io")),
            {"maps/old": True, "lib/io": True, "maps": False},
        ),
    ],
)
def test_selection_modes(spark, profile, want):
    assert flags(spark, want, lambda c: rules.is_selected(c, profile)) == want
    # The same rules as a table of profiles.
    row = {f.name: getattr(profile, f.name, None) for f in PROFILES.fields}
    row |= {"project": "p", "output_filename": "x.md"}
    row = {k: list(v) if isinstance(v, tuple) else v for k, v in row.items()}
    row["selection_mode"] = row["selection_mode"] or "all"
    table = spark.createDataFrame([row], PROFILES)
    got = paths(profiles.select(files(spark, *want), table))
    assert got == {path for path, chosen in want.items() if chosen}


def test_listed_paths_from_a_table(spark):
    data = files(
        spark, ("p", "src/a.go", ""), ("p", "src/x/b.go", ""), ("p", "srcs/c.go", ""), ("p", "d.md", ""), ("q", "src/a.go", "")
    )
    wanted = spark.createDataFrame([("p", "src/"), ("p", "src/x"), ("p", "d.md"), ("q", "")], "project string, target string")
    for index in (None, path_index(data, 3)):
        got = [(r["project"], r["path"]) for r in selection.select_listed(data, wanted, index).collect()]
        assert sorted(got) == [("p", "d.md"), ("p", "src/a.go"), ("p", "src/x/b.go")]


def test_quick_select(spark):
    data = files(spark, "src/main.go", "src/util.go", "README.md", "test/test.go", "node_modules/a.md", "docs/x.md")
    chosen = selection.in_tree_order(selection.quick_select(data, ["src/*.go", "*.md"], BARE))
    assert [r["path"] for r in chosen.orderBy("ord").collect()] == ["src/main.go", "src/util.go", "README.md"]
    assert selection.quick_select(data, [], BARE).isEmpty()


def events(spark, *commands):
    rows = [("p", i, target, action) for i, (action, target) in enumerate(commands)]
    return spark.createDataFrame(rows, SELECTION_EVENTS)


@pytest.mark.parametrize(
    ("commands", "chosen", "states"),
    [
        ([("select", "")], {"d/a", "d/b", "d/e/c", "f"}, {"": "x", "d": "x", "d/e": "x"}),
        ([("select", ""), ("deselect", "")], set(), {"": " ", "d": " ", "d/e": " "}),
        ([("select", "d/a")], {"d/a"}, {"": "~", "d": "~", "d/e": " "}),
        ([("select", "d"), ("deselect", "d/e")], {"d/a", "d/b"}, {"": "~", "d": "~", "d/e": " "}),
        ([("deselect", "d/e/c"), ("select", "d")], {"d/a", "d/b", "d/e/c"}, {"": "~", "d": "x", "d/e": "x"}),
        ([("select", "nothing")], set(), {"": " ", "d": " ", "d/e": " "}),
    ],
)
def test_bulk_commands_and_states(spark, commands, chosen, states):
    marked = selection.bulk_select(files(spark, "d/a", "d/b", "d/e/c", "f"), events(spark, *commands))
    assert paths(marked.filter("selected")) == chosen
    assert {r["dir"]: r["state"] for r in selection.rollup(marked).collect()} == states


def test_counts_add_up(spark):
    marked = selection.bulk_select(files(spark, "d/a", "d/b", "d/e/c", "f"), events(spark, ("select", "d/e")))
    rows = {r["dir"]: (r["n_files"], r["n_selected"]) for r in selection.rollup(marked).collect()}
    assert rows == {"": (4, 1), "d": (3, 1), "d/e": (1, 1)}


def test_selected_count(spark):
    data = files(spark, "src/a.go", "src/go.sum", "src/b.tmp", "node_modules/c.js", "x.md")
    profile = replace(BARE, excluded_patterns=("*.tmp",))
    assert scan.selected_count(data, profile).first()["n_files"] == 3
    some = replace(profile, selection_mode="list", included_paths=("src",))
    assert scan.selected_count(data, some).first()["n_files"] == 1


def test_rule_counts(spark):
    df = spark.createDataFrame([("list", ["a", "b"], ["c"]), ("patterns", ["a", "b"], ["c"]), ("all", ["a"], None)], "m string, p array<string>, g array<string>")
    counts = [r[0] for r in df.select(rules.rule_count(F.col("m"), F.col("p"), F.col("g"))).collect()]
    assert counts == [2, 1, 0]


# --- saved selections ----------------------------------------------------------------

NOW = dt.datetime(2024, 1, 2, 3, 4, 5)
REQUEST = "project string, seq long, name string, description string, created timestamp, paths array<string>"


@pytest.fixture()
def log(spark):
    rows = [
        ("p", 1, "my set", "first", NOW, ["a", "b"]),
        ("p", 2, "other", "", NOW, ["c"]),
        ("p", 4, "my_set", "again", NOW, ["d"]),
        ("q", 5, "my set", None, NOW, []),
    ]
    gone = spark.createDataFrame([("p", 3, "other", NOW)], "project string, seq long, name string, created timestamp")
    return saved.saves(spark.createDataFrame(rows, REQUEST)).unionByName(saved.deletes(gone))


def test_later_save_of_a_key_replaces(log):
    got = {(r["project"], r["key"]): (r["name"], r["paths"]) for r in saved.current(log).collect()}
    assert got == {("p", "my_set"): ("my_set", ["d"]), ("q", "my_set"): ("my set", [])}


def test_load_by_name_and_last(spark, log):
    assert {r["project"]: r["paths"] for r in saved.load(log, "my set").collect()} == {"p": ["d"], "q": []}
    gone = spark.createDataFrame([("p", 9, "my set", NOW)], "project string, seq long, name string, created timestamp")
    after = log.unionByName(saved.deletes(gone))
    assert saved.load(after, "my set").filter("project = 'p'").isEmpty()
    for name in ("", "last"):
        assert {r["project"]: r["paths"] for r in saved.load(after, name).collect()} == {"p": ["d"], "q": []}


def test_deleted_and_missing(spark, log):
    assert [(r["project"], r["key"]) for r in saved.deleted(log).collect()] == [("p", "other")]
    asked = spark.createDataFrame([("p", "other"), ("p", "my set"), ("q", "other")], "project string, name string")
    assert {tuple(r) for r in saved.missing(log, asked).select("project", "name").collect()} == {("p", "other"), ("q", "other")}


def test_catalogue_labels(spark, log):
    last = spark.createDataFrame([("p", 7, "last", "", NOW, ["z"]), ("p", 8, "a-b", "", NOW, ["y"])], REQUEST)
    rows = saved.catalogue(log.unionByName(saved.saves(last))).filter("project = 'p'").orderBy("ord").collect()
    assert [(r["ord"], r["label"]) for r in rows] == [(1, "a-b (1 files)"), (2, "my_set - again (1 files)")]


def test_store_export_import(spark, log, tmp_path):
    saved.append(log.filter("seq < 4"), str(tmp_path / "log"))
    saved.append(log.filter("seq >= 4"), str(tmp_path / "log"))
    stored = saved.read(spark, str(tmp_path / "log"))
    assert stored.exceptAll(log).isEmpty() and stored.count() == log.count()
    chosen = saved.load(stored, "my set").withColumn("patterns", F.array(F.lit("*.go")))
    saved.export_to(chosen, str(tmp_path / "out"))
    back = saved.import_from(spark, str(tmp_path / "out"), F.lit(NOW + dt.timedelta(days=1)), F.lit(100))
    got = {r["project"]: (r["seq"], r["op"], r["key"], r["name"], r["paths"], r["patterns"], r["created"].day) for r in back.collect()}
    assert got == {
        "p": (100, "save", "my_set", "my_set", ["d"], None, 3),
        "q": (100, "save", "my_set", "my set", [], None, 3),
    }


def test_requests_decide_over_profiles(spark, log):
    own = spark.createDataFrame(
        [(p, "patterns", ["own"]) for p in "pqrstu"] + [("v", "odd", [])],
        "project string, selection_mode string, included_paths array<string>",
    )
    requests = spark.createDataFrame(
        [
            ("p", True, "my set", "x"),  # the last save wins over name and paths
            ("q", None, "my set", "x"),
            ("r", True, None, None),  # nothing was ever saved
            ("s", None, "gone", None),
            ("t", None, "", " a, b "),
        ],
        "project string, use_last boolean, name string, paths string",
    )
    got = {r["project"]: (r["selection_mode"], r["included_paths"], r["status"]) for r in saved.dispatch(own, requests, log).collect()}
    assert got == {
        "p": ("list", ["d"], "ok"),
        "q": ("list", [], "ok"),
        "r": ("all", ["own"], "ok"),
        "s": ("patterns", ["own"], "not_found"),
        "t": ("list", ["a", "b"], "ok"),
        "u": ("patterns", ["own"], "ok"),
        "v": ("all", [], "ok"),
    }


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_files_below_targets_equal_a_plain_comparison(spark, sf_dir, ranges):
    """Nested targets, targets that are files, prefixes that are no directories, and a project taken whole."""
    from corpusloom.plans.ancestry import below
    from corpusloom.sources.derived import corpus

    data = corpus(spark, sf_dir).select("project", "path", "size")
    rows = [(r["project"], r["path"]) for r in data.collect()]
    projects = sorted({p for p, _ in rows})
    targets = [(p, t) for p in projects for t in ("src", "src/app", "src/ap", "docs/api", "package.json", "node_modules/react", "none")]
    targets += [(rows[0][0], rows[0][1]), (projects[3], ""), (projects[4], "src/app/core")]
    table = spark.createDataFrame(targets, "project string, target string")
    by = {}
    for p, t in targets:
        by.setdefault(p, []).append(t)
    want = {(p, f) for p, f in rows if any(t in ("", f) or f.startswith(t + "/") for t in by[p])}
    got = below(path_index(data, ranges), table)
    found = [(r["project"], r["path"], r["target"]) for r in got.collect()]
    assert len(found) == len(want) and {(p, f) for p, f, _ in found} == want
    for p, f, t in found:
        around = [x for x in by[p] if x in ("", f) or f.startswith(x + "/")]
        assert t == min(around, key=len)


def test_patterns_from_a_table(spark):
    data = files(
        spark, ("p", "src/a.go", ""), ("p", "src/x/b.go", ""), ("p", "go.mod", ""), ("p", "docs/i.md", ""), ("p", "x_1", ""), ("q", "src/a.go", ""),
        ("q", "LICENSE", ""), ("q", "a/LICENSE", ""), ("q", "w.tar.gz", ""),
    )
    rows = [("p", "src/*.go"), ("p", "docs/**"), ("p", "*_[0-9]"), ("p", "[bad"), ("p", None), ("q", "LICENSE"), ("q", "w*.tar.gz"), ("q", "*.go"), ("r", "**")]
    patterns = spark.createDataFrame(rows, "project string, pattern string")
    got = {(r["project"], r["path"]) for r in selection.select_matching(data, patterns).collect()}
    assert got == {("p", "src/a.go"), ("p", "docs/i.md"), ("p", "x_1"), ("q", "LICENSE"), ("q", "w.tar.gz")}


GLOBS = (
    "**", "*", "*.go", "**/*.go", "src/**", "src/*/x.go", "a/b.txt", "**/b.txt", "x?.md", "[ab]/c.md", "*.tar.gz", "s*/**/deep.*", "src/", "a.b/*", "**/a.b",
)
SOME_PATHS = (
    "a.go", "src/a.go", "src/q/x.go", "src", "a/b.txt", "z/a/b.txt", "xy.md", "x/y.md", "a/c.md", "c/c.md", "k.tar.gz", "a.b/c", "q/a.b", "sub/d/deep.c", "sub/deep",
)


def test_index_keys_lose_no_match():
    """A path that a glob matches has the glob's key, by the meaning of the expressions alone."""
    import re

    from corpusloom.functions import globs

    def own(path):
        name, top = path.rsplit("/", 1)[-1], path.split("/")[0]
        ending = name[name.rfind(".") :] if "." in name else ""
        return {(globs.BY_NAME, name), (globs.BY_BOTH, f"{top}/{ending}"), (globs.BY_EXTENSION, ending), (globs.BY_TOP, top), (globs.BY_NOTHING, "")}

    matched = 0
    for glob in GLOBS:
        regex = re.compile(f"(?:{globs.path_regex(glob)})")
        for path in SOME_PATHS:
            if regex.fullmatch(path):
                matched += 1
                assert globs.index_key(glob) in own(path), (glob, path)
    assert matched > 30


def test_a_hundred_thousand_patterns_are_looked_up_by_key(spark):
    """No nested loop, and no expression with more than a bounded number of patterns."""
    patterns = spark.range(100_000).select(
        F.lit("p").alias("project"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), F.col("id"), F.lit("/*.go"))).otherwise(F.concat(F.lit("**/n"), F.col("id"), F.lit(".md"))).alias("pattern"),
    )
    data = spark.range(3000).select(
        F.lit("p").alias("project"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("d"), F.col("id"), F.lit("/x.go"))).otherwise(F.concat(F.lit("q/n"), F.col("id"), F.lit(".md"))).alias("path"),
    )
    got = selection.select_matching(data, patterns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    want = {f"d{i}/x.go" for i in range(0, 3000, 6)} | {f"q/n{i}.md" for i in range(3000) if i % 3 and i % 2}
    assert {r["path"] for r in got.collect()} == want
