"""Tree nodes, order and drawing."""

from __future__ import annotations

from dataclasses import replace

import pytest

from corpusloom.functions.rules import Profile
from corpusloom.operators import scan, tree
from corpusloom.plans.ranking import path_index
from tests.helpers import files

PROFILE = Profile(excluded_patterns=(), output_filename="", include_docs=True, include_tests=True)

GOLDEN = """.
├── dir1/
│   ├── subdir/
│   │   └── file2.txt
│   └── file1.txt
├── dir2/
│   └── file3.txt
├── important.config
└── root_file.txt"""


def draw(data, profile=PROFILE, ranges=None):
    index = path_index(data, ranges) if ranges else data
    nodes = tree.nodes(scan.listed(index, profile), tree.directories(index, profile))
    rows = tree.lines(nodes).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(len(rows)))
    return "\n".join(r["line"] for r in rows)


def sample(spark):
    return files(
        spark, "root_file.txt", "dir1/file1.txt", "dir1/subdir/file2.txt", "dir2/file3.txt", "important.config"
    )


@pytest.mark.parametrize("ranges", [None, 1, 3, 50])
def test_golden_tree(spark, ranges):
    assert draw(sample(spark), ranges=ranges) == GOLDEN


def test_deeper_prefixes(spark):
    data = files(spark, "a/b/c/d.txt", "a/b/e.txt", "a/z/y.txt", "q.txt")
    assert draw(data) == "\n".join(
        [
            ".",
            "├── a/",
            "│   ├── b/",
            "│   │   ├── c/",
            "│   │   │   └── d.txt",
            "│   │   └── e.txt",
            "│   └── z/",
            "│       └── y.txt",
            "└── q.txt",
        ]
    )


def test_names_are_ordered_by_bytes_within_their_directory(spark):
    data = files(spark, "src-x/a", "src/b", "src.d/c", "Src/d", "Z", "a", "é", "src/b-1/x")
    lines = draw(data).splitlines()
    assert lines == [
        ".",
        "├── Src/",
        "│   └── d",
        "├── src/",
        "│   ├── b-1/",
        "│   │   └── x",
        "│   └── b",
        "├── src-x/",
        "│   └── a",
        "├── src.d/",
        "│   └── c",
        "├── Z",
        "├── a",
        "└── é",
    ]


def test_directory_stays_when_its_files_are_dropped(spark):
    data = files(spark, "img/logo.png", "src/a.go", "node_modules/x/y.js", "deep/only/b.log")
    assert draw(data) == "\n".join([".", "├── deep/", "│   └── only/", "├── img/", "└── src/", "    └── a.go"])


def test_directory_called_like_a_config_file_is_kept(spark):
    profile = replace(PROFILE, include_configs=False)
    assert draw(files(spark, "config.yml/a.txt", "b.yml"), profile) == ".\n└── config.yml/\n    └── a.txt"


def test_projects_do_not_mix(spark):
    data = files(spark, ("p", "a/x", ""), ("q", "a/x", ""), ("q", "a/y", ""))
    nodes = tree.nodes(data, tree.directories(data))
    flags = {(r["project"], r["path"]): r["is_last"] for r in tree.with_last_flag(nodes).collect()}
    assert flags == {("p", "a"): True, ("p", "a/x"): True, ("q", "a"): True, ("q", "a/x"): False, ("q", "a/y"): True}


def test_every_line_follows_its_parent(spark, sf_dir):
    from corpusloom.sources.derived import corpus

    data = corpus(spark, sf_dir)
    index = path_index(data, 40)
    nodes = tree.nodes(scan.listed(index, PROFILE), tree.directories(index, PROFILE))
    rows = tree.in_order(nodes).collect()
    place = {(r["project"], r["path"]): r["ord"] for r in rows}
    assert len(place) == len(rows)
    for r in rows:
        assert r["parent"] == "" or place[r["project"], r["parent"]] < r["ord"]
