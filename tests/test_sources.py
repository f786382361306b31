"""Reading corpora from folders and tables, and the shared work folder."""

from __future__ import annotations

from pathlib import Path
from shutil import rmtree

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.rules import Profile, is_pruned
from corpusloom.operators import scan
from corpusloom.plans import jobs
from corpusloom.session import clear_work, materialize, work_folder
from corpusloom.sources.documents import write_documents
from corpusloom.sources.files import bounded, read_table, with_path_parts
from corpusloom.sources.folders import LOOSE, read_folder


def lay_out(root):
    for path, text in {
        "one/src/a.go": "package a\n",
        "one/big.txt": "x" * 100,
        "one/exact.txt": "y" * 64,
        "one/.hidden": "h",
        "two/a b.txt": "ü",
        "two/empty": "",
        "one/pkg/__init__.py": "",
        "one/node_modules/x.js": "x",
        "build/x": "x",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)


def as_rows(df):
    return {(r["project"], r["path"]): (r["size"], r["content"]) for r in df.collect()}


def test_folder_of_projects(spark, tmp_path):
    lay_out(tmp_path)
    assert as_rows(read_folder(spark, str(tmp_path), 64)) == {
        ("one", "src/a.go"): (10, "package a\n"),
        ("one", "big.txt"): (100, None),
        ("one", "exact.txt"): (64, "y" * 64),
        ("one", ".hidden"): (1, "h"),
        ("one", "pkg/__init__.py"): (0, ""),
        ("one", "node_modules/x.js"): (1, "x"),
        ("two", "a b.txt"): (2, "ü"),
        ("two", "empty"): (0, ""),
        ("build", "x"): (1, "x"),
    }


def test_pruned_folders_are_not_entered(spark, tmp_path):
    lay_out(tmp_path)
    profile = Profile(excluded_patterns=("src",))
    got = as_rows(read_folder(spark, str(tmp_path), 64, prune=lambda p: is_pruned(p, profile)))
    assert ("build", "x") in got  # a project's own name is not tested
    assert ("one", "pkg/__init__.py") in got
    assert ("one", "src/a.go") not in got and ("one", "node_modules/x.js") not in got


def test_folder_as_one_project(spark, tmp_path):
    lay_out(tmp_path)
    got = as_rows(read_folder(spark, f"file://{tmp_path}/one", 1000, project="me", prune=lambda p: p == "node_modules"))
    assert set(got) == {("me", p) for p in ("src/a.go", "big.txt", "exact.txt", ".hidden", "pkg/__init__.py")}


def test_unreadable_file_stays_as_a_stub(spark, tmp_path):
    lay_out(tmp_path)
    (tmp_path / "two" / "loop").symlink_to("loop")
    rows = scan.classify(read_folder(spark, str(tmp_path), 64), Profile(excluded_patterns=())).collect()
    state = {r["path"]: (r["skipped"], r["content"]) for r in rows if r["project"] == "two"}
    assert state["empty"] == (False, "") and state.get("loop", (True, None)) == (True, None)


def test_deep_and_loose_files_are_read(spark, tmp_path):
    deep = "one/" + "d/" * 30 + "f.txt"
    for path in (deep, "loose.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    assert as_rows(read_folder(spark, str(tmp_path))) == {
        ("one", deep[4:]): (len(deep), deep), (LOOSE, "loose.md"): (8, "loose.md"),
    }


def test_oversized_files_become_stubs(spark, tmp_path):
    lay_out(tmp_path)
    profile = Profile(max_file_size=64, excluded_patterns=())
    rows = scan.classify(read_folder(spark, str(tmp_path), 64), profile).collect()
    assert {r["path"]: r["skipped"] for r in rows if r["path"].endswith("txt")} == {
        "big.txt": True,
        "exact.txt": False,
        "a b.txt": False,
    }


def test_bodies_are_read_once(spark, tmp_path):
    """What is made of the table later reads none: the folder may be gone by then."""
    lay_out(tmp_path / "in")
    (tmp_path / "in" / "one" / "go.mod").write_text("module one\n")
    table = read_folder(spark, str(tmp_path / "in"))
    rmtree(tmp_path / "in")
    fragments = jobs.document(table, Profile(include_docs=True, excluded_patterns=()), F.current_timestamp())
    names = table.select("project", F.lit("docs.md").alias("output")).distinct()
    write_documents(fragments, names, str(tmp_path / "out"))
    written = "".join(f.read_text() for f in (tmp_path / "out").rglob("part-*"))
    assert "package a\n" in written and "module one\n" in written
    plan = table.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "content" not in plan.split("ReadSchema", 1)[1]


def test_a_directory_is_listed_as_a_stream(tmp_path):
    from pyarrow import fs

    from corpusloom.sources import folders

    for i in range(30):
        (tmp_path / f"f{i}").write_text("x" * i)
    (tmp_path / "d").mkdir()
    entries = folders._entries(fs.LocalFileSystem(), str(tmp_path))
    assert iter(entries) is entries  # nothing is listed before it is asked for
    found = {path.rsplit("/", 1)[-1]: (is_dir, size) for path, is_dir, size in entries}
    assert found["d"][0] and all(found[f"f{i}"] == (False, i) for i in range(30)) and len(found) == 31


def test_a_cluster_needs_the_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/w"}.get(key, default)

    class Session:
        conf = Conf()

        class sparkContext:
            master = "local[2]"

    assert work_folder(Session) == "file:/w/_work"
    for master in ("yarn", "spark://x:7077", "k8s://x", "local-cluster[2,1,512]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_folder(Session)


def test_table(spark, tmp_path):
    df = spark.createDataFrame([("p", "src\\a.go", 1, "x"), ("p", "b", 9, "y")], "project string, path string, size long, content string")
    df.write.parquet(str(tmp_path / "t"))
    files = with_path_parts(read_table(spark, str(tmp_path / "t")))
    row = files.filter("name = 'a.go'").first()
    assert (row["path"], row["parent"], row["ext"], row["depth"], row["lang"]) == ("src/a.go", "src", ".go", 2, "go")
    plan = files.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    got = {r["path"]: (r["skipped"], r["content"]) for r in bounded(files, 5).collect()}
    assert got == {"src/a.go": (False, "x"), "b": (True, None)}


def test_stored_tables_lie_in_the_named_folder(spark):
    folder = work_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5).select(F.col("id"), F.lit("x").alias("s"))
    stored = materialize(df, "t")
    assert stored.schema == df.schema or stored.count() == 5
    assert folder in stored.inputFiles()[0]


def test_stored_tables_go_in_one_call(spark):
    path = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert Path(path).exists()
    clear_work(spark)
    assert not Path(path).exists()
