"""Sections, whole documents, and the files they are written to."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.languages import language
from corpusloom.functions.rules import Profile
from corpusloom.operators import render
from corpusloom.plans import jobs
from corpusloom.plans.ranking import path_index
from corpusloom.sources.documents import pieces, write_documents
from tests.helpers import files

TS = F.to_timestamp


def section(spark, path, content, skipped=False, mode=render.FULL):
    row = files(spark, (path, content)).withColumns({"lang": language(F.col("path")), "skipped": F.lit(skipped)})
    return render.with_section(row, mode).first()["markdown"]


def test_full_section(spark):
    text = "def area(r):\n    return 3 * r * r"
    assert section(spark, "geo/circle.py", text) == f"### geo/circle.py\n\n```python\n{text}\n```\n\n"
    assert section(spark, "a.less", "x\n") == "### a.less\n\n```scss\nx\n```\n\n"
    assert section(spark, "a.txt", "") == "### a.txt\n\n```text\n```\n\n"
    assert section(spark, "a.md", "```\nx\n```") == "### a.md\n\n```markdown\n```\nx\n```\n```\n\n"


def test_skipped_section(spark):
    # The wording of a stub.
    want = "### maps/world.dat\n\n```\n[Содержимое файла пропущено]\n```\n\n_Файл был пропущен по настройкам документации._\n\n"
    for mode in (render.FULL, render.HEADERS):
        assert section(spark, "maps/world.dat", None, True, mode) == want


def test_headers_section(spark):
    code = 'import (\n"fmt"\n)\ntype T int\nfunc F() {}\nconst C = 1\n'
    assert section(spark, "a.go", code, mode=render.HEADERS) == (
        "### a.go\n\n**File Type:** GO\n\n**Summary:** Go file with 1 types, 1 functions, 1 constants\n\n"
        "**Exported Functions:**\n```go\nF\n```\n\n**Exported Types:**\n```go\nT\n```\n\n"
        "**Dependencies:**\n- `fmt`\n\n_To view full file content, use the tag: `[FILE:a.go]`_\n\n"
    )
    assert section(spark, "a.css", "x", mode=render.HEADERS) == (
        "### a.css\n\n**File Type:** CSS\n\n**Summary:** css file - header extraction not yet implemented\n\n"
        "_To view full file content, use the tag: `[FILE:a.css]`_\n\n"
    )


@pytest.mark.parametrize(
    ("name", "stamped", "want"),
    [
        ("", True, "project_docs_20240506_070809.md"),
        ("", False, "project_docs_20240506_070809.md"),
        ("docs.md", True, "docs_20240506_070809.md"),
        ("docs.md", False, "docs.md"),
        ("out.d/docs", True, "out.d/docs_20240506_070809"),
    ],
)
def test_output_name(spark, name, stamped, want):
    df = spark.range(1).select(render.output_name(F.lit(name), F.lit(stamped), TS(F.lit("2024-05-06 07:08:09"))).alias("n"))
    assert df.first()["n"] == want


PROFILE = Profile(excluded_patterns=(), include_docs=True)

# The wording of a document.
HEAD = (
    "# Проект: {name}\n\n**Дата генерации:** 2024-05-06 07:08:09\n\n"
    "**Полнота:** Полная структура проекта и исходный код\n\n**Тип:** {kind}\n\n"
    "## Содержание\n- [Структура проекта](#структура-проекта)\n- [Основные модули](#основные-модули)\n"
)
MODULES = "## Основные модули\n\nВ этом разделе представлены ключевые файлы проекта с их исходным кодом:\n\n"


def run_ts():
    return TS(F.lit("2024-05-06 07:08:09"))


def text_of(numbered, project="p"):
    rows = numbered.filter(F.col("project") == project).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))
    return "".join(r["markdown"] for r in rows)


def test_document(spark):
    data = files(
        spark,
        ("go.mod", "module m\n"),
        ("cmd/main.go", "package main"),
        ("cmd/a.spec.js", "t"),
        ("node_modules/x.js", "x"),
        ("pic.png", "x"),
        ("big.txt", "x" * 50),
        ("q", "package.json", ""),
        ("q", "go.mod", ""),
    )
    profile = replace(PROFILE, max_file_size=20)
    numbered = jobs.number(jobs.document(data, profile, run_ts()))
    assert text_of(numbered) == (
        HEAD.format(name="p", kind="go")
        + "## Структура проекта\n\n```\n.\n├── cmd/\n│   └── main.go\n├── big.txt\n└── go.mod\n\n```\n\n"
        + MODULES
        + "### cmd/main.go\n\n```go\npackage main\n```\n\n"
        + "### big.txt\n\n```\n[Содержимое файла пропущено]\n```\n\n_Файл был пропущен по настройкам документации._\n\n"
        + "### go.mod\n\n```text\nmodule m\n```\n\n"
    )
    assert text_of(numbered, "q") == ""  # a conflict stops the document


def test_go_document(spark):
    data = files(spark, ("go.mod", "m"), ("go.sum", "s"), ("a.spec.js", "t"), ("b.go", "x"))
    profile = replace(PROFILE, excluded_patterns=("go.mod",), important_files=())
    text = text_of(jobs.number(jobs.document_go(data, profile, run_ts())))
    assert text.startswith(HEAD.format(name="p", kind="Go проект"))
    assert "```\n.\n├── b.go\n└── go.mod\n\n```" in text
    assert "### go.mod\n\n```text\nm\n```" in text and "go.sum" not in text
    assert "### a.spec.js\n\n```\n[Содержимое файла пропущено]" in text


def test_js_document(spark):
    data = files(spark, ("package.json", '{"react": 1}'), ("src/a.ts", "x"), ("g", "go.mod", ""))
    profile = replace(PROFILE, include_configs=False, important_files=("package.json",))
    numbered = jobs.number(jobs.document_js(data, profile, run_ts()))
    text = text_of(numbered)
    assert text.startswith(HEAD.format(name="p", kind="React проект"))
    assert '### package.json\n\n```json\n{"react": 1}\n```' in text
    assert text_of(numbered, "g") == ""


def test_project_without_shown_files_still_has_a_tree(spark):
    data = files(spark, ("package.json", "{}"))
    profile = replace(PROFILE, include_configs=False)
    text = text_of(jobs.number(jobs.document(data, profile, run_ts())))
    assert "```\n.\n\n```\n\n" in text and text.endswith(MODULES)


def test_monorepo_document(spark):
    data = files(
        spark,
        ("nx.json", "{}"),
        ("apps/web/project.json", "{}"),
        ("apps/web/src/a.ts", "a"),
        ("libs/ui/project.json", "{}"),
        ("libs/ui/b.ts", "b"),
        ("r", "nx.json", "{}"),
        ("r", "apps/x/project.json", "{}"),
    )
    choices = spark.createDataFrame([("p", "2,1,2"), ("r", "9")], "project string, input string")
    profile = replace(PROFILE, important_files=("nx.json", "package.json"))
    numbered = jobs.number(jobs.document_monorepo(data, choices, profile, run_ts()))

    def unit(name, kind, root, tree, *sections):
        return (
            f"\n## Проект: {name} ({kind})\n\n**Путь:** {root}\n\n"
            f"### Структура проекта\n\n```\n{tree}\n\n```\n\n{MODULES}" + "".join(sections)
        )

    marker = "### project.json\n\n```json\n{}\n```\n\n"
    ui = unit("ui", "libs", "libs/ui", ".\n├── b.ts\n└── project.json", "### b.ts\n\n```typescript\nb\n```\n\n", marker)
    web = unit(
        "web", "apps", "apps/web", ".\n├── src/\n│   └── a.ts\n└── project.json",
        "### src/a.ts\n\n```typescript\na\n```\n\n", marker,
    )
    assert text_of(numbered) == (
        HEAD.format(name="p", kind="NX Monorepo")
        + "## Общая структура Nx Monorepo\n\n```\nnx-monorepo/\n├── apps/\n│   └── web\n├── libs/\n│   ├── ui\n│   └── ui\n"
        + "│\n└── nx.json\n```\n\n"
        + "\n## Корневые конфигурационные файлы\n\nВ этом разделе представлены основные конфигурационные файлы проекта:\n\n"
        + "### nx.json\n\n```json\n{}\n```\n\n"
        + ui + web + ui
    )
    assert text_of(numbered, "r") == ""  # nothing was chosen


def texts_of(numbered):
    want = {}
    for row in numbered.orderBy("project", "ord").collect():
        want[row["project"]] = want.get(row["project"], "") + row["markdown"]
    return want


def read_back(folder):
    """Text and sizes of pieces by project and output name; pieces are folders with one file."""
    out = {}
    for project in Path(folder).glob("project=*"):
        for output in project.glob("output=*"):
            names = sorted(output.glob("piece=*"), key=lambda f: int(f.name.split("=")[1]))
            parts = [list(f.glob("part-*")) for f in names]
            assert all(len(p) == 1 for p in parts)
            key = project.name.split("=")[1], unquote(output.name.split("=")[1])
            out[key] = [p[0].read_bytes() for p in parts]
    return out


@pytest.mark.parametrize("piece_bytes", [3000, 20_000, 1 << 26])
@pytest.mark.parametrize("ranges", [1, 30])
def test_written_documents_read_back(spark, sf_dir, tmp_path, piece_bytes, ranges):
    from corpusloom.sources.derived import corpus

    data = corpus(spark, sf_dir)
    fragments = jobs.document(data, replace(PROFILE, documentation_mode="headers"), run_ts(), index=path_index(data, ranges))
    names = data.select("project").distinct().select("project", F.concat(F.lit("out/"), "project", F.lit(".md")).alias("output"))
    want = texts_of(jobs.number(fragments))
    write_documents(fragments, names, str(tmp_path / "docs"), piece_bytes)
    got = read_back(tmp_path / "docs")
    assert {p: b"".join(parts).decode() for (p, _), parts in got.items()} == want
    assert {name for _, name in got} == {f"out/{p}.md" for p in want}
    # No piece over the size, but for a section that is longer by itself.
    sections = {len(r["markdown"].encode()) for r in fragments.select("markdown").collect()}
    assert all(len(part) <= piece_bytes or len(part) in sections for parts in got.values() for part in parts)
    if piece_bytes == 1 << 26:
        assert all(len(parts) == 1 for parts in got.values())
    if piece_bytes == 3000:
        assert sum(map(len, got.values())) > len(want) + 10


def test_pieces_depend_on_bytes_alone(spark, sf_dir):
    """The same cuts whatever the number of rows or ranges, and when few long sections stand among many short ones."""
    rows = [("p", 1, 0, 5, 0, f"{i:06d}", 0, ("x" * (700 if i % 50 == 0 else 9)) + "\n") for i in range(1200)]
    shape = "project string, part int, unit long, step int, place int, key string, line long, markdown string"
    whole = spark.createDataFrame(rows, shape)
    cut = whole.withColumn("place", (F.col("key").cast("int") / 37).cast("int"))
    one, other = (pieces(df, 1000).select("piece", "ord", "bytes") for df in (whole, cut))
    assert one.exceptAll(other).isEmpty() and one.count() == 1200
    found = one.groupBy("piece").agg(F.sum("bytes").alias("b"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"))
    found = found.orderBy("piece").collect()
    assert max(r["b"] for r in found) <= 1000 and all(r["n"] == 1 for r in found if r["piece"] % 2)
    assert all(a["high"] + 1 == b["low"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("ranges", [3, 60])
def test_numbering_in_ranges_is_the_same(spark, sf_dir, ranges):
    from corpusloom.sources.derived import corpus

    data = corpus(spark, sf_dir)
    whole = jobs.number(jobs.document(data, PROFILE, run_ts(), index=path_index(data, 1)))
    ranged = jobs.number(jobs.document(data, PROFILE, run_ts(), index=path_index(data, ranges)))
    assert ranged.exceptAll(whole).isEmpty() and ranged.count() == whole.count()


def jobs_of(spark, build):
    """Jobs that run while a plan is built."""
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    build()
    return len(set(tracker.getJobIdsForGroup()) - before)


def test_building_runs_few_jobs(spark, sf_dir):
    """The index of paths is all that is stored, and a monorepo's picks."""
    from corpusloom.queries import QUERIES

    assert jobs_of(spark, lambda: QUERIES["document_lines"](spark, sf_dir)) <= 4
    assert jobs_of(spark, lambda: QUERIES["document_go"](spark, sf_dir)) <= 4
    # Its corpus has markers made by a distinct, which is a job more.
    assert jobs_of(spark, lambda: QUERIES["section_monorepo"](spark, sf_dir)) <= 5


def whole_profile(project, **changes):
    base = dict(
        project=project, max_file_size=1 << 20, include_tests=True, include_configs=True, include_markup=True, include_styles=True, include_docs=True,
        excluded_patterns=[], documentation_mode="full", selection_mode="all", included_paths=[], include_patterns=[], important_files=[],
        show_full_structure=False, output_format="markdown", output_filename="", append_timestamp=False,
    )
    return {**base, **changes}


def profile_rows(spark, *rows, extra=()):
    from pyspark.sql import types as T

    from corpusloom.schemas import PROFILES

    shape = T.StructType([*PROFILES.fields, *extra])
    return spark.createDataFrame([tuple(r.get(f.name) for f in shape.fields) for r in rows], shape)


def test_each_project_is_documented_under_its_own_profile(spark):
    from pyspark.sql import types as T

    data = files(
        spark,
        *[(p, path, text) for p in ("a", "b", "c") for path, text in (
            ("go.mod", "m"), ("src/main.go", "package main\nfunc Run() {}\n"), ("src/deep/er/x.go", "package er"), ("gen/y.go", "package gen"), ("readme.md", "hi"),
        )],
    )
    table = profile_rows(
        spark,
        whole_profile("a", excluded_patterns=["gen"], documentation_mode="headers", max_depth=1),
        whole_profile("b", selection_mode="list", included_paths=["src/main.go"], include_docs=False, max_file_size=5),
        whole_profile("c", excluded_patterns=["src/**"], important_files=["readme.md"], include_docs=False),
        extra=[T.StructField("max_depth", T.IntegerType())],
    )
    numbered = jobs.number(jobs.document_by_profile(data, table, run_ts()))
    a, b, c = (text_of(numbered, p) for p in "abc")
    assert all(t.startswith(HEAD.format(name=p, kind="go")) for t, p in ((a, "a"), (b, "b"), (c, "c")))
    assert "```\n.\n├── src/\n│   ├── deep/\n│   └── main.go\n├── go.mod\n└── readme.md\n\n```" in a
    assert "**Exported Functions:**\n```go\nRun\n```" in a and "### gen/y.go" not in a and "### src/deep/er/x.go" not in a
    assert "├── gen/\n│   └── y.go\n" in b and "readme.md" not in b
    assert b.endswith(MODULES + "### src/main.go\n\n```\n[Содержимое файла пропущено]\n```\n\n_Файл был пропущен по настройкам документации._\n\n")
    assert "```\n.\n├── gen/\n│   └── y.go\n├── go.mod\n└── readme.md\n\n```" in c and "### readme.md" in c and "### src/" not in c


def test_projects_without_profile_or_with_a_conflict_get_no_document(spark):
    data = files(spark, ("a", "go.mod", ""), ("b", "go.mod", ""), ("c", "go.mod", ""), ("c", "package.json", ""))
    table = profile_rows(spark, whole_profile("a"), whole_profile("c"))
    assert {r["project"] for r in jobs.document_by_profile(data, table, run_ts()).select("project").distinct().collect()} == {"a"}


def test_every_kept_file_is_in_the_tree_once(spark, sf_dir):
    from corpusloom.operators import scan, tree
    from corpusloom.sources.derived import corpus

    data = corpus(spark, sf_dir)
    kept = scan.classify(data, PROFILE, "remove")
    nodes = tree.nodes(scan.listed(data, PROFILE), tree.directories(data, PROFILE)).filter("NOT is_dir")
    assert kept.join(nodes, ["project", "path"], "left_anti").isEmpty()
    assert nodes.groupBy("project", "path").count().filter("count > 1").isEmpty()
    counts = kept.groupBy("skipped").count().collect()
    assert sum(r["count"] for r in counts) == kept.count()


def test_jobs_extend_by_transform(spark):
    data = files(spark, ("go.mod", "secret"), ("a.go", "secret"))
    masked = data.transform(lambda df: df.withColumn("content", F.regexp_replace("content", "secret", "***")))
    text = text_of(jobs.number(jobs.document(masked, PROFILE, run_ts())))
    assert "secret" not in text and text.count("***") == 2


def test_sections_of_ones_own_are_ordered_with_the_rest(spark):
    """Files without content, files that give nothing, several texts of one file, several projects."""
    data = files(
        spark, ("p", "go.mod", "m"), ("p", "b/x.go", "one\ntwo"), ("p", "a.go", "a"), ("p", "none.go", None), ("p", "y.md", "skip"), ("q", "go.mod", ""),
        ("q", "main.go", "z"),
    )

    def words(path, content):
        if path.endswith(".go"):
            yield f"* {path}\n"
            for line in (content or "-").split("\n"):
                yield f"  {line}\n"

    own = render.custom_fragments(data, words, 1, step=6)
    whole = jobs.number(jobs.document(data, PROFILE, run_ts()).unionByName(own))
    assert text_of(whole).endswith("* b/x.go\n  one\n  two\n* a.go\n  a\n* none.go\n  -\n")
    assert text_of(whole, "q").endswith("* main.go\n  z\n")


def test_requests_decide_on_the_documents(spark):
    from corpusloom.operators import saved

    data = files(spark, *[(p, path, "x") for p in "abcd" for path in ("go.mod", "src/a.go", "src/b.go", "docs/c.md")])
    profiles = profile_rows(spark, *[whole_profile(p) for p in "abcd"])
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    log = spark.createDataFrame(
        [("a", 1, "first", "", ["docs"]), ("a", 2, "newest", "", ["src/a.go"]), ("b", 1, "old one", "", ["docs/"])],
        "project string, seq long, name string, description string, paths array<string>",
    ).withColumn("created", stamp)
    asked = spark.createDataFrame(
        [("a", True, None, None), ("b", None, "old_one", None), ("c", None, None, "src/b.go, go.mod"), ("d", False, "gone", None)],
        "project string, use_last boolean, name string, paths string",
    )
    table = saved.dispatch(profiles, asked, saved.saves(log))
    assert {r["project"]: r["status"] for r in table.collect()} == {"a": "ok", "b": "ok", "c": "ok", "d": "not_found"}
    sections = jobs.document_by_profile(data, table, run_ts()).filter("step = 5")
    got = {}
    for r in sections.select("project", "markdown").collect():
        got.setdefault(r["project"], set()).add(r["markdown"].split("\n")[0])
    assert got == {"a": {"### src/a.go"}, "b": {"### docs/c.md"}, "c": {"### src/b.go", "### go.mod"}}
