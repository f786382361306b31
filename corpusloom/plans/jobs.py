"""Whole documents for all projects of a corpus at once.

Each job returns fragments: rows of ``project``, the ordering columns and a
``markdown`` text. ``number`` turns them into ``(project, ord, markdown)``;
``sources.documents.write_documents`` writes them as files. To extend a job,
transform its input or its fragments with ``DataFrame.transform``, or add the
fragments of a section of one's own (``render.custom_fragments``).

Paths are taken from an index of the corpus, stored once (``ranking.path_index``);
pass one where several jobs read the same corpus. Texts are read for sections only.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.rules import Profile
from corpusloom.operators import detect, monorepo, profiles, render, scan, tree
from corpusloom.operators.render import TEXTS, Texts
from corpusloom.plans.ranking import PLACE, path_index, with_place, with_position
from corpusloom.plans.skew import join_facts
from corpusloom.session import materialize

# Project types documented as JavaScript projects.
JS_TYPES = ("js", "angular", "browser-extension")

SUBPROJECT_PARTS = 6


def number(fragments: DataFrame) -> DataFrame:
    """``(project, ord, markdown)`` with ``ord`` counting from 1 in each project."""
    numbered = with_position(fragments, ["project"], ["key", "line"], blocks=render.BLOCKS)
    return numbered.select("project", "ord", "markdown")


def _of(rows: DataFrame, projects: DataFrame) -> DataFrame:
    return join_facts(rows, projects.select("project"), ["project"], "left_semi")


def _frame(projects: DataFrame, head: Column | None, part: int, texts: Texts, level: int = 2) -> DataFrame:
    """What every document has whatever its files: head, tree fences and root, modules heading. One pass over ``projects``."""
    root = tree.ROOT + "\n"
    entries = [
        (part, 1, 0, render.tree_open(level, texts)), (part, 2, -1, root), (part, 3, 0, render.TREE_CLOSE), (part, 4, 0, render.modules_head(texts)),
    ]
    rows = [F.struct(*[F.lit(v) for v in e]) for e in entries]
    if head is not None:
        rows.insert(0, F.struct(F.lit(0), F.lit(0), F.lit(0), head))
    kind = "array<struct<part:int,step:int,place:int,markdown:string>>"
    found = projects.select("project", F.explode(F.array(*rows).cast(kind)).alias("e")).select("project", "e.*")
    return found.select(
        "project", "part", F.lit(0).cast("bigint").alias("unit"), "step", PLACE, F.lit("").alias("key"), F.lit(0).cast("bigint").alias("line"), "markdown"
    )


def _tree(nodes: DataFrame, part: int) -> DataFrame:
    """The drawn lines, in step 2 after the root's."""
    return render.fragments(tree.with_lines(nodes), F.concat("line", F.lit("\n")), part, step=2, key=F.col("sort_key"))


def _body(index: DataFrame, profile: Profile, part: int) -> DataFrame:
    """The tree of every project of ``index``, a stored table."""
    return _tree(tree.nodes(scan.listed(index, profile), tree.directories(index, profile)), part)


def _document(
    files: DataFrame,
    index: DataFrame,
    profile: Profile,
    projects: DataFrame,
    run_ts: Column,
    type_rule: str,
    texts: Texts,
) -> DataFrame:
    """``projects`` is ``(project, kind)``; files of other projects are left out."""
    head = render.document_head(F.col("project"), F.col("kind"), run_ts, texts)
    kept = with_place(scan.classify(files, profile, type_rule), index, paths.tree_key(F.col("path"), F.lit(False)))
    sections = render.file_fragments(kept, profile.documentation_mode, 1, step=5, texts=texts)
    # What each project has is worked out for all of them, and looked up once.
    return _frame(projects, head, 1, texts).unionByName(_of(_body(index, profile, 1).unionByName(sections), projects))


def document(
    files: DataFrame, profile: Profile, run_ts: Column, texts: Texts = TEXTS, index: DataFrame | None = None
) -> DataFrame:
    """Documents of all projects whose type is known and free of conflict.

    What a category toggle drops is dropped from tree and sections alike.
    """
    index = path_index(files) if index is None else index
    typed = detect.project_types(files, index).filter(F.col("status") == detect.OK)
    projects = typed.select("project", F.col("type").alias("kind"))
    return _document(files, index, profile, projects, run_ts, "remove", texts)


def document_by_profile(
    files: DataFrame, table: DataFrame, run_ts: Column, texts: Texts = TEXTS, index: DataFrame | None = None
) -> DataFrame:
    """Documents of the projects of known type, each under its own row of ``table``, a resolved profile table.

    Excludes, toggles, depth, size bound, selection and documentation mode act
    per project, on tree and sections. A ``status`` column of the table, as
    ``saved.dispatch`` gives it, leaves out projects whose request failed.
    Decisions are made on paths and sizes; contents are joined to the files that
    are shown, once.
    """
    index = path_index(files) if index is None else index
    if "status" in table.columns:
        table = table.filter("status = 'ok'")
    rules_of = profiles.compile_rules(table)
    typed = detect.project_types(files, index).filter(F.col("status") == detect.OK)
    projects = _of(typed.select("project", F.col("type").alias("kind")), rules_of)
    nodes = tree.nodes(profiles.listed(index, rules_of), profiles.directories(index, rules_of))
    shown = scan.with_texts(profiles.decided(index, rules_of), files)
    sections = render.file_fragments(shown, F.col("documentation_mode"), 1, step=5, texts=texts)
    head = render.document_head(F.col("project"), F.col("kind"), run_ts, texts)
    return _frame(projects, head, 1, texts).unionByName(_of(_tree(nodes, 1).unionByName(sections), projects))


def document_go(
    files: DataFrame, profile: Profile, run_ts: Column, texts: Texts = TEXTS, index: DataFrame | None = None
) -> DataFrame:
    """Documents of the Go projects; the module file is always shown, its checksums never."""
    go = replace(
        profile,
        important_files=(*profile.important_files, "go.mod"),
        excluded_patterns=(*profile.excluded_patterns, "go.sum"),
    )
    index = path_index(files) if index is None else index
    typed = detect.project_types(files, index).filter("type = 'go'")
    projects = typed.select("project", F.lit(texts.go_kind).alias("kind"))
    return _document(files, index, go, projects, run_ts, "stub", texts)


def document_js(
    files: DataFrame, profile: Profile, run_ts: Column, texts: Texts = TEXTS, index: DataFrame | None = None
) -> DataFrame:
    """Documents of the JavaScript projects, named after their framework."""
    index = path_index(files) if index is None else index
    typed = detect.project_types(files, index).filter(F.col("type").isin(*JS_TYPES))
    named = typed.join(detect.frameworks(files, index), "project")
    kind = F.concat("framework", F.lit(texts.framework_suffix)).alias("kind")
    return _document(files, index, profile, named.select("project", kind), run_ts, "stub", texts)


def document_monorepo(
    files: DataFrame, choices: DataFrame, profile: Profile, run_ts: Column, texts: Texts = TEXTS, index: DataFrame | None = None
) -> DataFrame:
    """Documents of the monorepos: overview, root configs, then each chosen sub-project.

    ``choices`` is ``(project, input)`` as for ``monorepo.pick``; a project
    without any choice is taken whole, one whose choice is void is left out.
    """
    index = path_index(files) if index is None else index
    repos = detect.project_types(files, index).filter("type = 'nx'").select("project")
    asked = repos.join(choices, "project", "left").withColumn("input", F.coalesce("input", F.lit("")))
    subs = monorepo.subprojects(_of(index.select("project", "path"), repos))
    # What the rest reads several times: the picks, few rows for each project.
    picked = materialize(monorepo.pick(monorepo.listed(subs), asked), "picked")
    chosen = picked.select("project").distinct()
    inside = _of(index, chosen)

    roots = monorepo.root_files(inside, profile).select("project", "path", PLACE)
    configs = monorepo.important_root_files(_of(files, chosen), profile.important_files, profile)
    lines = F.concat("line", F.lit("\n"))
    head = render.document_head(F.col("project"), F.lit(texts.monorepo_kind), run_ts, texts)
    top = (
        render.fragments(chosen, head, 0)
        .unionByName(render.fragments(chosen, render.monorepo_open(texts), 1))
        .unionByName(render.fragments(monorepo.overview(picked, roots), lines, 2, line=F.col("ord")))
        .unionByName(render.fragments(chosen, render.MONOREPO_CLOSE, 3))
        .unionByName(render.fragments(configs.select("project").distinct(), render.root_configs_head(texts), 4))
        .unionByName(render.file_fragments(configs, render.FULL, 5, F.col("pos"), texts=texts))
    )

    # Each pick is documented like a project of its own, under a name made of project and pick.
    name = F.concat("project", F.lit(paths.SEP), F.col("pick").cast("string"))
    below = inside.filter(F.substring_index("path", "/", 1).isin(*monorepo.FOLDERS))
    inner = monorepo.assign(below, picked.select("project", "pick", "root")).select(
        name.alias("project"),
        F.expr("substring(path, length(root) + 2)").alias("path"),
        "size",
        PLACE,
        F.col("project").alias("repo"),
        F.col("path").alias("full"),
    )
    inner = materialize(inner, "units")
    contents = files.select(F.col("project").alias("repo"), F.col("path").alias("full"), "content")
    sections = scan.with_texts(scan.decide(inner, profile), contents, ("repo", "full"))
    units = picked.select(name.alias("project"), "name", "type", "root")
    unit_head = render.subproject_head(F.col("name"), F.col("type"), F.col("root"), texts)
    parts = (
        render.fragments(units, unit_head, SUBPROJECT_PARTS, step=0)
        .unionByName(_frame(units, None, SUBPROJECT_PARTS, texts, level=3))
        .unionByName(_body(inner, profile, SUBPROJECT_PARTS))
        .unionByName(render.file_fragments(sections, profile.documentation_mode, SUBPROJECT_PARTS, step=5, texts=texts))
    )
    placed = parts.withColumns(
        {
            "unit": F.substring_index("project", paths.SEP, -1).cast("bigint"),
            "project": F.substring_index("project", paths.SEP, 1),
        }
    )
    return top.unionByName(placed)
