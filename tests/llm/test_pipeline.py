from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from corpusloom.llm import tables
from tests.llm import test_decontamination, test_jaccard_join


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before the first stage and after each."""
    out = [tables.read(spark, sf_dir, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(tables.store(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert all(df.select("doc_id").distinct().count() == n for df, n in zip(stages, counts))


def test_classifier_goes_by_the_labels(stages, spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in tables.read(spark, sf_dir, "labels").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert all(before[i] == t for i, t in after.items())
    judged = [(labels[i], i in after) for i in before if i in labels]
    assert sum((q == 1) == kept for q, kept in judged) / len(judged) > 0.9


def test_lines_are_dropped(stages):
    before, after = rows(stages[1]), rows(stages[2])
    for i, text in after.items():
        lines = iter(before[i].split("\n"))
        assert all(line in lines for line in text.split("\n"))
    seen = set()
    for i in sorted(after):
        for line in after[i].split("\n"):
            if any(c.isalnum() for c in line):
                assert line not in seen
                seen.add(line)
    assert stages[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_similar_stays(stages):
    before, after = list(rows(stages[2]).items()), rows(stages[3])
    want = {i for i, _, name in test_jaccard_join.expected(before, 5, 80) if i == name}
    assert set(after) == want


def test_contaminated_documents_go(stages, spark, sf_dir):
    items = [tuple(r) for r in tables.read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    before = list(rows(stages[3]).items())
    want = {r[0] for r in test_decontamination.expected(before, items) if not r[-1]}
    assert set(rows(stages[4])) == want


def test_pieces_give_the_texts_back(stages):
    assert rows(stages[5]) == rows(stages[4])


def test_run_and_registration(spark, sf_dir, stages):
    assert contract.queries()["pipeline"] is pipeline.run
    assert {r["doc_id"] for r in pipeline.run(spark, sf_dir).select("doc_id").collect()} == set(rows(stages[-1]))
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in contract.queries()}


EXTRA = ("owner", "row", "__o", "__h", "__d", "__t", "dropped", "left", "key", "node", "text_hash", "norm", "class", "id")


def edge_folder(spark, folder, docs):
    """Tables with ``docs`` (doc_id, text) under further columns whose names the operators use themselves."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(i, t, None if k % 3 else "en", "s", None if t is None else len(t), *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, shape).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, None)] + [(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_edge_cases_run_through(spark, tmp_path):
    leak = "one two three four five six seven eight nine ten eleven and more"
    docs = [(i, f"document number {i} says word{i} and word{i * 7} to whom{i} it may{i} concern") for i in range(40)]
    docs += [(i, docs[i][1]) for i in range(3)] + [(None, None), (None, None), (50, None), (51, ""), (51, ""), (52, "\n\n"), (53, leak), (None, "no id " * 9)]
    docs += [(54, "long " * 30_000), (3, docs[3][1]), (3, "another text of id three")]
    result = pipeline.run(spark, edge_folder(spark, tmp_path / "a", docs)).collect()
    kept = [(r["doc_id"], r["text"]) for r in result]
    assert 0 < len(kept) <= len(docs) and not any("seven eight nine ten" in (t or "") for _, t in kept)
    # No line with words is kept twice.
    lines = [line for _, t in kept for line in (t or "").split("\n") if any(c.isalnum() for c in line)]
    assert len(lines) == len(set(lines))


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    folder = edge_folder(spark, tmp_path / "b", [(i, f"text {i * 1009} of its own\nshared line of all") for i in range(30)])
    docs = tables.read(spark, folder, "documents")
    for _, stage in pipeline.STAGES[1:-1]:
        after = tables.store(stage(spark, docs, folder), "edge")
        assert after.columns == docs.columns
        own = {r["doc_id"]: [r[c] for c in EXTRA] for r in docs.collect()}
        assert all([r[c] for c in EXTRA] == own[r["doc_id"]] for r in after.collect()) and after.count() > 0
        docs = after


def test_empty_table(spark, tmp_path):
    assert pipeline.run(spark, edge_folder(spark, tmp_path / "c", [])).count() == 0
