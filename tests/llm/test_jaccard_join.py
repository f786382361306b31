from __future__ import annotations

import random
import re

import pytest

from corpusloom.llm import jaccard_join, tables

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def expected(docs, width, percent):
    """By comparing all pairs; a null id is the largest."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        key = 1 << 63 if doc is None else doc
        least[find(i)] = min(least.get(find(i), key), key)
    name = lambda i: None if least[find(i)] == 1 << 63 else least[find(i)]
    return sorted(((doc, len(sets[i]), name(i)) for i, (doc, _) in enumerate(docs)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = expected(docs, 4, 85)
    assert got(jaccard_join.op9(spark, sf_dir)) == want and any(r[0] != r[2] for r in want)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    """Groups of copies with few and many edits, documents around one passage, chains, and small sets."""
    rng = random.Random(5)
    docs, base = [], [f"w{rng.randrange(50)}" for _ in range(120)]
    docs += [edited(base, rng, rng.randrange(0, 6)) for _ in range(60)]
    docs += [" ".join(base[:60]) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    chain = [f"c{i}" for i in range(130)]
    docs += [" ".join(chain[i : i + 100]) for i in range(0, 30, 3)]
    docs += ["a", "A", "a b", "a b c", "a b c d", "a  b\tc d", "a b c d e", "", "  ", None, None, "x y x y x y x y x y", "x y x y"]
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "solo text"), (14, docs[1]), (14, "other")]


@pytest.mark.parametrize("percent,width,most", [(85, 4, 4), (80, 5, 3), (60, 2, 4), (100, 3, 1)])
def test_edge_cases(spark, percent, width, most):
    docs = near_copies()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, owner string")
    assert got(jaccard_join.similar_documents(df, width=width, percent=percent, most=most)) == expected(docs, width, percent)


def test_one_of_each_stays(spark):
    docs = near_copies() + [(14, "other"), (0, None), (0, None)]
    df = spark.createDataFrame([(t, i, 1, "x") for i, t in docs], "text string, doc_id long, node int, owner string")
    kept = jaccard_join.first_of_each(df, width=4, percent=85)
    name = {r[:2]: r for r in expected(docs, 4, 85)}
    assert kept.columns == df.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    empty = [d for d in docs if not shingles(d[1], 4)]
    classes = len({r[2] for r in expected([d for d in docs if shingles(d[1], 4)], 4, 85)})
    assert len(rows) == classes + len(empty) + 1 and len(name) > classes  # id 14 has two classes
    assert len({r for r in rows if shingles(r[1], 4)}) == classes + 1


def test_order_does_not_matter(spark, monkeypatch):
    import numpy as np

    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda *a: nothing)
    assert got(jaccard_join.similar_documents(df, width=4, percent=85)) == expected(docs, 4, 85)


def test_empty_table(spark):
    assert jaccard_join.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
