from __future__ import annotations

import hashlib
import re

import pytest

from corpusloom.llm import decontamination, tables

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return [w.decode() for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]


def expected(docs, items, window=10):
    """By trying each window of each item at every word."""
    windows = {}
    for item, text in items:
        words = split(text)
        width = min(window, len(words))
        if item is not None and width:
            for i in range(len(words) - width + 1):
                windows.setdefault(tuple(words[i : i + width]), set()).add(str(item))
    widths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, ids = split(text), set(), set()
        for width in widths:
            for i in range(len(words) - width + 1):
                if own := windows.get(tuple(words[i : i + width])):
                    hit.update(range(i, i + width))
                    ids |= own
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in tables.read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert got(decontamination.op6(spark, sf_dir)) == expected(docs, items)


DOCS = [
    (1, "x A b-c d. e"), (2, None), (3, ""), (4, "a b c " * 400), (4, "a b c " * 400), (None, "a b c d e f g h i j k"),
    (6, "é É solo ß"), (7, "q " * 3000 + "one two three four five six seven eight nine ten eleven"),
    (8, "two three four five six seven eight nine ten"), (9, "!!! ..."),
]
ITEMS = [
    (1, "A, B; c"), (2, "one two three four five six seven eight nine ten eleven"), (3, None), (4, "..."),
    (5, "solo"), (None, "x"), (6, "a b c"), (7, "c a b c a b c a b c a b"), (2, "eight nine ten"),
]


@pytest.mark.parametrize("portion", [1 << 20, 20])
def test_edge_cases(spark, portion):
    docs = spark.createDataFrame([(i, t, "z") for i, t in DOCS], "doc_id long, text string, id string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.find_items(docs, items, max_pattern_bytes=portion).collect()
    rows = []
    for r in found:
        hit = sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2]))
        digest = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        rows.append((r["doc_id"], r["n_words"], hit, len(r["items"]), digest, hit > 0))
    assert sorted(rows, key=repr) == expected(DOCS, ITEMS)
    kept = decontamination.clean_documents(docs, items, max_pattern_bytes=portion)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_items(docs.limit(0), items).count() == 0
    assert all(r["items"] == [] and r["spans"] == [] for r in decontamination.find_items(docs, items.limit(0)).collect())
