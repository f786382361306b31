from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

import duckdb
import pytest

from corpusloom.llm import filter_audit, tables
from corpusloom.llm.filter_audit import Diagram, audit, neighbour_swaps

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(i, text, docs):
    """Names of the filters that a row fails."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = set()
    if len(words) < 200:
        fails.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        fails.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        fails.add("C")
    if re.search("[#$%&*|]", text):
        fails.add("D")
    top = float("inf")
    if any((j if j is not None else top) < (i if i is not None else top) for j, other, _ in docs if (other or "") == text):
        fails.add("E")
    return fails


def brute(docs, labels):
    """Applies the filters row by row, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for *_, p in docs}:
        rows = [(i, failures(i, t, docs)) for i, t, p in docs if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                all_fail = [r for r in rows if name in r[1]]
                out[(part, "".join(order), step)] = [
                    len(left), len(gone), len(all_fail) - len(gone), sum(r[1] == {name} for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), None,
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row[-1] = shapley[order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


def collect(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIELDS) for r in df.collect()}


def test_query_equals_brute_force_and_oracle(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in tables.read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    got = collect(filter_audit.op13(spark, sf_dir))
    assert got == brute(docs, labels) and len(got) == 600 * len({p for *_, p in docs})
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(filter_audit._ORACLE)
    names = [d[0] for d in cursor.description]
    rows = [dict(zip(names, r)) for r in cursor.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIELDS) for r in rows} == got


def edge_docs():
    rng = random.Random(4)
    texts = [None, "", "a", "A B C", "x " * 250, "é" * 40, "#", " \t\x0b\n", " nbsp  ", "A" + "é" * 33, "A" + "é" * 32, "w1 w2 " * 100, "AB" * 9]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (199, 200, 201)] + [" ".join(f"w{i % k}" for i in range(400)) for k in (199, 200, 201)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, "", "only"])) for i in range(150)]
    docs += [(None, t, "en") for t in texts[:6]] + [(None, "no id has this", "fr")] * 3 + [(7, "the same row", "en")] * 5 + [(7, "the same row", "fr")]
    return docs + [(500 + i, "hot text", rng.choice(["en", "fr"])) for i in range(120)] + [(3, "zz", "rare")]


LABELS = [(i, i % 3 % 2, i % 5 == 0) for i in range(0, 520, 2)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None), (4, 1, None), (9999, 1, 1)]


def test_edge_cases_equal_brute_force(spark):
    docs = edge_docs()
    labels = [(i, q, None if t is None else int(t)) for i, q, t in LABELS]
    df = spark.createDataFrame([(i, t, p, 1, 2) for i, t, p in docs], "doc_id long, text string, lang string, mask int, n int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    assert collect(filter_audit.audit_parts(filter_audit.failure_masks(df.repartition(3), marks))) == brute(docs, labels)
    assert filter_audit.audit_parts(filter_audit.failure_masks(df.limit(0), marks)).count() == 0
    nothing = collect(filter_audit.audit_parts(filter_audit.failure_masks(df, marks.limit(0))))
    assert nothing == brute(docs, [])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_neighbour_swaps_visit_every_order_once(size):
    order = list(range(size))
    seen = [tuple(order)]
    for level in neighbour_swaps(size):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == factorial(size)


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(5)
    for _ in range(20):
        masks = {m: (rng.randrange(1, 9), rng.randrange(2), 0) for m in rng.sample(range(16), rng.randrange(1, 17))}
        moving = Diagram(masks, 4)
        for level in neighbour_swaps(4):
            moving.swap(level)
            place = {name: at for at, name in enumerate(moving.order)}
            turned = {sum(1 << place[i] for i in range(4) if m >> i & 1): c for m, c in masks.items()}
            built = Diagram(turned, 4)
            assert [(k, r) for _, k, r in moving.steps()] == [(k, r) for _, k, r in built.steps()]
            # Nodes stay shared: a swap leaves no more of them than a fresh build.
            assert moving.nodes() == built.nodes()


def test_equal_subsets_are_one_node():
    assert Diagram({m: (1, 0, 0) for m in range(32)}, 5).nodes() == 6


def test_rows_of_one_part_are_all_orders():
    rows = audit({0: (3, 0, 0), 1: (2, 1, 0), 17: (1, 0, 1)})
    assert len(rows) == 600 and {r[0] for r in rows} == {"".join(p) for p in permutations("ABCDE")}
