from __future__ import annotations

import random

import pytest

from corpusloom.llm.components import components


def expected(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for a, b in links if a != b for x in (a, b)}
    return sorted((x, find(x)) for x in nodes)


CASES = {
    "chain": [(i, i + 1) for i in range(40)],
    "star": [(7, i) for i in range(60)] + [(3, 3)],
    "random": [tuple(random.Random(s).sample(range(200), 2)) for s in range(120)],
    "repeated": [(1, 2), (2, 1), (1, 2), (5, 4), (9, 9)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    df = spark.createDataFrame(CASES[name], "a long, b long")
    assert sorted(tuple(r) for r in components(df).collect()) == expected(CASES[name])


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
