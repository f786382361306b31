from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import fingerprints as fp
from corpusloom.llm import tables


def slow_winnow(text, gram, window):
    """By looking at each window."""
    points = fp.code_points(text)
    if not len(points):
        return []
    gram = min(gram, len(points))
    hashes = [int(fp._rolling(points[i : i + gram], gram)[0]) for i in range(len(points) - gram + 1)]
    window = min(window, len(hashes))
    chosen = set()
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        chosen.add(i + max(j for j, h in enumerate(part) if h == min(part)))
    return [(i, hashes[i] >> 32) for i in sorted(chosen)]


TEXTS = ["", "a", "abc" * 5, "x" * 100, "the cat sat on the mat " * 7, "é\U0001f600ß\n" * 30, "".join(map(chr, range(32, 400)))]


@pytest.mark.parametrize("gram,window", [(16, 32), (5, 4), (1, 1), (7, 13)])
def test_chosen_grams(gram, window):
    for text in TEXTS:
        at, hashes = fp.winnow(text, gram, window)
        assert list(zip(at.tolist(), hashes.tolist())) == slow_winnow(text, gram, window)
        back = fp.decode(fp.encode(at, hashes))
        assert np.array_equal(back[0], at) and np.array_equal(back[1], hashes)


def test_long_matches_are_seen():
    rng = random.Random(3)
    for _ in range(20):
        common = "".join(rng.choice("abcdef") for _ in range(fp.GRAM + fp.WINDOW - 1))
        sides = ["".join(rng.choice("ghij") for _ in range(rng.randrange(200))) + common + "k" * rng.randrange(90) for _ in range(2)]
        assert np.intersect1d(fp.winnow(sides[0])[1], fp.winnow(sides[1])[1]).size


def expected(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: -d[0])
    out = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [{h for _, h in zip(*map(list, fp.winnow(t)))} for t in (text, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.encode(*fp.winnow(text)), fp.encode(*fp.winnow(edited)),
            like(sets[0], sets[1]), like(sets[0], sets[2]),
        ))
    return sorted(out)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in fp.op2(spark, sf_dir).collect()) == expected(docs)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edge_cases(spark, ranges):
    docs = [(i * i - 20, t) for i, t in enumerate([*TEXTS, None, "y" * 50, "z z z"])]
    df = spark.createDataFrame([(t, i, 1, "k") for i, t in docs], "text string, doc_id long, range int, key string")
    assert sorted(tuple(r) for r in fp.fingerprints(df, ranges=ranges).collect()) == expected(docs)


@pytest.mark.parametrize("ranges", [1, 8])
def test_repeated_and_null_ids(spark, ranges):
    docs = [(5, f"text {i} " * 9) for i in range(40)] + [(5, "same " * 20)] * 30 + [(None, "none " * 8), (None, None), (9, "nine " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = fp.fingerprints(df, ranges=ranges).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in got if r["doc_id"]) == sorted((i, len(t)) for i, t in docs if i)
    assert len(got) == len(docs)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "abcdef" * 9)], "doc_id long, text string")
    assert [tuple(r) for r in fp.fingerprints(df).collect()] == expected([(1, "abcdef" * 9)])
    assert fp.fingerprints(df.limit(0)).count() == 0
