from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality, tables


@pytest.fixture(scope="module")
def held_out(spark):
    """A model of half the labels of the given table, and its scores of the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    return model, rows


def test_held_out_accuracy(held_out):
    """Labels that the fit has not seen: junk goes, good documents stay."""
    _, rows = held_out
    good = [r["keep"] for r in rows if r["quality"] == 1]
    junk = [r["keep"] for r in rows if r["quality"] == 0]
    assert len(rows) > 1500 and np.mean(good) > 0.99 and np.mean(junk) < 0.1
    # Calibrated: the mean score is near the share of good documents.
    assert abs(np.mean([r["score"] for r in rows]) - len(good) / len(rows)) < 0.03


def test_both_views_teach_on_the_given_table(held_out):
    model, rows = held_out
    assert len(model.given) == quality.ROUNDS and all(min(given) > 0 for given in model.given)
    # Both views tell good from junk by themselves, and they do not say the same.
    label = np.array([r["quality"] for r in rows])
    scores = {c: np.array([r[c] for r in rows]) for c in ("text_score", "metadata_score", "score")}
    for c in ("text_score", "metadata_score"):
        assert scores[c][label == 1].mean() > scores[c][label == 0].mean() + 0.3
    assert any((scores["score"] >= 0.5) != (scores["text_score"] >= 0.5))


def test_both_views_together_beat_each(held_out):
    _, rows = held_out
    label = np.array([r["quality"] for r in rows])

    def loss(c):
        p = np.clip([r[c] for r in rows], 1e-6, 1 - 1e-6)
        return -np.mean(np.where(label == 1, np.log(p), np.log(1 - p)))

    wrong = {c: int(sum((r[c] >= 0.5) != (r["quality"] == 1) for r in rows)) for c in ("text_score", "metadata_score", "score")}
    assert wrong["score"] <= min(wrong.values()) and loss("score") < min(loss("text_score"), loss("metadata_score")), (wrong, loss("score"), loss("text_score"))


def test_query(spark, sf_dir):
    rows = quality.op3(spark, sf_dir).collect()
    again = {r["doc_id"]: r["score"] for r in quality.op3(spark, sf_dir).collect()}
    assert len(rows) == 200
    for r in rows:
        assert 0 <= r["text_score"] <= 1 and 0 <= r["metadata_score"] <= 1 and r["keep"] == (r["score"] >= 0.5) and r["status"] in (quality.FITTED, quality.TOO_FEW)
        assert r["score"] == pytest.approx(again[r["doc_id"]])


def array_pool(pool):
    """The surest of a pool in memory, by plain sorting."""
    left = np.ones(len(pool[0]), dtype=bool)

    def surest(weights, most):
        out, given = {}, np.zeros(len(left), dtype=bool)
        for i in (0, 1):
            odds = pool[i].astype(np.float64) @ weights[i]
            for kind in (0, 1):
                sure = np.where(left, odds if kind else -odds, -np.inf)
                best = np.argsort(-sure, kind="stable")[: most[kind]]
                best = best[left[best]]
                out[i, kind] = pool[0][best], pool[1][best]
                given[best] = True
        left[given] = False
        return out

    return surest


def test_views_teach_each_other():
    """A view without labels of use learns from the other's verdicts on the pool."""
    rng = np.random.default_rng(0)
    make = lambda y: np.column_stack([y + rng.normal(0, 0.5, len(y)), np.ones(len(y))])
    label = np.repeat([0.0, 1.0], 40)
    hidden = rng.integers(0, 2, 4000).astype(float)
    # The second view's labelled features say nothing about the label.
    views = (np.column_stack([label + rng.normal(0, 0.2, 80), np.ones(80)]), make(rng.permutation(label)))
    pool = (np.column_stack([hidden + rng.normal(0, 0.2, 4000), np.ones(4000)]), make(hidden))
    before, after = quality.co_train(views, label, array_pool(pool), rounds=0), quality.co_train(views, label, array_pool(pool), rounds=5)
    test = rng.integers(0, 2, 4000).astype(float)
    x = make(test)
    right = [np.mean((x @ m.views[1] > 0) == (test == 1)) for m in (before, after)]
    assert right[1] > 0.7 and right[1] > right[0] + 0.1


def test_rounds_take_the_surest_of_all_documents(spark, sf_dir):
    """Against plain sorting of all features; none is taken twice, whatever the number of tasks."""
    docs = tables.read(spark, sf_dir, "documents")
    stored = tables.store(quality.features(docs), "test-features")
    rows = sorted(stored.collect(), key=lambda r: r["doc_id"] if "doc_id" in r else r["id"])
    views = [np.stack([np.frombuffer(r[c], dtype=np.float16).astype(np.float32) for r in rows]) for c in ("text_view", "meta_view")]
    weights = [np.random.default_rng(i).normal(0, 1, v.shape[1]) for i, v in enumerate(views)]
    taken = {rows[0]["id"], rows[5]["id"]}
    most = {1: 9, 0: 4}
    pool = quality._Pool(stored.repartition(7), set(taken))
    for _ in range(3):
        found = pool(weights, most)
        now = set()
        for view in (0, 1):
            odds = np.round(views[view].astype(np.float64) @ weights[view], 9)
            for kind in (0, 1):
                sure = odds if kind else np.round(-odds, 9)
                order = sorted((i for i in range(len(rows)) if rows[i]["id"] not in taken), key=lambda i: (-sure[i], rows[i]["draw"]))[: most[kind]]
                assert np.array_equal(found[view, kind][0], views[0][order]) and np.array_equal(found[view, kind][1], views[1][order])
                now |= {rows[i]["id"] for i in order}
        taken |= now


def test_form_features():
    texts = ["Ab, c!\n\nxyz\n", None, "", "é é\n9", "a" * 10]
    got = quality.form_features(pa.array(texts))
    for row, text in zip(got, texts):
        raw = (text or "").encode()
        share = lambda test: sum(map(test, raw)) / max(1, len(raw))  # noqa: B023, E731
        want = [share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b == 32 or 9 <= b <= 13), share(lambda b: b >= 128)]
        assert np.allclose(row[4:8], np.sqrt(want)) and row[0] == pytest.approx(np.log1p(len(raw)) / 10)
    assert got[0][1] == pytest.approx(np.log1p(4) / 5) and got[4][3] == pytest.approx(np.log1p(10) / 10)


DOCS = [(i, t, s, n) for i, (t, s, n) in enumerate([(None, None, None), ("", "s", 0), ("a b", "s", 3), ("é " * 9000, None, -5), ("###", "x", 3), ("a\x00b", "", 1)] * 5)]
SHAPE = "doc_id long, text string, src string, size long"


def test_edge_cases(spark):
    df = spark.createDataFrame([*DOCS, (None, "a b", "s", 3), (2, "a b", "s", 3)], SHAPE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 1), (4, 1), (999, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, meta=("src", "size"))
    rows = quality.score_documents(df, model, meta=("src", "size")).collect()
    assert len(rows) == 32 and model.views is not None
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    kept = quality.good_documents(df.withColumn("keep", df.size), model, meta=("src", "size"))
    assert kept.columns == [*df.columns, "keep"] and kept.count() == sum(r["keep"] for r in rows)
    assert quality.score_documents(df.limit(0), model, meta=("src", "size")).count() == 0


def test_without_labels_all_are_kept(spark):
    df = spark.createDataFrame(DOCS, SHAPE)
    for labels in ([], [(i, 1) for i in range(30)]):
        with pytest.warns(UserWarning, match="every document is kept"):
            model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int"), meta=("src", "size"))
        assert quality.good_documents(df, model, meta=("src", "size")).count() == 30
        assert model.status == quality.TOO_FEW
        assert {r["status"] for r in quality.score_documents(df, model, meta=("src", "size")).collect()} == {quality.TOO_FEW}


def test_labels_without_document_are_not_drawn(spark):
    """Few documents among many labels: the draw must still meet enough of them."""
    df = spark.createDataFrame(DOCS, SHAPE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    assert quality.train(df, labels, meta=("src", "size"), max_labelled=40).views is not None


def test_one_row_of_an_id_is_fitted_to(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda views, label, pool, rounds, given: seen.append((len(label), len(pool._taken))))
    df = spark.createDataFrame([*DOCS, *[(3, f"hot {i}", "s", i) for i in range(300)], *[(29, "hot", "s", i) for i in range(300)]], SHAPE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    quality.train(df.repartition(5), labels, meta=("src", "size"))
    assert seen == [(20, 20)]
