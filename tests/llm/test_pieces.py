from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import pieces, tables


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


TEXTS = [
    None, "", " ", "  ", "a", "The cat  sat\n\non the mat.\n", "▁ literal ▁mark", "<0x0A> </s> <unk>", "é\U0001f600\U0010ffff ß\x00\t\r\n",
    "x" * 5000, "word " * 3000, "漢字かな 한글 العربية", " leading", "trailing ",
]


def test_round_trip_and_repeatability(spark, vocabulary):
    rows = [(i, t, "v", 0) for i, t in enumerate(TEXTS)]
    rows += [(None, "same text here", "v", 0), (4, "a", "v", 0), (4, "a", "v", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, piece_ids int")
    coded = pieces.encode(df, vocabulary=vocabulary)
    back = pieces.decode(coded, vocabulary=vocabulary).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)
    again = pieces.encode(df.repartition(3), vocabulary=vocabulary).collect()
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in again) == Counter((r["doc_id"], tuple(r["piece_ids"])) for r in back)
    assert pieces.encode(df.limit(0), vocabulary=vocabulary).count() == 0


def segmentations(stretch, lattices):
    """All of them, with their weights, by brute force."""
    if not stretch:
        return [((), 0.0)]
    out = []
    for n in range(1, len(stretch) + 1):
        w = lattices.weights.get(stretch[:n])
        options = [(lattices.vocabulary.ids[stretch[:n]], w)] if w is not None else []
        if n == 1 and stretch[0] not in lattices.vocabulary.ids:
            options.append((pieces._SPELT + ord(stretch[0]), lattices.spelling))
        for piece, w in options:
            out += [((piece, *rest), w + v) for rest, v in segmentations(stretch[n:], lattices)]
    return out


@pytest.mark.parametrize("text", ["the", "there", "a▁b"])
def test_draws_follow_the_weights(vocabulary, text):
    lattices = pieces.Lattices(vocabulary, 0.5)
    n = 20000
    ids, sizes = pieces.sample([text] * n, np.arange(n), lattices, 7)
    cuts = np.cumsum(sizes)[:-1]
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, cuts))
    spell = lambda s: tuple(b for p in s for b in (lattices.spelt(p) if p >= pieces._SPELT else [p]))
    every = segmentations(" " + text, lattices)
    total = sum(math.exp(w) for _, w in every)
    for s, w in every:
        p = math.exp(w) / total
        assert abs(seen[spell(s)] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert set(seen) <= {spell(s) for s, _ in every} and (len(seen) > 1 or "▁" in text)


def test_query_is_lossless(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in tables.read(spark, sf_dir, "documents").collect()}
    rows = pieces.op8(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_pieces"] == len(r["piece_ids"])


def test_foreign_ids_and_bytes(vocabulary):
    assert pieces.join([-1, 10**9, 1, 2], vocabulary) == "" and pieces.join([vocabulary.byte_ids[0xE9]], vocabulary) == "�"


def test_products_and_logarithms_give_the_same_lattices(vocabulary, monkeypatch):
    """Short stretches are summed as plain products, long ones and very uneven weights as logarithms; characters without a piece are spelt."""
    stretches = [" the", "ther中", "x\U0001f600͸yz", " qqqq", "͸" * 5, " the"]
    for many in ([s[:4] for s in stretches], [s * 16 for s in stretches if len(s) == 4], ["z"], ["\n"]):
        lattices = pieces.Lattices(vocabulary, 0.5)
        monkeypatch.setattr(pieces, "_PLAIN", 64)
        plain = lattices.build(many)
        monkeypatch.setattr(pieces, "_PLAIN", 0)
        by_logs = lattices.build(many)
        for a, b in zip(plain, by_logs, strict=True):
            np.testing.assert_allclose(a, b, rtol=0, atol=1e-9)
    monkeypatch.setattr(pieces, "_PLAIN", 64)
    steep = pieces.Lattices(vocabulary, 30.0)
    assert steep.spelling < -300 and np.isfinite(steep.build([" the" * 16])[0]).all()
    ids, _ = pieces.sample(["the" * 400, "͸" * 70], np.arange(2), pieces.Lattices(vocabulary, 0.5), 1)
    assert pieces.join(ids.tolist(), vocabulary) == "the" * 400 + " " + "͸" * 70
