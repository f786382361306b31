from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing, tables


def ids_of(texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {t: [*encoder.encode(t or "", add_special_tokens=False).ids, 1] for t in set(texts)}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check(rows, docs, step=packing.STEP):
    """Every id in one piece, checksums, gapless windows of powers of two, equal step groups."""
    ids = ids_of(t for _, t in docs)
    want, got = Counter(), Counter()
    kinds = defaultdict(list)
    for i, t in docs:
        kinds[(i, len(ids[t]))].append(ids[t])
    windows = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        got[(r["doc_id"], r["doc_tokens"])] += r["length"]
    for i, t in docs:
        want[(i, len(ids[t]))] += len(ids[t])
    assert got == want
    for key, pieces in by_doc.items():
        # Rows of equal id and length: each position is covered as often as there are rows, by some of their ids.
        cover = Counter()
        for p in pieces:
            assert p["ids_crc32"] in {crc(x[p["start"] : p["start"] + p["length"]]) for x in kinds[key]}
            cover.update(range(p["start"], p["start"] + p["length"]))
        assert set(cover.values()) == {len(kinds[key])} and len(cover) == key[1]
    assert sorted(windows) == list(range(len(windows)))
    steps = defaultdict(list)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        filled = 0
        for r in w:
            assert r["offset"] == filled
            filled += r["length"]
        assert filled & (filled - 1) == 0 and filled <= 2048 and {r["tier"] for r in w} == {filled}
        assert len({r["step"] for r in w}) == 1
        steps[w[0]["step"]].append(filled)
    assert sorted(steps) == list(range(len(steps)))
    last = {sizes[0]: at for at, sizes in sorted(steps.items())}
    for at, sizes in steps.items():
        assert len(set(sizes)) == 1 and (sum(sizes) == step or at == last[sizes[0]])
    return windows


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    windows = check(packing.op11(spark, sf_dir).collect(), docs)
    # Whole windows of the tiers hold nearly all ids; one open window per task is cut.
    short = sum(w[0]["tier"] for w in windows.values() if w[0]["tier"] < 256)
    assert short < 256 * 4 and {w[0]["tier"] for w in windows.values()} >= {2048}


def test_step_groups_have_like_work(spark):
    rows = packing.op11(spark, "/root/testdata/sf0.01").collect()
    work = defaultdict(lambda: defaultdict(int))
    for r in rows:
        work[(r["tier"], r["step"])][r["sequence_id"]] += r["length"] ** 2
    spans = [max(w.values()) - min(w.values()) for (tier, _), w in work.items() if tier == 2048]
    everywhere = [x for (tier, _), w in work.items() if tier == 2048 for x in w.values()]
    assert len(spans) > 5 and np.median(spans) < 0.25 * (max(everywhere) - min(everywhere))


DOCS = [(i, t) for i, t in enumerate([None, "", "a", "<|endoftext|>", "x<|endoftext|> y", "é\U0001f600 \n\t", "word " * 5000, "tail of " * 300] * 6)]
DOCS += [(3, "same text " * 20)] * 40 + [(None, None)] * 5 + [(None, "no id")] * 2


@pytest.mark.parametrize("block", [1, 5000, packing.BLOCK])
def test_edge_cases(spark, block):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in DOCS], "doc_id long, text string, start int, tokens string, task int")
    check(packing.pack_documents(df.repartition(3), block=block, step=4096).collect(), DOCS, 4096)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_rejects_other_tiers(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tiers=(2000, 1000))


def test_pack_is_whole_and_prefers_whole_pieces():
    rng = random.Random(3)
    for _ in range(30):
        pieces = [(d, 0, rng.choice([rng.randrange(1, 300), rng.randrange(1, 6000)])) for d in range(rng.randrange(1, 200))]
        windows, rest = packing.pack(pieces)
        assert {sum(p[2] for p in w) for w in windows} <= set(packing.TIERS) and sum(p[2] for p in rest) < 2048
        cover = defaultdict(list)
        for d, s, n in [p for w in windows + packing.at_powers(rest) for p in w]:
            cover[d].append((s, n))
        for d, _, n in pieces:
            at = 0
            for s, m in sorted(cover[d]):
                assert s == at and m > 0
                at += m
            assert at == n


def test_ranks_give_the_ids_of_the_vocabulary(spark):
    texts = [r["text"] for r in tables.read(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    texts += ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\u00a0\u00e9\u0130\u024f \u0250", "\u4e2d\u6587 \U0001f600", "x" * 5000, " " * 5000, "I'll I'LL 12,3\x00\x1c\x85"]
    want = ids_of(texts)
    assert [x.tolist() for x in packing.tokenizer()(texts)] == [want[t] for t in texts]


def test_gaps_are_filled_from_shorter_tiers():
    windows, rest = packing.pack([(0, 0, 1500), (1, 0, 500), (2, 0, 48), (3, 0, 256)])
    assert sorted(sorted(p[0] for p in w) for w in windows) == [[0, 1, 2], [3]] and rest == []
