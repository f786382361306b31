from __future__ import annotations

import zlib
from collections import Counter

from corpusloom.llm import sharding, tables

DOCS = [(i, f"text {i % 7}") for i in range(300)] + [(5, "same")] * 200 + [(None, None)] * 40 + [(None, "é")] * 3 + [(8, ""), (8, "x" * 9000)]


def check(rows, docs, shards):
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    want = Counter((i, len((t or "").encode()) + 16, crc(t)) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < shards
    shard = {}
    for r in rows:
        assert shard.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in tables.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows = sharding.op7(spark, sf_dir).collect()
    check(rows, docs, sharding.SHARDS)
    assert {r["law"] for r in rows} == {"key"}


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, shard int, rows int")
    for buckets in (1, 7, 1024):
        check(sharding.assign_shards(df, weights=(1.0,) * 5, buckets=buckets).collect(), DOCS, 5)
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_equal_rows_come_back_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    df = spark.createDataFrame([(i, t) for i, t in DOCS], "doc_id long, text string")
    check(sharding.assign_shards(df, weights=(1.0,) * 5).collect(), DOCS, 5)


def test_weights_and_growth(spark):
    keys = spark.range(20000).select("id")
    weights = (1.0, 2.0, 0.0, 5.0)
    old = {r["id"]: r["s"] for r in keys.select("id", sharding.shard_of("id", weights).alias("s")).collect()}
    share = Counter(old.values())
    assert share[2] == 0 and abs(share[1] / 20000 - 0.25) < 0.02 and abs(share[3] / 20000 - 0.625) < 0.02
    new = {r["id"]: r["s"] for r in keys.select("id", sharding.shard_of("id", (*weights, 2.0)).alias("s")).collect()}
    moved = [i for i in old if old[i] != new[i]]
    assert all(new[i] == 4 for i in moved) and abs(len(moved) / 20000 - 0.2) < 0.02
