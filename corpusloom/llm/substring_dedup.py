"""Substring dedup: windows of words that also occur in an earlier document, by super-k-mer partitioning.

Each window of ``window`` words has a minimiser, the smallest hash of its runs
of ``MINIMISER`` words. Consecutive windows with the same minimiser are one
super-k-mer, which travels as one packed string to the bucket of its minimiser;
equal windows meet there, and sorting the windows' 128-bit keys counts them
exactly.

1. Minimisers that occur in two documents at least are found by aggregation
   (combined before the shuffle). Other super-k-mers cannot repeat and stay.
2. Super-k-mers with such a minimiser are packed and sent to their bucket.
3. A bucket marks the windows whose smallest document id is another's.
4. Each document drops the words under its marked windows.

A minimiser with more than ``HOT_RUNS`` super-k-mers has no bucket: its windows
are keyed one by one and aggregated, so a task never holds more than one
bucket's bounded group. Nothing is left out.

Defined cases: a null text has no words; a text of fewer words than a window
is kept as it is; a null document id counts as the largest; rows with equal id
are judged by themselves and never remove each other; only the id and text
columns are read, so other columns may have any name; an empty table gives no
rows. Removed words leave the rest joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import mix, sliding_min, window_hashes, words_of

WINDOW = 50
#: Words of a minimiser.
MINIMISER = 10
#: Super-k-mers that one bucket group may have.
HOT_RUNS = 50_000
#: Packed bytes that a bucket task works on at a time, whole groups.
CHUNK_BYTES = 4 << 20
_LAST = (1 << 63) - 1

_RUN = "minimiser long, owner long, text_hash long"
_PACKED = "minimiser long, second long, owner long, text_hash long, at int, packed binary"
_RANGE = "owner long, text_hash long, low int, high int"


def _super_kmers(words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each super-k-mer."""
    hashes = words.hashes()
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding_min(window_hashes(hashes, minimiser), window - minimiser + 1)
    valid = words.text[:n] == words.text[window - 1 :]
    joined = valid[1:] & valid[:-1] & (words.text[1:n] == words.text[: n - 1]) & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(valid & ~np.concatenate([joined, [False]]))
    return first, last, least[first]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _runs(window: int, minimiser: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            words = words_of(batch.column("text"))
            first, _, least = _super_kmers(words, window, minimiser)
            doc = words.text[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(least.view(np.int64)), pa.array(_column(batch, "owner")[doc]), pa.array(_column(batch, "text_hash")[doc])],
                ["minimiser", "owner", "text_hash"],
            )

    return run


def _window_keys(words, window: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(words.hashes(0), window), window_hashes(words.hashes(1), window)


def _member(values: np.ndarray, group: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its group."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), sizes).astype(np.uint64)
    salt = np.uint64(0xD6E8FEB86659FD93)
    return np.isin(mix(values + group.astype(np.uint64) * salt), mix(flat + owner * salt))


def _pack(window: int, minimiser: int):
    """Packed super-k-mers of shared minimisers; windows one by one (no packed string) of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            words = words_of(batch.column("text"))
            first, last, least = _super_kmers(words, window, minimiser)
            doc = words.text[first]
            own = words.first()
            owner, text_hash = _column(batch, "owner"), _column(batch, "text_hash")
            cold = _member(least, doc, batch.column("cold"))
            raw = words.data.tobytes()
            packed = [
                b" ".join(raw[words.start[j] : words.end[j]] for j in range(a, b + window))
                for a, b in zip(first[cold].tolist(), last[cold].tolist())
            ]
            d = doc[cold]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least[cold].view(np.int64)), pa.nulls(len(d), pa.int64()), pa.array(owner[d]), pa.array(text_hash[d]),
                    pa.array((first[cold] - own[d]).astype(np.int32)), pa.array(packed, pa.binary()),
                ],
                ["minimiser", "second", "owner", "text_hash", "at", "packed"],
            )
            hot = _member(least, doc, batch.column("hot"))
            if hot.any():
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first[hot], last[hot])])
                keys, more = _window_keys(words, window)
                d = words.text[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at].view(np.int64)), pa.array(more[at].view(np.int64)), pa.array(owner[d]), pa.array(text_hash[d]),
                        pa.array((at - own[d]).astype(np.int32)), pa.nulls(len(at), pa.binary()),
                    ],
                    ["minimiser", "second", "owner", "text_hash", "at", "packed"],
                )

    return run


def _marked(table: pa.Table, window: int) -> pa.RecordBatch:
    """Word ranges under windows whose smallest owner is another's; ``table`` has whole minimiser groups."""
    words = words_of(table.column("packed").combine_chunks())
    owner = table.column("owner").to_numpy()
    n = len(words.start) - window + 1
    keys, more = _window_keys(words, window)
    at = np.flatnonzero(words.text[: max(n, 0)] == words.text[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    keys, more, mine = keys[at], more[at], owner[words.text[at]]
    order = np.lexsort((mine, more, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    least = mine[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    marked = np.sort(at[order][mine[order] > least])
    string = words.text[marked]
    new = np.ones(len(marked), dtype=bool)
    new[1:] = (marked[1:] != marked[:-1] + 1) | (string[1:] != string[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(marked))[: len(low)] - 1
    s = string[low]
    base = table.column("at").to_numpy()[s] - words.first()[s]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(owner[s]), pa.array(table.column("text_hash").to_numpy()[s]),
            pa.array((marked[low] + base).astype(np.int32)), pa.array((marked[high] + base + window).astype(np.int32)),
        ],
        ["owner", "text_hash", "low", "high"],
    )


def _buckets(window: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in tables.slices(batches, "packed", chunk_bytes):
            keys = _column(batch, "minimiser")
            # Rows are sorted by minimiser: all before the last one's group are whole groups.
            cut = int(np.searchsorted(keys == keys[-1], True))
            if cut or (held and _column(held[-1], "minimiser")[-1] != keys[-1]):
                yield _marked(pa.Table.from_batches([*held, batch.slice(0, cut)]), window)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _marked(pa.Table.from_batches(held), window)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tables.slices(batches, "text"):
        kept, n_words, n_removed = [], [], []
        ranges = batch.column("ranges").to_pylist()
        for text, own in zip(tables.strings(batch.column("text")).to_pylist(), ranges):
            words = text.encode().split()  # the same white space as in words.PLAIN
            n_words.append(len(words))
            if own:
                inside = np.zeros(len(words) + 1, dtype=np.int32)
                for r in own:
                    inside[r["low"]] += 1
                    inside[r["high"]] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER,
    hot_runs: int = HOT_RUNS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_removed, kept_text``. ``id_col`` is an integer."""
    tables.on_executors(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select(
        "id", F.coalesce("id", F.lit(_LAST)).alias("owner"), F.xxhash64("text").alias("text_hash"), "text"
    )
    runs = rows.select("owner", "text_hash", "text").mapInArrow(_runs(window, minimiser), _RUN)
    shared = tables.store(
        runs.groupBy("minimiser")
        .agg(F.count("*").alias("n"), F.min("owner").alias("least"), F.max("owner").alias("most"))
        .where("least < most")
        .select("minimiser", (F.col("n") > hot_runs).alias("is_hot")),
        "shared-minimisers",
    )
    mine = (
        runs.join(shared, "minimiser")
        .groupBy("owner", "text_hash")
        .agg(
            F.collect_set(F.when(~F.col("is_hot"), F.col("minimiser"))).alias("cold"),
            F.collect_set(F.when(F.col("is_hot"), F.col("minimiser"))).alias("hot"),
        )
    )
    # A third of the documents may share one id and text: they are one row here.
    texts = rows.select("owner", "text_hash", "text")
    sent = (
        texts.join(mine, ["owner", "text_hash"])
        .dropDuplicates(["owner", "text_hash"])
        .mapInArrow(_pack(window, minimiser), _PACKED)
    )
    marked = (
        sent.where("packed is not null")
        .drop("second")
        .repartition("minimiser")
        .sortWithinPartitions("minimiser")
        .mapInArrow(_buckets(window, chunk_bytes), _RANGE)
    )
    if not shared.where("is_hot").isEmpty():
        single = sent.where("packed is null").drop("packed")
        least = single.groupBy("minimiser", "second").agg(F.min("owner").alias("least"))
        late = single.join(least, ["minimiser", "second"]).where("owner > least")
        marked = marked.unionByName(
            late.select("owner", "text_hash", F.col("at").alias("low"), (F.col("at") + window).cast("int").alias("high"))
        )
    ranges = tables.store(
        marked.groupBy("owner", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("ranges")), "repeat-ranges"
    )
    kept = rows.join(ranges, ["owner", "text_hash"], "left").select("id", "text", "ranges")
    return kept.mapInArrow(_keep, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(tables.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
