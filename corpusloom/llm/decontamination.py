"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of ten words of the benchmark items (all words of a
shorter item). Patterns of one length share a table of shifts: how far a search
may move ahead after seeing a pair of words. Where the shift is zero the pair
may end a pattern; the patterns that end with it are looked up by its hash and
compared with the text directly. Many stretches of text are searched in step,
so each move is one array operation. Documents are not moved: every task
searches its own rows.

Patterns are shipped to the tasks in portions of at most ``MAX_PATTERN_BYTES``
of item text; a larger benchmark is searched portion by portion, and each
document's hits are merged.

Defined cases: a null or empty text has no words and is clean; an item without
words gives no pattern; items without id are left out; equal items each count;
repeated documents each give a row; only the id and text columns are read, so
other columns may have any name; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import ALNUM, mix, words_of

WINDOW = 10
#: Item text whose patterns one task holds at a time.
MAX_PATTERN_BYTES = 16 << 20
_TABLE_BITS = 18
#: Words that one of the searches in step goes through.
_STRETCH = 512


@dataclass
class _Length:
    """Patterns of one length in words."""

    width: int
    hashes: np.ndarray
    words: list[bytes]
    items: list[list[str]]
    shift: np.ndarray = field(init=False)
    suffix: np.ndarray = field(init=False)
    bucket: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        block = min(2, self.width)
        self.shift = np.full(1 << _TABLE_BITS, self.width - block + 1, dtype=np.uint8)
        for end in range(block - 1, self.width):
            before = self.hashes[:, end - 1] if block == 2 else None
            np.minimum.at(self.shift, _slot(_pair(before, self.hashes[:, end])), self.width - 1 - end)
        last = _pair(self.hashes[:, -2] if block == 2 else None, self.hashes[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.suffix, first = np.unique(last[self.order], return_index=True)
        self.bucket = np.append(first, len(last))


def _pair(before: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    return mix(word if before is None else before * np.uint64(0x9E3779B97F4A7C15) + word)


def _slot(pair: np.ndarray) -> np.ndarray:
    return (pair >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[_Length]:
    """Search tables for ``(item id, text)`` rows, one per pattern length."""
    found: dict[int, dict[bytes, list]] = defaultdict(dict)
    words = words_of(pa.array([text for _, text in items], pa.large_string()), ALNUM, fold=True)
    hashes, first, raw = words.hashes(), words.first(), words.data.tobytes()
    for i, (item, _) in enumerate(items):
        low, high = first[i], first[i + 1]
        width = min(window, high - low)
        for at in range(low, high - width + 1 if width else low):
            key = b" ".join(raw[words.start[j] : words.end[j]] for j in range(at, at + width))
            ids = found[width].setdefault(key, [hashes[at : at + width], set()])[1]
            ids.add(item)
    return [
        _Length(int(width), np.array([h for h, _ in group.values()]), list(group), [sorted(ids) for _, ids in group.values()])
        for width, group in sorted(found.items())
    ]


def _candidates(table: _Length, hashes: np.ndarray) -> np.ndarray:
    """Numbers of the words that may end a pattern, by shifts."""
    n, block = len(hashes), min(2, table.width)
    begin = np.arange(table.width - 1, n, _STRETCH)
    stop = np.minimum(begin + _STRETCH, n)
    at, found = begin.copy(), []
    while len(at):
        shift = table.shift[_slot(_pair(hashes[at - 1] if block == 2 else None, hashes[at]))]
        found.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def search(column: pa.Array, patterns: list[_Length]) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """Per text: number of words, word ranges that patterns cover (merged), ids of items found."""
    words = words_of(column, ALNUM, fold=True)
    hashes, first = words.hashes(), words.first()
    covered = np.zeros(len(hashes) + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in range(words.n_texts)]
    for table in patterns:
        ends = _candidates(table, hashes)
        begins = ends - table.width + 1
        inside = words.text[begins] == words.text[ends] if len(ends) else np.zeros(0, dtype=bool)
        ends, begins = ends[inside], begins[inside]
        pair = _pair(hashes[ends - 1] if table.width > 1 else None, hashes[ends])
        bucket = np.minimum(np.searchsorted(table.suffix, pair), len(table.suffix) - 1)
        for i in np.flatnonzero(table.suffix[bucket] == pair):
            low, high = begins[i], ends[i]
            text = None
            for p in table.order[table.bucket[bucket[i]] : table.bucket[bucket[i] + 1]]:
                if not np.array_equal(table.hashes[p], hashes[low : high + 1]):
                    continue
                text = text or b" ".join(words.data[words.start[j] : words.end[j]].tobytes() for j in range(low, high + 1))
                if text == table.words[p]:
                    covered[low] += 1
                    covered[high + 1] -= 1
                    items[words.text[low]].update(table.items[p])
    inside = np.cumsum(covered[:-1]) > 0
    ranges = []
    for i in range(words.n_texts):
        own = np.flatnonzero(np.diff(np.concatenate([[0], inside[first[i] : first[i + 1]].view(np.int8), [0]])))
        ranges.append(own.reshape(-1, 2))
    return np.diff(first), ranges, items


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted ranges that do not touch, as one array of rows."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(ranges) - 1)]], axis=1)


def portions(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[bool, list[tuple[str, str | None]]]]:
    """The items in portions of about ``limit`` bytes, each of which the driver holds by itself, and whether it is the last."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // limit + 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        yield i == n - 1, [(r["id"], r["text"]) for r in part.toLocalIterator()]


def _search_pass(patterns: list[_Length], keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            counts, ranges, items = search(batch.column("text"), patterns)
            old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            spans, names = [], []
            for (have, ids), own, new in zip(old, ranges, items):
                both = np.concatenate([np.array(have or [], dtype=np.int64).reshape(-1, 2), own])
                spans.append((_merged(both) if len(both) else both).ravel().tolist())
                names.append(sorted({*(ids or ()), *new}))
            text = batch.column("text") if keep_text else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), text, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                ["id", "text", "n_words", "spans", "items"],
            )

    return run


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """One row per document: ``id_col, n_words, spans`` (word ranges [from, to) one after another), ``items`` (sorted)."""
    spark = docs.sparkSession
    tables.on_executors(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, text string, n_words long, spans array<int>, items array<string>"
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<int>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    for last, items in portions(benchmark, item_col, item_text_col, max_pattern_bytes):
        rows = rows.mapInArrow(_search_pass(compile_patterns(items, window), not last), shape)
        if not last:
            # One portion's tables at a time in a task.
            rows = tables.store(rows, "portion")
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """The documents, all columns, in which no pattern occurs."""
    tables.on_executors(docs.sparkSession)
    for last, items in portions(benchmark, item_col, item_text_col, max_pattern_bytes):
        patterns = compile_patterns(items, window)

        def run(batches: Iterator[pa.RecordBatch], patterns: list[_Length] = patterns) -> Iterator[pa.RecordBatch]:
            for batch in tables.slices(batches, text_col):
                found = search(batch.column(text_col), patterns)[2]
                yield batch.filter(pa.array([not x for x in found]))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = tables.store(docs, "portion")
    return docs


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark"))
    ends = "aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)"
    return found.select(
        "doc_id", "n_words", F.expr(ends).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
