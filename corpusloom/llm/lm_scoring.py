"""LM scoring: a word bigram model by deleted interpolation.

p(w | h) = a * c(h w) / c(h) + b * c(w) / N + c * 1 / (V + 1), with weights
that depend on the frequency of the context h (one set for each power of two)
and are learned by expectation-maximisation: the model counted without a
deleted part of the training documents is fitted to that part. Scores then use
the counts of all training documents.

Counts meet documents without a row per token:

1. Documents are packed into batches of about ``BATCH_TOKENS`` tokens, each with
   its own list of words; batches are stored.
2. Each batch asks for the counts of its distinct words and word pairs, in
   ranges of their 63-bit hashes; it brings its own counts along.
3. A task adds up one range at a time and answers each batch in the order asked.
4. A batch joins its answers and scores its documents.

So a very common word costs a batch one entry, no list of words is sent to all
tasks, and what travels grows with the distinct pairs of a batch. The weights
are fitted to a table of probabilities in steps of a quarter octave, with the
mean of each step: at most ``CELLS`` rows, whatever the input.

Defined cases: a null or empty text is its end token alone; a null id is in the
training part and kept; repeated ids and rows are documents by themselves; only
the id and text columns are read; with no training document at all every score
is that of the unknown word; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import mix, words_of

#: Parts of the documents, by remainder: counted, deleted (for the weights), held out (only scored).
COUNTED, DELETED, HELD_OUT = 0, 1, 2
PARTS, HELD_REMAINDER, DELETED_REMAINDER = 7, 2, 3
BATCH_TOKENS = 1 << 20
#: Tokens of the corpus for each range of hashes.
RANGE_TOKENS = 2 << 20
MAX_RANGES = 1 << 20
#: Context classes times probability steps of word and pair, the most rows the driver reads.
CLASSES, STEPS = 48, 200
CELLS = CLASSES * STEPS * STEPS
ROUNDS = 60

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xD6E8FEB86659FD93)

_BATCH = "batch string, part int, n_tokens long, ids binary, sizes binary, vocabulary binary, tokens binary"
_ASK = "range int, batch string, part int, n int, keys binary, counts binary"
_ANSWER = "range int, batch string, part int, counts binary, counted binary, n_types long, n_tokens long, n_counted long"
_SCORE = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _deflate(values: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, then zstd."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _inflate(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _pack(part: int, name: str, held: list[tuple[np.ndarray, ...]]) -> dict:
    ids, sizes, tokens = (np.concatenate(x) for x in zip(*held))
    words, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), dtype=np.uint32)
    rank[order] = np.arange(len(order))
    return {
        "batch": name, "part": part, "n_tokens": len(tokens), "ids": _deflate(ids), "sizes": _deflate(sizes),
        "vocabulary": _deflate(words[order]), "tokens": _deflate(rank[place]),
    }


_BATCH_ARROW = pa.schema(
    [("batch", pa.string()), ("part", pa.int32()), ("n_tokens", pa.int64()), *[(n, pa.binary()) for n in ("ids", "sizes", "vocabulary", "tokens")]]
)


def _batches(limit: int):
    """Packs the documents of a task, each part by itself. A null id is kept as the smallest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {COUNTED: [], DELETED: [], HELD_OUT: []}
        size, number, task = dict.fromkeys(held, 0), 0, TaskContext.get().partitionId()
        for batch in tables.slices(batches, "text"):
            words = words_of(batch.column("text"), fold=True)
            first, n = words.first(), words.n_texts
            tokens = np.empty(len(words.start) + n, dtype=np.uint64)
            tokens[np.arange(len(words.start)) + words.text] = words.hashes()
            tokens[first[1:] + np.arange(n)] = _END
            sizes = np.diff(first) + 1
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "part"))
            for part in held:
                own = parts == part
                if own.any():
                    held[part].append((ids[own], sizes[own].astype(np.int64), tokens[np.repeat(own, sizes)]))
                    size[part] += int(sizes[own].sum())
                if size[part] >= limit:
                    yield pa.RecordBatch.from_pylist([_pack(part, f"{task}-{number}", held[part])], schema=_BATCH_ARROW)
                    held[part], size[part], number = [], 0, number + 1
        for part, rest in held.items():
            if rest:
                yield pa.RecordBatch.from_pylist([_pack(part, f"{task}-{number}", rest)], schema=_BATCH_ARROW)
                number += 1

    return run


class _Batch:
    """A batch with the keys of its distinct words (odd) and word pairs (even), sorted by key."""

    def __init__(self, row: dict) -> None:
        self.ids, self.sizes = _inflate(row["ids"], np.int64), _inflate(row["sizes"], np.int64)
        self.words, self.tokens = _inflate(row["vocabulary"], np.uint64), _inflate(row["tokens"], np.uint32)
        self.first = np.cumsum(self.sizes) - self.sizes
        start = len(self.words)
        names = np.append(self.words, _START)
        before = np.empty(len(self.tokens), dtype=np.uint64)
        before[1:] = self.tokens[:-1]
        before[self.first] = start
        self.before = before
        pairs, self.pair, n_pairs = np.unique(before * np.uint64(start + 1) + self.tokens, return_inverse=True, return_counts=True)
        a, b = names[(pairs // np.uint64(start + 1)).astype(np.int64)], names[(pairs % np.uint64(start + 1)).astype(np.int64)]
        keys = np.concatenate([mix(self.words) | np.uint64(1), mix(a * _PAIR + b) & ~np.uint64(1)])
        counts = np.concatenate([np.bincount(self.tokens, minlength=start), n_pairs])
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], counts[self.order]

    def spread(self, sorted_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of pair, context and word for each token, from answers in the order of the keys."""
        own = np.empty(len(self.keys), dtype=np.int64)
        own[self.order] = sorted_counts
        words, pairs = own[: len(self.words)], own[len(self.words) :]
        # A document's start is followed by one token, as often as there are ends.
        end = words[self.words == _END]
        context = np.append(words, end[0] if len(end) else 0)
        return pairs[self.pair], context[self.before.astype(np.int64)], words[self.tokens]


def _asks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                batch = _Batch(row)
                counts = batch.counts if row["part"] != HELD_OUT else np.zeros_like(batch.counts)
                place = _range_of(batch.keys, ranges)
                found, first = np.unique(place, return_index=True)
                out = []
                for r, low, high in zip(found.tolist(), first, np.append(first[1:], len(place))):
                    keys = np.diff(batch.keys[low:high], prepend=np.uint64(0))
                    out.append({
                        "range": r, "batch": row["batch"], "part": row["part"], "n": int(high - low), "keys": _deflate(keys),
                        "counts": _deflate(counts[low:high].astype(np.uint32)),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_ASK_ARROW)

    return run


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_ASK_ARROW = pa.schema([("range", pa.int32()), ("batch", pa.string()), ("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER_ARROW = pa.schema(
    [("range", pa.int32()), ("batch", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("counted", pa.binary()),
     *[(n, pa.int64()) for n in ("n_types", "n_tokens", "n_counted")]]
)


def _answer(held: list[dict]) -> pa.RecordBatch:
    keys = [np.cumsum(_inflate(r["keys"], np.uint64), dtype=np.uint64) for r in held]
    counts = [_inflate(r["counts"], np.uint32).astype(np.int64) for r in held]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate(counts)
    deleted = np.repeat([r["part"] == DELETED for r in held], [len(k) for k in keys])
    total = np.bincount(place, weights=n, minlength=len(every)).astype(np.int64)
    counted = np.bincount(place, weights=n * ~deleted, minlength=len(every)).astype(np.int64)
    out, at = [], 0
    for row, own in zip(held, keys):
        where = place[at : at + len(own)]
        at += len(own)
        out.append({
            "range": row["range"], "batch": row["batch"], "part": row["part"], "counts": _deflate(total[where]),
            "counted": _deflate(counted[where]) if row["part"] == DELETED else None,
        })
    word = (every & np.uint64(1)) == 1
    out.append({
        "range": held[0]["range"], "n_types": int((total[word] > 0).sum()), "n_tokens": int(total[word].sum()),
        "n_counted": int(counted[word].sum()),
    })
    return pa.RecordBatch.from_pylist(out, schema=_ANSWER_ARROW)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range; one range is held at a time."""
    held: list[dict] = []
    for rows in batches:
        for row in rows.to_pylist():
            if held and held[0]["range"] != row["range"]:
                yield _answer(held)
                held = []
            held.append(row)
    if held:
        yield _answer(held)


def _class_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one class for each power of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], CLASSES - 1)


def _parts(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(total, 1)


def _joined(row: dict, field: str) -> tuple[_Batch, np.ndarray]:
    batch = _Batch(row)
    return batch, np.concatenate([_inflate(a[field], np.int64) for a in sorted(row["answers"], key=lambda a: a["range"])])


def _cells(n_counted: int):
    """Tokens of the deleted part by context class and steps of pair and word probability."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.clip(np.round(4 * np.log2(np.maximum(p, 1e-300))) + STEPS - 1, 0, STEPS - 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                batch, counts = _joined(rows.slice(i, 1).to_pylist()[0], "counted")
                pair, context, word = batch.spread(counts)
                p2, p1 = _parts(pair, context, word, n_counted)
                cell, place, n = np.unique((_class_of(context) * STEPS + step(p2)) * STEPS + step(p1), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(n), pa.array(np.bincount(place, weights=p2)), pa.array(np.bincount(place, weights=p1))],
                    ["cell", "n", "p2", "p1"],
                )

    return run


def fit_weights(cell: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, n_types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and unknown for each context class. A class without data weighs all alike."""
    p = np.stack([p2, p1, np.full(len(n), 1 / (n_types + 1))], axis=1)
    weights = np.full((CLASSES, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]  # an unseen context has no pairs
    owner = cell // (STEPS * STEPS)
    for _ in range(rounds):
        share = weights[owner] * p
        share *= (n / share.sum(axis=1))[:, None]
        # One token of each kind is added, so no weight that is needed becomes zero.
        gained = np.stack([np.bincount(owner, weights=share[:, j], minlength=CLASSES) for j in range(3)], axis=1) + 1
        gained[0, 0] = 0
        weights = gained / gained.sum(axis=1, keepdims=True)
    return weights


def _scores(total: int, n_types: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                batch, counts = _joined(row, "counts")
                pair, context, word = batch.spread(counts)
                p2, p1 = _parts(pair, context, word, total)
                w = weights[_class_of(context)]
                model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (n_types + 1))
                base = np.log10((word + 1) / (total + n_types + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.ids), pa.array(np.full(len(batch.ids), row["part"] == HELD_OUT)), pa.array(batch.sizes),
                        *[pa.array(np.add.reduceat(x, batch.first)) for x in ((word > 0).astype(np.int64), base, model)],
                    ],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def part_of(id_col: str) -> Column:
    """The part of a document, from the CRC-32 of its id as text; a null id is counted."""
    rest = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % PARTS
    return F.when(rest == HELD_REMAINDER, HELD_OUT).when(rest == DELETED_REMAINDER, DELETED).otherwise(COUNTED)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = BATCH_TOKENS, range_tokens: int = RANGE_TOKENS
) -> DataFrame:
    """One row per document: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``id_col`` is an integer."""
    tables.on_executors(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), part_of(id_col).alias("part"), F.col(text_col).alias("text"))
    packed = tables.store(rows.mapInArrow(_batches(batch_tokens), _BATCH), "token-batches")
    size = packed.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = int(min(MAX_RANGES, size // range_tokens + 1))
    answers = tables.store(
        packed.mapInArrow(_asks(ranges), _ASK).repartition("range").sortWithinPartitions("range").mapInArrow(_answers, _ANSWER), "count-answers"
    )
    n_types, total, n_counted = (x or 0 for x in answers.agg(F.sum("n_types"), F.sum("n_tokens"), F.sum("n_counted")).first())

    def joined(part: Column, field: str) -> DataFrame:
        mine = answers.where(F.col("batch").isNotNull() & part).groupBy("batch").agg(F.collect_list(F.struct("range", field)).alias("answers"))
        return packed.where(part).join(mine, "batch")

    cells = joined(F.col("part") == DELETED, "counted").mapInArrow(_cells(n_counted), "cell long, n long, p2 double, p1 double")
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "p2", "p1")]).toArrow()
    cell, n, p2, p1 = (cells.column(c).to_numpy() for c in ("cell", "n", "p2", "p1"))
    weights = fit_weights(cell, n, p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), n_types)
    scored = joined(F.lit(True), "counts").mapInArrow(_scores(total, n_types, weights), _SCORE)
    return scored.select(
        F.when(F.col("id") != least, F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(tables.read(spark, sf_dir, "documents"))
