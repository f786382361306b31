"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash; of each ``WINDOW``
consecutive hashes the smallest is chosen, the rightmost of equal ones. Any
match of GRAM + WINDOW - 1 code points or more is therefore seen, and each
chosen hash keeps its position. A fingerprint is the base64 text of five bytes
per chosen hash: its distance from the one before, and its 32-bit value.

The edited text of a document needs the head of the next one. Documents are
dealt over ranges of the id, each range is streamed in order with one row held
back, and the first row of every range is also sent to the range before: texts
move once, and a task holds two of them.

Defined cases: a null text is empty, and an empty text has an empty
fingerprint; a text shorter than a gram is one gram, and one with fewer grams
than a window is one window; equal texts have equal fingerprints; two empty
fingerprints are alike (1), an empty and another are not (0); ids may repeat:
rows of one id follow each other by a hash of their text, and a range of one id
alone is split by that hash; a null id counts as the smallest; a single row is
its own next; only the id and text columns are read; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import mix

GRAM = 16
WINDOW = 32
#: Ids drawn to place the cuts between ranges, and the most ranges there are.
CUT_SAMPLE = 100_000
MAX_RANGES = 4096
_FIRST = -(1 << 63)

_SHAPE = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values, by joining runs of half the width."""
    base = 0x9E3779B97F4A7C15 | 1
    hashes, span, power = mix(values.astype(np.uint64) + np.uint64(1)), 1, base
    total, done = None, 0
    rest = width
    while True:
        if rest & 1:
            # A run of ``done`` values is followed by one of ``span``.
            total = hashes if total is None else total[: len(hashes) - done] * np.uint64(power) + hashes[done:]
            done += span
        rest >>= 1
        if not rest:
            return mix(total[: len(values) - width + 1])
        hashes = hashes[:-span] * np.uint64(power) + hashes[span:]
        span, power = span * 2, power * power % (1 << 64)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the chosen grams, by position."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    hashes = _rolling(points, min(gram, len(points)))
    window = min(window, len(hashes))
    least, at, span = hashes, np.arange(len(hashes)), 1
    while span < window:
        step = min(span, window - span)
        right = least[step:] <= least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, (hashes[at] >> np.uint64(32)).astype(np.uint32)


def encode(at: np.ndarray, hashes: np.ndarray) -> str:
    """Consecutive positions are at most a window apart, so a distance takes a byte."""
    out = np.empty((len(at), 5), dtype=np.uint8)
    out[:, 0] = np.diff(at, prepend=0)
    out[:, 1:] = hashes.astype("<u4").view(np.uint8).reshape(-1, 4)
    return base64.b64encode(out.tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 5)
    return np.cumsum(rows[:, 0].astype(np.int64)), np.ascontiguousarray(rows[:, 1:]).view("<u4").ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes (each sorted, without repeats)."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


class _Held:
    """A document that waits for the next."""

    def __init__(self, doc: int | None, text: str | None) -> None:
        self.doc, self.text = doc, text or ""
        at, hashes = winnow(self.text)
        self.fingerprint, self.set = encode(at, hashes), np.unique(hashes)

    def row(self, after: _Held) -> tuple:
        half = len(self.text) // 2
        edited = self.text[: len(self.text) - half] + after.text[:half]
        at, hashes = winnow(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return (
            self.doc, len(self.text), digest, self.fingerprint, encode(at, hashes),
            likeness(self.set, np.unique(hashes)), likeness(self.set, after.set),
        )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; a range ends with the row that follows its last (``follows``)."""
    names = [c.split(" ")[0] for c in _SHAPE.split(", ")]
    held = None
    for batch in tables.slices(batches, "text"):
        rows = []
        columns = [batch.column(n).to_pylist() for n in ("doc", "text", "follows")]
        for doc, text, follows in zip(*columns):
            if follows:
                # Equal rows that begin a range may all be sent on: the first is enough.
                if held is not None:
                    rows.append(held.row(_Held(doc, text)))
                held = None
                continue
            now = _Held(doc, text)
            if held is not None:
                rows.append(held.row(now))
            held = now
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_ARROW)


_ARROW = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _cuts(ids: DataFrame, ranges: int) -> np.ndarray:
    """Ascending ids between the ranges, from a sample of bounded size; an id of many rows may appear often."""
    n = ids.count()
    part = ids if n <= CUT_SAMPLE else ids.sample(fraction=CUT_SAMPLE / n, seed=7)
    drawn = np.sort(part.toArrow().column(0).to_numpy())
    return drawn[np.linspace(0, len(drawn), ranges + 1).astype(int)[1:-1]] if len(drawn) else drawn


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    spark = docs.sparkSession
    tables.on_executors(spark)
    ranges = min(MAX_RANGES, ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.select("doc", F.coalesce("doc", F.lit(_FIRST)).alias("key"), F.xxhash64("text").alias("spread"), "text")
    cuts = _cuts(rows.select("key"), ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, spread: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, key, side="left"), np.searchsorted(cuts, key, side="right")
        share = (spread.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series(np.minimum(low + (share * (high - low + 1)).astype(int), high).astype(np.int32))

    rows = rows.withColumn("range", range_of("key", "spread"))
    # The row with which each range begins, in descending order: at most one per range.
    heads = {r["range"]: tuple(r["head"]) for r in rows.groupBy("range").agg(F.max(F.struct("key", "spread")).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    to_range = {heads[r]: before for before, r in zip([order[-1], *order], order)} if order else {}
    begin = spark.createDataFrame([(*head, r) for head, r in to_range.items()], "key long, spread long, before int")
    # ``begin`` has at most MAX_RANGES rows of three numbers.
    sent = rows.join(F.broadcast(begin), ["key", "spread"]).select("doc", "key", "spread", "text", F.col("before").alias("range"), F.lit(True).alias("follows"))
    return (
        rows.select("doc", "key", "spread", "text", "range", F.lit(False).alias("follows"))
        .unionByName(sent)
        .repartition("range")
        .sortWithinPartitions("range", "follows", F.desc("key"), F.desc("spread"))
        .select("doc", "text", "follows")
        .mapInArrow(_stream, _SHAPE)
        .withColumnRenamed("id", id_col)
    )


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(tables.read(spark, sf_dir, "documents"))
