"""Packing: hierarchical multi-length packing of documents into windows of several context sizes.

1. A document is its token ids and one closing id. Each whole ``CONTEXT`` of it is a
   window of its own; the rest is routed to the smallest tier that holds it.
2. Tiers are packed from the longest to the shortest. A piece opens a window, and
   the gap takes the longest pieces of the shorter tiers that fit, then a cut of the
   longest of them, whose rest is routed anew. So every window is full.
3. A task packs its documents in blocks of ``BLOCK`` tokens and hands the one window
   that a block leaves open to the next; that of the last is cut at powers of two,
   which need no padding.
4. Windows of one length are ordered by the work of attention over their pieces (the
   sum of squared lengths) and cut into step groups: each has ``STEP`` tokens, but for
   the last of a length, windows of one length, and about the same work in each.

Only ids, lengths and checksums leave a task; texts are not shuffled. A window is a
row, so a hot source or many equal texts change no task's share.

Defined cases: a null or empty text is the closing id alone; a null id is an id like
any other, and repeated rows are packed once each; text that spells a special token
is that token; only the id and text columns are read; an empty table gives no rows.
Windows follow the order of rows within the input's partitions, so other partitions
give other windows, equally full.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query

CONTEXT = 2048
#: Window lengths, powers of two, the longest first.
TIERS = (2048, 1024, 512, 256)
CLOSING = 1
BLOCK = 1 << 21
STEP = 64 * CONTEXT
#: Classes of work, and parts of a class, that windows of a length are counted in: bounds what a task numbers by itself.
CLASSES, PARTS = 16, 256

Piece = tuple[int, int, int]  # document, start, length


class _Stock:
    """Pieces by length; the longest up to a limit is found by bisection."""

    def __init__(self) -> None:
        self._of: dict[int, list[Piece]] = {}
        self._lengths: list[int] = []

    def add(self, piece: Piece) -> None:
        if piece[2] not in self._of:
            self._of[piece[2]] = []
            insort(self._lengths, piece[2])
        self._of[piece[2]].append(piece)

    def longest(self, limit: int, over: int = 0) -> Piece | None:
        """Takes the longest piece of at most ``limit`` and more than ``over`` tokens."""
        at = bisect_right(self._lengths, limit) - 1
        if at < 0 or self._lengths[at] <= over:
            return None
        length = self._lengths[at]
        piece = self._of[length].pop()
        if not self._of[length]:
            del self._of[length]
            self._lengths.pop(at)
        return piece


def _cut(piece: Piece, length: int) -> tuple[Piece, Piece]:
    doc, start, n = piece
    return (doc, start, length), (doc, start + length, n - length)


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of the tiers' lengths made of ``pieces``, and the pieces of at most one window that is not full."""
    windows, stock = [], _Stock()
    for doc, start, n in pieces:
        for whole in range(start, start + n - tiers[0] + 1, tiers[0]):
            windows.append([(doc, whole, tiers[0])])
        if n % tiers[0]:
            stock.add((doc, start + n - n % tiers[0], n % tiers[0]))
    for at, tier in enumerate(tiers):
        shorter = tiers[at + 1] if at + 1 < len(tiers) else 0
        while (piece := stock.longest(tier, over=shorter)) is not None:
            window, gap = [piece], tier - piece[2]
            while gap:
                piece = stock.longest(min(gap, shorter or gap))
                if piece is None:
                    # Nothing fits whole: cut the longest of a shorter tier, or of this one.
                    piece = stock.longest(shorter) or stock.longest(tier)
                    if piece is None:
                        return windows, window
                    piece, rest = _cut(piece, min(gap, piece[2]))
                    if rest[2]:
                        stock.add(rest)
                window.append(piece)
                gap -= piece[2]
            windows.append(window)
    return windows, []


def at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in windows whose lengths are distinct powers of two, the longest first."""
    left, total = list(reversed(pieces)), sum(p[2] for p in pieces)
    windows = []
    while total:
        gap = 1 << (total.bit_length() - 1)
        total -= gap
        window = []
        while gap:
            piece, rest = _cut(left.pop(), gap) if left[-1][2] > gap else (left.pop(), None)
            if rest:
                left.append(rest)
            window.append(piece)
            gap -= piece[2]
        windows.append(window)
    return windows


#: Beyond Latin letters, Unicode versions may class characters differently.
_OTHER = re.compile("[^\x00-\u024f]")


def tokenizer(path: str | None = None, ranks: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by the vocabulary file at ``path``, by default that of the installed public tokenizers; each ends with ``CLOSING``.

    Texts of Latin characters take the same vocabulary as ``ranks``, whose ids are the same and cost a third.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    special = {t.content: i for i, t in encoder.get_added_tokens_decoder().items()}
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        of_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    latin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of_bytes, special_tokens=special)

    def ids(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if _OTHER.search(text):
                own = encoder.encode(text, add_special_tokens=False).ids
            else:
                own = latin.encode_to_numpy(text, allowed_special="all")
            out.append(np.append(np.asarray(own, dtype="<u4"), np.array([CLOSING], dtype="<u4")))
        return out

    return ids


_SHAPE = (
    "task int, number long, tokens int, work long, "
    "pieces array<struct<doc:long,start:long,length:long,ids_crc32:long,doc_tokens:long,offset:long>>"
)


def _packer(path: str | None, tiers: tuple[int, ...], block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = tokenizer(path), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: dict[int, np.ndarray] = {}
        number = 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            flat = [p for w in windows for p in w]
            sizes = [len(w) for w in windows]
            offsets, work, tokens = [], [], []
            for w in windows:
                filled = 0
                for p in w:
                    offsets.append(filled)
                    filled += p[2]
                tokens.append(filled)
                work.append(sum(p[2] * p[2] for p in w))
            sums = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in flat]
            columns = [[keys[p[0]] for p in flat], [p[1] for p in flat], [p[2] for p in flat], sums, [len(ids[p[0]]) for p in flat], offsets]
            parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "length", "ids_crc32", "doc_tokens", "offset"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), parts)
            n = len(windows)
            numbers = pa.array(range(number, number + n), pa.int64())
            number += n
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int32()), numbers, pa.array(tokens, pa.int32()), pa.array(work, pa.int64()), lists],
                ["task", "number", "tokens", "work", "pieces"],
            )

        waiting: list[Piece] = []
        size = 0
        for batch in tables.slices(batches, "text"):
            texts = tables.strings(batch.column("text")).to_pylist()
            of_text = dict(zip(distinct := list(dict.fromkeys(texts)), encode(distinct)))
            for key, text in zip(batch.column("doc").to_pylist(), texts):
                ids[len(keys)] = of_text[text]
                waiting.append((len(keys), 0, len(of_text[text])))
                keys.append(key)
                size += waiting[-1][2]
            if size >= block:
                windows, waiting = pack(waiting, tiers)
                yield rows(windows)
                # Only the documents of the open window are carried on.
                held = list(dict.fromkeys(p[0] for p in waiting))
                place = {d: i for i, d in enumerate(held)}
                ids, keys = {place[d]: ids[d] for d in held}, [keys[d] for d in held]
                waiting = [(place[d], s, n) for d, s, n in waiting]
                size = sum(p[2] for p in waiting)
        windows, rest = pack(waiting, tiers)
        if windows or rest:
            yield rows(windows + at_powers(rest))

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS,
    step: int = STEP, block: int = BLOCK,
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier`` (the window's length)``, step``.

    ``sequence_id`` counts windows from 0, the longest first, then by work; ``step`` counts step groups in the same order.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers are distinct powers of two, the longest first")
    tables.on_executors(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    windows = tables.store(rows.mapInArrow(_packer(vocabulary, tiers, block), _SHAPE), "windows")
    tokens = F.col("tokens").cast("long")
    placed = windows.select(
        "*", F.expr(f"cast(work * {CLASSES} div (cast(tokens as long) * tokens) as int)").alias("class"),
        F.pmod(F.xxhash64("task", "number"), F.lit(PARTS)).cast("int").alias("part"),
    )
    # Counts of at most lengths times classes times parts cells; sums of rows before each cell, then before each class.
    cells = placed.groupBy("tokens", "class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("tokens", "class", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_class"))
    classes = cells.groupBy("tokens", "class").agg(F.sum("n").alias("n"))
    of_length = Window.partitionBy("tokens").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("tokens", "class", F.coalesce(F.sum("n").over(of_length), F.lit(0)).alias("in_length"))
    # One row for each length that occurs, at most as many as powers of two below the context.
    lengths = cells.groupBy("tokens").agg(F.sum("n").alias("n")).withColumn("steps", F.expr(f"cast(ceil(n * tokens / {step}) as long)"))
    longer = Window.orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("tokens", *[F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(f"{c}_before") for c in ("n", "steps")])
    starts = cells.join(F.broadcast(classes), ["tokens", "class"]).join(F.broadcast(lengths), "tokens")
    starts = starts.select("tokens", "class", "part", (F.col("in_length") + F.col("in_class")).alias("first"), "n_before", "steps_before")
    inside = Window.partitionBy("tokens", "class", "part").orderBy("work", "task", "number")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["tokens", "class", "part"])
    numbered = numbered.withColumn("at", F.col("first") + F.col("at"))
    return numbered.select(
        F.explode("pieces").alias("piece"), (F.col("n_before") + F.col("at")).cast("long").alias("sequence_id"), tokens.alias("tier"),
        (F.col("steps_before") + F.floor(F.col("at") * tokens / step)).cast("long").alias("step"),
    ).select(
        F.col("piece.doc").alias(id_col), *[F.col(f"piece.{c}").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens")],
        "sequence_id", F.col("piece.offset").alias("offset"), "tier", "step",
    )


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(tables.read(spark, sf_dir, "documents"))
