"""SentencePiece encoding with sampled segmentations, and decoding.

A text, with a space put before it, is cut into stretches that no piece
crosses: spaces with the word after them, and line ends. A stretch has a
lattice of the pieces that fit it. Forward filtering sums the weights of all
segmentations up to each character; backward sampling then draws a piece that
ends there in proportion, from the end to the start. A stretch is filtered once
for all its occurrences in a slice of texts; the lattices of all stretches of one
length, and the draws of all occurrences, are array operations. A draw is a hash of the seed, the row's key, the stretch's number
and the step, so a row gets the same pieces in any task and attempt.

The vocabulary's scores are merge ranks, so a piece weighs (rank + 3) ** -alpha,
Zipf's law for ranks; a smaller ``alpha`` makes segmentations more even.
Characters without a piece become the pieces of their UTF-8 bytes.

Decoding joins the pieces' bytes and takes the first space off: it gives back
every text that was encoded, byte for byte.

Defined cases: null and empty texts have no pieces and decode to an empty text;
a null key counts as 0; equal keys and texts give equal pieces; only the id and
text columns are read; an empty table gives no rows; ids outside the vocabulary
and control pieces decode to nothing; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SEED = 1

_STRETCH = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Ids from here on stand for characters spelt in bytes.
_SPELT = 1 << 24
_SLOT_BITS = 20
#: Stretches of up to so many characters are summed as plain products, which stay far from the smallest double; longer ones as logarithms.
_PLAIN = 64


@dataclass(frozen=True)
class Vocabulary:
    """Ids and ranks of the pieces (a space where the model writes U+2581), the ids of bytes, and each id's bytes."""

    ids: dict[str, int]
    ranks: dict[str, float]
    byte_ids: list[int]
    raw: list[bytes]


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read by the driver from a model file; 32,000 short strings, sent to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ranks, byte_ids, raw = {}, {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            raw.append(piece.encode())
            # Pieces across a stretch's end, and those the model never forms by itself (runs of spaces), take no part.
            if model.get_score(i) > -1e8 and " " not in piece[1:] and "\n" not in piece:
                ids[piece], ranks[piece] = i, -model.get_score(i)
    return Vocabulary(ids, ranks, byte_ids, raw)


class Lattices:
    """Pieces by hash, and their weights: what the lattices of a task are built from."""

    def __init__(self, vocabulary: Vocabulary, alpha: float) -> None:
        self.vocabulary = vocabulary
        self.weights = {p: -alpha * math.log(r + 3) for p, r in vocabulary.ranks.items()}
        #: Weight of a character that is spelt in bytes.
        self.spelling = min(self.weights.values(), default=0.0) - 2
        self.longest = max(map(len, self.weights), default=1)
        hashes = np.zeros(len(self.weights), dtype=np.uint64)
        names = list(self.weights)
        for length in range(1, self.longest + 1):
            own = [i for i, p in enumerate(names) if len(p) == length]
            if own:
                hashes[own] = list(_runs(_points("".join(names[i] for i in own), length), length))[-1][:, 0]
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([vocabulary.ids[p] for p in names], dtype=np.int64)[order]
        self.logs = np.array(list(self.weights.values()))[order]
        self.plain = np.exp(self.logs)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int64)
        # Pieces by the first bits of their hash; those that share them follow in order.
        self.slots = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        slots = (self.hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.slots[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.shared = int(np.unique(slots, return_counts=True)[1].max(initial=1))

    def spelt(self, piece: int) -> list[int]:
        """The byte pieces of a character that is no piece."""
        return [self.vocabulary.byte_ids[b] for b in chr(piece - _SPELT).encode("utf-8", "surrogatepass")]

    def build(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """Lattices of stretches of one length n, n nodes each, numbered from 0 in order.

        Arcs are sorted by the node they end in: the sum of probabilities within
        it so far (plus its number), their length, whether they start the stretch,
        and their piece.
        """
        points = _points("".join(stretches), len(stretches[0]))
        count, n = points.shape
        most = min(self.longest, n)
        plain = n <= _PLAIN and self.spelling > -10
        arcs = np.zeros((count, n, most)) if plain else np.full((count, n, most), -np.inf)
        ids = np.zeros((count, n, most), dtype=np.int32)
        weights, flat, flat_ids = self.plain if plain else self.logs, arcs.reshape(-1), ids.reshape(-1)
        for length, keys in enumerate(_runs(points, most), 1):
            slots = self.slots[(keys >> np.uint64(64 - _SLOT_BITS)).ravel()]
            place = np.flatnonzero(slots >= 0)
            keys, first = keys.ravel()[place], slots[place]
            for later in range(self.shared):
                at = np.minimum(first + later, len(self.hashes) - 1)
                known = np.flatnonzero(self.hashes[at] == keys)
                row, column = np.divmod(place[known], n - length + 1)
                arc = (row * n + column + length - 1) * most + length - 1
                flat[arc] = weights[at[known]]
                flat_ids[arc] = self.ids[at[known]]
        alone = arcs[:, :, 0] == (0 if plain else -np.inf)
        arcs[:, :, 0][alone] = math.exp(self.spelling) if plain else self.spelling
        spelt = points[alone].astype(np.int64)
        ids[:, :, 0][alone] = np.where(spelt < 128, self.byte_ids[np.minimum(spelt, 127)], _SPELT + spelt)
        (_forward_plain if plain else _forward_logs)(arcs)
        some = np.flatnonzero(arcs)
        node, length = np.divmod(some, most)
        sums = node + np.minimum(np.cumsum(arcs, axis=2).reshape(-1)[some], 1 - 1e-9)
        length += 1
        starts, ids = length == node % n + 1, flat_ids[some]
        last = np.flatnonzero(np.append(node[1:] != node[:-1], True))
        sums[last] = np.arange(1, count * n + 1)
        return sums, length, starts, ids


def _forward_plain(arcs: np.ndarray) -> None:
    """Turns the weights of the arcs into each node's in probabilities, in place."""
    count, n, most = arcs.shape
    forward = np.ones((count, n + 1))
    for j in range(1, n + 1):
        k = min(most, j)
        own = arcs[:, j - 1, :k]
        own *= forward[:, j - k : j][:, ::-1]
        total = np.einsum("ij->i", own)
        own /= total[:, None]
        forward[:, j] = total


def _forward_logs(arcs: np.ndarray) -> None:
    """The same from logarithms of weights."""
    count, n, most = arcs.shape
    forward = np.zeros((count, n + 1))
    for j in range(1, n + 1):
        k = min(most, j)
        own = arcs[:, j - 1, :k]
        own += forward[:, j - k : j][:, ::-1]
        top = own.max(axis=1)
        own -= top[:, None]
        np.exp(own, out=own)
        total = own.sum(axis=1)
        own /= total[:, None]
        arcs[:, j - 1, k:] = 0
        forward[:, j] = top + np.log(total)


def _points(text: str, width: int) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, width)


def _runs(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of 1, 2, up to ``most`` points in each row."""
    total = np.zeros_like(points, dtype=np.uint64)
    for length in range(1, most + 1):
        n = points.shape[1] - length + 1
        total = total[:, :n] * np.uint64(0x9E3779B97F4A7C15) + points[:, length - 1 : length - 1 + n] + np.uint64(1)
        yield mix(total)


def _draw(seed: int, keys: np.ndarray, numbers: np.ndarray, step: int) -> np.ndarray:
    bits = mix(mix(keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) + numbers * np.uint64(0xD6E8FEB86659FD93) + np.uint64(step))
    return (bits >> np.uint64(24)).astype(np.float64) * 2.0**-40


def sample(texts: list[str], keys: np.ndarray, lattices: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and how many each text has."""
    found, sizes = [], []
    for text in texts:
        own = _STRETCH.findall(" " + text) if text else []
        found += own
        sizes.append(len(own))
    sizes = np.array(sizes, dtype=np.int64)
    if not found:
        return np.zeros(0, np.int64), sizes
    kinds = {stretch: i for i, stretch in enumerate(dict.fromkeys(found))}
    kind = np.fromiter(map(kinds.__getitem__, found), dtype=np.int64, count=len(found))
    by_length: dict[int, list[str]] = {}
    for stretch in kinds:
        by_length.setdefault(len(stretch), []).append(stretch)
    length_of = np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds))
    rank = np.empty(len(kinds), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    number = (np.arange(len(kind)) - (np.cumsum(sizes) - sizes)[owner]).astype(np.uint64)
    key = keys.view(np.uint64)[owner]
    taken: list[tuple[np.ndarray, np.ndarray, int]] = []
    steps_of = np.zeros(len(kind), dtype=np.int64)
    own_length = length_of[kind]
    order = np.argsort(own_length, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(own_length[order])) + 1)
    for at in groups:
        n = int(own_length[at[0]])
        stretches = by_length[n]
        rank[np.flatnonzero(length_of == n)] = np.arange(len(stretches))
        sums, length, starts, pieces = lattices.build(stretches)
        node, step = rank[kind[at]] * n + n - 1, 0
        while len(at):
            arc = np.searchsorted(sums, node + _draw(seed, key[at], number[at], step), side="right")
            taken.append((at, pieces[arc], step))
            steps_of[at] += 1
            going = ~starts[arc]
            at, node = at[going], (node - length[arc])[going]
            step += 1
    stop = np.cumsum(steps_of)
    out = np.empty(stop[-1], dtype=np.int64)
    for at, piece, step in taken:
        out[stop[at] - 1 - step] = piece
    owner = np.repeat(owner, steps_of)
    spelt = np.flatnonzero(out >= _SPELT)
    if len(spelt):
        codes, which = np.unique(out[spelt], return_inverse=True)
        spellings = [lattices.spelt(int(c)) for c in codes]
        width = np.ones(len(out), dtype=np.int64)
        width[spelt] = np.array([len(x) for x in spellings])[which]
        place = (np.cumsum(width) - width)[spelt]
        out, owner = np.repeat(out, width), np.repeat(owner, width)
        for i in range(4):
            has = width[spelt] > i
            out[place[has] + i] = np.array([x[i] if i < len(x) else 0 for x in spellings])[which[has]]
    return out, np.bincount(owner, minlength=len(texts))


def join(ids: list[int], vocabulary: Vocabulary) -> str:
    raw = vocabulary.raw
    if ids and not 0 <= min(ids) <= max(ids) < len(raw):
        ids = [i for i in ids if 0 <= i < len(raw)]
    data = b"".join(map(raw.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None, alpha: float = ALPHA, seed: int = SEED
) -> DataFrame:
    """One row per document: ``id_col, piece_ids``. ``id_col`` is an integer and the row's key."""
    tables.on_executors(docs.sparkSession)
    vocabulary = vocabulary or load_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary, alpha)
        for batch in tables.slices(batches, "text", 3 * tables.SLICE_BYTES):
            keys = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False)
            ids, sizes = sample(tables.strings(batch.column("text")).to_pylist(), keys, lattices, seed)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "piece_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece_ids array<int>").withColumnRenamed("id", id_col)


def decode(pieces: DataFrame, id_col: str = "doc_id", pieces_col: str = "piece_ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per row: ``id_col, piece_ids, text``."""
    tables.on_executors(pieces.sparkSession)
    vocabulary = vocabulary or load_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column("piece_ids")
                ids, ends = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).tolist(), np.cumsum(lists.value_lengths().fill_null(0))
                texts = [join(ids[a:b], vocabulary) for a, b in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(texts, pa.string())], ["id", "piece_ids", "text"])

    rows = pieces.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).alias("piece_ids"))
    return rows.mapInArrow(run, "id long, piece_ids array<int>, text string").withColumnRenamed("id", id_col)


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and the checksum of the text that they decode to."""
    vocabulary = load_vocabulary()
    back = decode(encode(tables.read(spark, sf_dir, "documents"), vocabulary=vocabulary), vocabulary=vocabulary)
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2("text", 256).alias("decoded_sha256"))
