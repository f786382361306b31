"""Quality classifier by co-training on two views of a document: what it says, and what kind of page it is.

The text view has the shares of ASCII characters and of all others, and measures of
words: number, length, distinct words, words repeated at once. The metadata view has
the facts a crawler notes beside a page: source, language and length as given, and its
form: lines, their lengths, shares of capitals, digits, symbols, white space and
characters beyond ASCII. Both classifiers are logistic regressions.

They start from the same labelled documents. In each round both score every unlabelled
document where it lies, and each hands the ``GIVEN`` documents of which it is surest, in
the proportion of the labels, to the other, with its verdict as label. Then each view is
calibrated on labelled documents kept back, and so is the sum of both views' log odds,
each with the weight that these documents give it: the score of every document.

The fit is bounded: by ``MAX_LABELLED`` labelled documents, drawn by the hash of their id,
and by what is handed over, twice ``GIVEN`` a round. Features are computed once, from
whole texts, and stored; rounds read them.

Defined cases: null and empty texts, and texts without words, have the features
of an empty text; null metadata is a value of its own; labels without id or
verdict are left out, and several for one id count by their mean (0.5: good);
a null id is scored but never drawn; of the rows of an id one is
fitted to; repeated rows are scored alike; with fewer than ``LEAST`` labelled documents
of either kind nothing can be learned: every document is kept, and the model's status,
the status column and a warning say so; an empty table gives no rows. Only the named
columns are read for the score.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query
from corpusloom.llm.words import words_of

MAX_LABELLED = 8192
LEAST = 10
ROUNDS = 5
#: Documents that a view hands to the other in a round.
GIVEN = 256
#: Columns of hashed metadata values.
META_FEATURES = 64
META = ("source", "lang", "n_chars")
FITTED, TOO_FEW = "fitted", "too few labels"

_SEED_LABELLED, _SEED_POOL = 1, 2
_TEXT_WIDTH, _META_WIDTH = 135, META_FEATURES + 10


def text_features(column: pa.Array) -> np.ndarray:
    words = words_of(column)
    n = words.n_texts
    column = tables.strings(column)
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1])
    text = np.repeat(np.arange(n), sizes)
    # Continuation bytes of UTF-8 do not count: a character is one.
    char = (words.data & 0xC0) != 0x80
    shown = np.minimum(words.data[char], 128)
    shares = np.bincount(text[char] * 129 + shown, minlength=n * 129).reshape(n, 129) / np.maximum(1, np.bincount(text[char], minlength=n))[:, None]
    counts, hashes, lengths = words.counts(), words.hashes(), words.end - words.start
    order = np.lexsort((hashes, words.text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])
    distinct = np.bincount(words.text[order][new], minlength=n)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1]))
    repeated = np.bincount(words.text[again], minlength=n)
    long = np.bincount(words.text[lengths > 20], minlength=n)
    some = np.maximum(1, counts)
    measures = [
        np.log1p(counts) / 10, np.bincount(words.text, weights=lengths, minlength=n) / some / 10, distinct / some, repeated / some, long / some,
    ]
    return _stored(np.column_stack([np.sqrt(shares), *measures, np.ones(n)]))


def _stored(features: np.ndarray) -> np.ndarray:
    """As they are kept between rounds, so that every score is made of the same numbers."""
    return features.astype(np.float16).astype(np.float32)


#: Classes of bytes: capitals, digits, white space, characters beyond ASCII, symbols; small letters are 5.
_CLASS = np.array(
    [0 if 65 <= b <= 90 else 1 if 48 <= b <= 57 else 2 if b == 32 or 9 <= b <= 13 else 3 if b >= 128 else 5 if 97 <= b <= 122 else 4 for b in range(256)]
)


def form_features(column: pa.Array) -> np.ndarray:
    """Bytes, lines, mean and longest line, and the shares of the classes of bytes."""
    column = tables.strings(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    size, offsets = np.diff(offsets), offsets - offsets[0]
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6)[:, :5] / np.maximum(1, size)[:, None]
    # A line ends at a break or with its text.
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]))
    of = np.minimum(np.searchsorted(offsets, ends, side="left") - 1, n - 1).clip(0)
    lengths = np.diff(np.concatenate([[0], ends]))
    lines = np.bincount(of, minlength=n) if n else np.zeros(0)
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths[: len(of)])
    mean = size / np.maximum(1, lines)
    return np.column_stack([np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(mean) / 5, np.log1p(longest) / 10, np.sqrt(kinds)])


def metadata_features(columns: dict[str, pa.Array], text: pa.Array) -> np.ndarray:
    n = len(text)
    out = np.zeros((n, _META_WIDTH), dtype=np.float32)
    out[:, META_FEATURES:-1] = form_features(text)
    out[:, -1] = 1
    for name, column in columns.items():
        seen: dict = {}
        for i, value in enumerate(column.to_pylist()):
            if value not in seen:
                kind = int(abs(value)).bit_length() if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value else value
                seen[value] = zlib.crc32(f"{name}={kind}".encode("utf-8", "replace")) % META_FEATURES
            out[i, seen[value]] += 1
    return _stored(out)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights by Newton's method; the last column, the constant, is not penalised."""
    x = x.astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Weights and calibration (slope, shift) of both views, and what weighs them together; without weights all are kept.

    ``both`` has a weight for each view's log odds and a shift. ``given`` has what each view handed over, round by round: good, junk by text, then by metadata.
    """

    views: tuple[np.ndarray, np.ndarray] | None
    calibration: tuple[np.ndarray, np.ndarray] | None = None
    both: np.ndarray | None = None
    given: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def status(self) -> str:
        return TOO_FEW if self.views is None else FITTED

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good by text, by metadata, and by both."""
        if self.views is None:
            one = np.ones(len(text))
            return one, one, one
        odds = [c[0] * (x.astype(np.float64) @ w) + c[1] for x, w, c in zip((text, meta), self.views, self.calibration)]
        whole = self.both[0] * odds[0] + self.both[1] * odds[1] + self.both[2]
        return tuple(1 / (1 + np.exp(-np.clip(o, -500, 500))) for o in (*odds, whole))


#: Of a round: the surest documents by view and verdict, as features of both views.
Surest = Callable[[list[np.ndarray], dict[int, int]], dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]


def co_train(views: tuple[np.ndarray, np.ndarray], label: np.ndarray, surest: Surest, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """Fits both views; every fourth labelled document is kept back for calibration.

    ``surest(weights, most)`` finds the unlabelled documents of which each view is
    surest, at most ``most[kind]`` of a kind, and never the same ones again.
    """
    if min((label == 1).sum(), (label == 0).sum()) < LEAST:
        warnings.warn(f"quality classifier: fewer than {LEAST} labelled documents of a kind; every document is kept", stacklevel=2)
        return Model(None)
    back = np.zeros(len(label), dtype=bool)
    for kind in (0, 1):
        back[np.flatnonzero(label == kind)[::4]] = True
    prior = label.mean()
    known = [[v[~back]] for v in views]
    labels = [[label[~back]] for _ in views]
    most = {1: max(1, round(given * prior)), 0: max(1, round(given * (1 - prior)))}
    handed = []
    for round_ in range(rounds + 1):
        weights = [logistic(np.concatenate(known[i]), np.concatenate(labels[i])) for i in (0, 1)]
        if round_ == rounds:
            break
        found = surest(weights, most)
        for (view, kind), both in found.items():
            known[1 - view].append(both[1 - view])
            labels[1 - view].append(np.full(len(both[0]), float(kind)))
        handed.append(tuple(len(found[view, kind][0]) if (view, kind) in found else 0 for view in (0, 1) for kind in (1, 0)))
    calibration, odds = [], []
    one = np.ones(int(back.sum()))
    for v, w in zip(views, weights):
        raw = v[back].astype(np.float64) @ w
        calibration.append(logistic(np.column_stack([raw, one]), label[back], penalty=1e-3))
        odds.append(calibration[-1][0] * raw + calibration[-1][1])
    both = logistic(np.column_stack([*odds, one]), label[back], penalty=0.1)
    return Model(tuple(weights), tuple(calibration), both, handed)


def _rows(docs: DataFrame, id_col: str, text_col: str, meta: Sequence[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(m).alias(f"m_{i}") for i, m in enumerate(meta)])


def _views(batch: pa.RecordBatch, names: dict[str, str], text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(text)
    return text_features(column), metadata_features({m: batch.column(c) for m, c in names.items()}, column)


def _bytes(features: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in features.astype(np.float16)], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, width).astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: Sequence[str] = META) -> DataFrame:
    """``id, draw, text_view, meta_view`` of every document with an id; ``draw`` is a hash of the id."""
    names = {m: f"m_{i}" for i, m in enumerate(meta)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            text, metadata = _views(batch, names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _bytes(text), _bytes(metadata)], ["id", "text_view", "meta_view"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col, meta).where("id is not null").mapInArrow(run, f"id {kind}, text_view binary, meta_view binary")
    return rows.withColumn("draw", F.xxhash64("id", F.lit(_SEED_POOL)))


class _Pool:
    """The stored features of all documents, from which each round takes the surest that are neither labelled nor taken."""

    def __init__(self, stored: DataFrame, taken: set) -> None:
        self._stored, self._taken = stored, taken

    def __call__(self, weights: list[np.ndarray], most: dict[int, int]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        taken = self._taken

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of a task's rows the surest by view and kind; of equally sure ones those drawn first."""
            held: dict[tuple[int, int], dict] = {(view, kind): {} for view in (0, 1) for kind in (0, 1)}
            for batch in batches:
                views = [_matrix(batch.column(c), w) for c, w in (("text_view", _TEXT_WIDTH), ("meta_view", _META_WIDTH))]
                ids, draw = batch.column("id").to_pylist(), batch.column("draw").to_numpy()
                free = np.array([i not in taken for i in ids], dtype=bool)
                for view in (0, 1):
                    odds = views[view].astype(np.float64) @ weights[view]
                    for kind in (0, 1):
                        sure = np.round(odds if kind else -odds, 9)
                        order = np.lexsort((draw, -sure))
                        order = order[free[order]][: 4 * most[kind]]
                        best = held[view, kind]
                        for at in order.tolist():
                            best.setdefault(ids[at], (-float(sure[at]), int(draw[at]), views[0][at], views[1][at]))
                        if len(best) > most[kind]:
                            ranked = sorted(best.items(), key=lambda e: e[1][:2])
                            held[view, kind] = dict(ranked[: most[kind]])
            for (view, kind), best in held.items():
                rows = list(best.items())
                columns = [
                    pa.array([view] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([i for i, _ in rows], id_type),
                    pa.array([r[0] for _, r in rows], pa.float64()), pa.array([r[1] for _, r in rows], pa.int64()),
                    *[pa.array([r[c].astype(np.float16).tobytes() for _, r in rows], pa.binary()) for c in (2, 3)],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["view", "kind", "id", "sure", "draw", "text_view", "meta_view"])

        import pyspark.sql.pandas.types as arrow

        id_kind = self._stored.schema["id"].dataType
        id_type = arrow.to_arrow_type(id_kind)
        shape = f"view int, kind int, id {id_kind.simpleString()}, sure double, draw long, text_view binary, meta_view binary"
        best = self._stored.mapInArrow(run, shape)
        # One row of an id; then the first of each view and kind, a bounded number of each task's.
        best = best.groupBy("view", "kind", "id", "sure", "draw").agg(F.min(F.struct("text_view", "meta_view")).alias("row"))
        rank = F.row_number().over(Window.partitionBy("view", "kind").orderBy("sure", "draw", "id"))
        limit = F.when(F.col("kind") == 1, most[1]).otherwise(most[0])
        rows = best.withColumn("rank", rank).where((F.col("rank") <= max(most.values())) & (F.col("rank") <= limit))
        found = rows.select("view", "kind", "id", "rank", "row.*").orderBy("view", "kind", "rank").toArrow()
        out, now = {}, set()
        for view in (0, 1):
            for kind in (0, 1):
                some = found.filter(pc.and_(pc.equal(found["view"], view), pc.equal(found["kind"], kind)))
                if some.num_rows:
                    out[view, kind] = _matrix(some["text_view"], _TEXT_WIDTH), _matrix(some["meta_view"], _META_WIDTH)
                    now |= set(some["id"].to_pylist())
        self._taken = self._taken | now
        return out


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta: Sequence[str] = META,
    label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, given: int = GIVEN,
) -> Model:
    tables.on_executors(docs.sparkSession)
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("q")).where("id is not null and q is not null")
    known = known.groupBy("id").agg((F.avg("q") >= 0.5).cast("double").alias("quality"))
    stored = tables.store(features(docs, id_col, text_col, meta), "features")
    # Only labels that meet a document are drawn.
    known = known.join(stored.select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(_SEED_LABELLED)), "id").limit(max_labelled)
    # At most max_labelled rows of an id and a number; however often an id repeats, one row of it comes to the driver.
    found = stored.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct("draw", "text_view", "meta_view", "quality")).alias("row"))
    found = found.select("id", "row.*").orderBy("draw", "id").toArrow()
    label = found["quality"].to_numpy().astype(float)
    views = _matrix(found["text_view"], _TEXT_WIDTH), _matrix(found["meta_view"], _META_WIDTH)
    return co_train(views, label, _Pool(stored, set(found["id"].to_pylist())), rounds, given)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta: Sequence[str] = META) -> DataFrame:
    """One row per document: ``id_col, text_score, metadata_score, score, keep, status``."""
    tables.on_executors(docs.sparkSession)
    names = {m: f"m_{i}" for i, m in enumerate(meta)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, "text"):
            scores = model.score(*_views(batch, names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, scores), pa.array(scores[2] >= 0.5)], ["id", "text_score", "metadata_score", "score", "keep"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col, meta).mapInArrow(run, f"id {kind}, text_score double, metadata_score double, score double, keep boolean")
    return rows.withColumnRenamed("id", id_col).withColumn("status", F.lit(model.status))


def good_documents(docs: DataFrame, model: Model, text_col: str = "text", meta: Sequence[str] = META) -> DataFrame:
    """The documents, all columns, that the model keeps."""
    tables.on_executors(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables.slices(batches, text_col):
            yield batch.filter(pa.array(model.score(*_views(batch, {m: m for m in meta}, text_col))[2] >= 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, tables.read(spark, sf_dir, "labels")))
