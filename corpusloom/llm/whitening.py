"""Embedding whitening by QDWH spectral divide and conquer.

1. Entries become whole numbers, floor(``scale`` * entry), and a vector its shortest byte
   string of them; the fit list is the distinct ones.
2. Two passes over the fit list give sums and, centred by them, the covariance: partial
   sums per task, one row an entry of the matrix.
3. The covariance, of fixed size, is split on the driver: the polar factor of V - shift,
   by QDWH iterations (QR-based while ill-conditioned, then Cholesky-based), gives the
   projector on the eigenvalues above the shift, whose range and complement are split
   again, down to single components.
4. The components are broadcast, and every row is projected where it lies.

Equal vectors meet as one key with a partial distinct in each task, so a vector that a
third of all rows hold is one row a task.

Defined cases: a vector that is null, or holds a null or non-finite entry, is left out, so
is an empty one, and one whose length is not the commonest in the fit list (of equally
common ones the greatest); entries beyond 2 ** 53 / ``scale`` count as that; a null id is an id like any
other, and repeated rows are returned once each; where the sums need more than 63 bits the
deviation is null; a component without spread has a null projection, and it and
``identity_error`` take no part of it; with fewer dimensions than components there are as
many components as dimensions; only the id and vector columns are read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import tables
from corpusloom.llm.registry import query

SCALE = 256
COMPONENTS = 4
_LAST = (1 << 63) - 1
_LARGEST = float(1 << 53)
#: Rows that one numpy pass works on.
ROWS = 4096


# ---------------------------------------------------------------- vectors and their bytes


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all lists in a row, where each list begins and ends, and whether it counts."""
    column = column.cast(pa.large_list(column.type.value_type))
    values = column.values
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(entries)
    seen = np.concatenate([[0], np.cumsum(bad)])
    whole = (seen[offsets[1:]] == seen[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
    return entries, offsets, whole & np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)


def quantise(entries: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * entries), -_LARGEST, _LARGEST).astype(np.int64)


def to_bytes(x: np.ndarray) -> bytes:
    """The shortest of the fixed widths, named by the first byte; equal vectors have equal bytes."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for width, kind in ((1, "<i1"), (2, "<i2"), (4, "<i4")):
        if -(1 << (8 * width - 1)) <= low and high < 1 << (8 * width - 1):
            return bytes([width]) + x.astype(kind).tobytes()
    return b"\x08" + x.astype("<i8").tobytes()


def from_bytes(column: pa.Array) -> np.ndarray:
    """A matrix of one row a vector; all have the same length."""
    return np.stack([np.frombuffer(b, dtype=f"<i{b[0]}", offset=1).astype(np.int64) for b in column.to_pylist()])


def _packed(scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, offsets, whole = vectors_of(batch.column("vector"))
            rows = np.flatnonzero(whole)
            sizes = (offsets[1:] - offsets[:-1])[rows]
            x = quantise(np.where(np.isfinite(entries), entries, 0), scale)
            keys = [to_bytes(x[offsets[i] : offsets[i + 1]]) for i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], ["size", "key"])

    return run


# ---------------------------------------------------------------- sums over the fit list


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``i, high, low``: sums per dimension in two parts, and the number of rows as dimension -1."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = from_bytes(batch.column("key"))
            # Halves of 32 bits sum without overflow for 2 ** 31 rows of a task.
            now = np.stack([x >> 32, x & 0xFFFFFFFF]).sum(axis=1)
            total, n = now if total is None else total + now, n + len(x)
    if total is not None:
        index = np.arange(-1, total.shape[1])
        high, low = np.concatenate([[0], total[0]]), np.concatenate([[n], total[1]])
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["i", "high", "low"])


def _products(of_rows: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """``i, j, v``: sums of products of the columns that ``of_rows`` makes of the vectors; only pairs i <= j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = of_rows(from_bytes(batch.column("key").slice(at, ROWS)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None and total.size:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def _matrix(fit: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of products over all of ``fit``; size * size numbers come to the driver."""
    rows = fit.select("key").mapInArrow(_products(of_rows), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("v").to_numpy()
    return out


# ---------------------------------------------------------------- QDWH


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without eigenvalues at 0, by QDWH iterations."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    # A lower bound of the least singular value; one too small costs a round, not accuracy.
    try:
        low = max(0.9 / np.linalg.norm(np.linalg.inv(x)), 1e-17)
    except np.linalg.LinAlgError:
        low = 1e-17
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        p = np.sqrt(1 + d) + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
            new = q / r * x + (p - q / r) / np.sqrt(r) * both[:n] @ both[n:].T
        else:
            lower = np.linalg.cholesky(eye + r * x.T @ x)
            new = q / r * x + (p - q / r) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        low = min(1.0, low * (p + q * l2) / (1 + r * l2))
        new = (new + new.T) / 2
        done = np.linalg.norm(new - x) < 1e-5 and 1 - low < 1e-8
        x = new
        if done:
            break
    return x


def _split(a: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None if an eigenvalue is too near to it."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    above = int(round(np.trace(projector)))
    if not 0 < above < n or np.linalg.norm(projector @ projector - projector) > 1e-7:
        return None
    # The range by a block of random vectors, projected twice; its complement completes the basis.
    block = projector @ np.random.default_rng(seed).standard_normal((n, above))
    basis, _ = np.linalg.qr(projector @ np.linalg.qr(block)[0], mode="complete")
    return basis[:, :above], basis[:, above:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    n, norm = len(a), np.linalg.norm(a)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [np.eye(n)]
    while waiting:
        basis = waiting.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        size = len(block)
        if size == 1 or np.linalg.norm(block - np.diag(np.diag(block))) <= 4 * np.finfo(float).eps * norm:
            parts.append((np.diag(block), basis))
            continue
        # The mean and the middle of the diagonal lie between the eigenvalues.
        diagonal = np.sort(np.diag(block))
        middle, mean = float(np.median(diagonal)), float(diagonal.mean())
        spread = np.linalg.norm(block - mean * np.eye(size)) / np.sqrt(size)
        tries = [middle, mean, *(mean + f * spread for f in (0.1, -0.1, 0.03, -0.03, 0.31, -0.31, 0.007, -0.007))]
        for seed, shift in enumerate(tries):
            halves = _split(block, shift, seed)
            if halves is not None:
                waiting += [basis @ half for half in halves]
                break
        else:
            raise ArithmeticError("no shift splits the spectrum")
    values = np.concatenate([v for v, _ in parts])
    vectors = np.concatenate([b for _, b in parts], axis=1)
    # One round against what rounding left: orthonormal again, values as quotients.
    order = np.argsort(-values, kind="stable")
    vectors, upper = np.linalg.qr(vectors[:, order])
    vectors = vectors * np.sign(np.diag(upper))
    return np.einsum("ij,ij->j", vectors, a @ vectors), vectors


# ---------------------------------------------------------------- the operator


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: counts and sums, components as columns, their eigenvalues (0: no spread), the trace."""

    size: int
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None
    scale: float = SCALE

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles; the whole part of the mean is subtracted exactly."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s - self.n * (s // self.n)) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        """The components with spread, whitened; others are NaN."""
        roots = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return self.centred(x) @ self.vectors / roots

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exact; None beyond 63 bits."""
        ends = zip(x.min(axis=0).tolist(), x.max(axis=0).tolist(), self.sums)
        most = max(abs(self.n * v - s) for low, high, s in ends for v in (low, high))
        if self.size * most * most <= _LAST and max(map(abs, self.sums)) <= _LAST:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e <= _LAST else None for e in exact]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> Whitening | None:
    """Fits to the distinct vectors of the table; None if there are none."""
    tables.on_executors(vectors.sparkSession)
    packed = vectors.select(F.col(vector_col).alias("vector")).mapInArrow(_packed(scale), "size int, key binary")
    # The key begins with its width, so it is distinct by itself.
    distinct = tables.store(packed.distinct(), "vectors")
    of_size = distinct.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not of_size:
        return None
    size = of_size[0]["size"]
    distinct = distinct.where(F.col("size") == size)
    rows = distinct.select("key").mapInArrow(_sums, "i int, high long, low long").groupBy("i")
    wide = "decimal(38,0)"
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows.agg(*[F.sum(F.col(c).cast(wide)).alias(c) for c in ("high", "low")]).collect()}
    n, sums = sums[-1], tuple(sums[i] for i in range(size))
    start = Whitening(size, n, sums, np.zeros((size, 0)), np.zeros(0), 0.0, None, scale)
    covariance = _matrix(distinct, start.centred, size) / n
    values, basis = spectrum(covariance) if np.any(covariance) else (np.zeros(size), np.eye(size))
    trace = float(np.trace(covariance))
    # What rounding alone may leave of a component is no spread.
    values = np.where(values > size * np.finfo(float).eps * trace * 4, values, 0.0)[:components]
    model = Whitening(size, n, sums, basis[:, :components], values, trace, None, scale)
    kept = int((values > 0).sum())
    if not kept:
        return model
    whitened = _matrix(distinct, lambda x: model.projected(x)[:, :kept], kept) / n
    error = float(np.abs(whitened - np.eye(kept)).max())
    return Whitening(size, n, sums, model.vectors, values, trace, error, scale)


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    tables.on_executors(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = model.vectors.shape[1]
        share = pa.array([v / model.trace if model.trace else None for v in model.values], pa.float64())
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                batch = big.slice(at, ROWS)
                entries, offsets, whole = vectors_of(batch.column("vector"))
                rows = np.flatnonzero(whole & (np.diff(offsets) == model.size))
                if not len(rows):
                    continue
                x = quantise(entries[offsets[rows][:, None] + np.arange(model.size)], model.scale)
                each = np.repeat(np.arange(len(rows)), many)
                component = np.tile(np.arange(many), len(rows))
                out = model.projected(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(rows[each])), pa.array(component + 1, pa.int32()), pa.array([model.n] * len(each), pa.int64()),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(each)), pa.array(out, mask=np.isnan(out)),
                        share.take(pa.array(component)), pa.array([model.identity_error] * len(each), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_col)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.read(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))
