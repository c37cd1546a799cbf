"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without ever forming it:
one pass over the vectors computes ``V Q`` for a narrow block ``Q`` as the sum of
``x (x' Q)`` over centred rows. A round filters the block with a Chebyshev
polynomial of ``V`` that is small on the unwanted spectrum (from 0, as ``V`` has
no negative eigenvalue, to the smallest Ritz value of the block), each degree
being one pass of the three-term recurrence; QR and Rayleigh-Ritz follow on the
driver, on matrices of ``dimensions x block``. Rounds go on until the residual
``|V u - e u|`` of every wanted pair is at rounding level; pairs that stop
improving above that raise an error, so what is returned is certified. The
degree of a round is held so low that the largest eigenvector, amplified most,
does not drown the others.

Vectors are whole numbers, ``floor(scale * c) + offset``, staged once as packed
64-bit integers in the shared folder; ``n x - S`` is exact, so centring loses
nothing. A task keeps one ``dimensions x block`` sum, whatever its rows; the
tasks' sums meet in a shuffle by dimension, and the driver gets one row per
dimension.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
are left out. Vectors have one length: the most frequent (the longer on a tie); others lack
entries and are left out too. Null ids, repeated ids and repeated rows are kept,
each row counting once. Eigenvalues below 1e-12 of the trace give no component (one
row, or equal rows: no component, hence no rows; fewer than ``k`` dimensions:
fewer components). Equal eigenvalues give an orthonormal basis of their space.
An entry too large for 64 bits is an error. Extra columns are left out. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage, table
from ledgerloom.llm.registry import query

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Columns of the block beyond those wanted.
GUARD = 24
DEGREE = 12
#: The most that a filter may amplify the largest eigenvector over the last wanted one.
SPREAD = 1e4
#: A residual this small against the largest eigenvalue is certified; one that stalls above the second is an error.
ROUNDING, STALLED = 4e-15, 1e-11
NULL_SPACE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``n`` rows with sums ``s``; unit ``vectors`` (columns) by falling ``values``."""

    n: int
    s: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def _pack(scale: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").cast(pa.large_list(pa.float64()))
            y = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            if len(y) and np.abs(y).max() >= 2.0 ** 62:
                raise ArithmeticError("an embedding entry does not fit in 64 bits")
            x = (y.astype(np.int64) + offset).astype("<i8")
            size = np.diff(lists.offsets.to_numpy())
            ends = np.concatenate([[0], np.cumsum(size)]) * 8
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int32()), packed.cast(pa.binary())],
                names=["id", "size", "x"])
    return run


def vectors_of(df: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = SCALE,
               offset: int = OFFSET) -> tuple[DataFrame, int, int]:
    """(staged (id, x) with x packed whole numbers; rows; dimensions)."""
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")) \
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & ok)
    packed = stage(rows.mapInArrow(_pack(scale, offset), f"id {rows.schema['id'].dataType.simpleString()}, "
                                   "size int, x binary"), "vectors")
    length = packed.groupBy("size").count().agg(F.max_by(F.struct("size", "count"), F.struct("count", "size"))).first()[0]
    if length is None:
        return packed, 0, 0
    return packed.where(F.col("size") == length["size"]).select("id", "x"), length["count"], length["size"]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype="<i8", count=len(column) * d, offset=at).reshape(-1, d)


def _centred(column: pa.Array, n: int, s: np.ndarray) -> np.ndarray:
    return (n * _matrix(column, len(s)) - s) / n


def _summed(rows: DataFrame, d: int, width: int, kind: str, partial) -> np.ndarray:
    """The sum over all rows of ``partial(x column)``, a ``d x width`` matrix for each batch."""
    dtype = np.int64 if kind == "long" else np.float64
    names = [f"q{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((d, width), dtype), False
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column("x"))
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)),
                                              *[pa.array(total[:, j]) for j in range(width)]], names=["i", *names])

    sums = rows.select("x").mapInArrow(run, "i int, " + ", ".join(f"{c} {kind}" for c in names)) \
        .groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
    got = np.zeros((d, width), dtype)
    for r in sums.collect():
        got[r[0]] = r[1:]
    return got


def fit(rows: DataFrame, n: int, d: int, k: int = COMPONENTS, seed: int = 11) -> Whitening:
    """The ``k`` leading components of the covariance of ``vectors_of``'s rows."""
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    s = _summed(rows, d, 1, "long", lambda x: _matrix(x, d).sum(axis=0)[:, None])[:, 0]
    b, passes, trace = min(d, k + GUARD), 0, 0.0
    k = min(k, d)

    def times(q: np.ndarray) -> np.ndarray:
        """V q; the last column carries the variance of each dimension along."""
        nonlocal passes, trace

        def partial(column):
            x = _centred(column, n, s)
            return np.column_stack([x.T @ (x @ q), np.einsum("ij,ij->j", x, x)])

        passes += 1
        got = _summed(rows, d, b + 1, "double", partial) / n
        trace = float(got[:, b].sum())
        return got[:, :b]

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    best, stalls = np.inf, 0
    while True:
        w = times(q)
        values, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top = max(float(values[0]), 0.0)
        residual = float(np.linalg.norm(w[:, :k] - q[:, :k] * values[:k], axis=0).max()) / top if top else 0.0
        stalls = 0 if residual < best / 2 else stalls + 1
        best = min(best, residual)
        if b == d or residual <= ROUNDING * np.sqrt(d):
            break
        if stalls >= 3:
            if residual > STALLED:
                raise ArithmeticError(f"components not certified: residual {residual:.3g}")
            break
        cut = max(float(values[-1]), top * 1e-14)
        gain = np.arccosh(np.maximum(2 * values[[0, k - 1]] / cut - 1, 1.0))
        degree = int(np.clip(np.log(SPREAD) / max(gain[0] - gain[1], 1e-9), 2, DEGREE))
        before, block = q, 2 / cut * w - q
        for _ in range(degree - 1):
            before, block = block, 2 * (2 / cut * times(block) - block) - before
        # By the largest entry first: the square of one may not fit in a double.
        q = block / np.maximum(np.abs(block).max(axis=0), 1e-300)
        q /= np.maximum(np.linalg.norm(q, axis=0), 1e-300)
        for _ in range(2):
            q = np.linalg.qr(q)[0]
    found = values[:k] > NULL_SPACE * trace
    return Whitening(n, s, values[:k][found], q[:, :k][:, found], trace, residual, passes)


def _whitened(m: Whitening):
    turn = m.vectors / np.sqrt(m.values)

    def apply(column: pa.Array) -> np.ndarray:
        return _centred(column, m.n, m.s) @ turn
    return apply


def identity_error(rows: DataFrame, m: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k, white = len(m.values), _whitened(m)
    if not k:
        return 0.0

    def partial(column):
        w = white(column)
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    got = _summed(rows, k, k + 1, "double", partial) / m.n
    mean = got[:, k]
    return float(np.abs(got[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _exact_squares(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - S) squared, exactly."""
    dev = n * x - s
    most = int(np.abs(dev).max()) if dev.size else 0
    if most * most * x.shape[1] < 2 ** 63:
        return pa.array((dev * dev).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(v * v for v in row) for row in dev.tolist()], pa.decimal128(38, 0))


def whiten(rows: DataFrame, m: Whitening) -> DataFrame:
    """(id, component, deviation, whitened, explained): a row for each vector and component."""
    k, d, white = len(m.values), len(m.s), _whitened(m) if len(m.values) else None
    explained = m.values / m.trace if k else m.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.num_rows
            if not (r and k):
                continue
            at = np.repeat(np.arange(r), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                 _exact_squares(_matrix(batch.column("x"), d), m.n, m.s).take(pa.array(at)),
                 pa.array(white(batch.column("x")).reshape(-1)), pa.array(np.tile(explained, r))],
                names=["id", "component", "deviation", "whitened", "explained"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, component int, deviation decimal(38,0), "
                           "whitened double, explained double")


@query("op11_whitening")
def op11_whitening(spark, sf_dir) -> DataFrame:
    rows, n, d = vectors_of(table(spark, sf_dir, "embeddings"))
    m = fit(rows, n, d)
    return whiten(rows, m).select(
        F.col("id").alias("vec_id"), "component", F.lit(m.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", "explained",
        F.lit(identity_error(rows, m)).alias("identity_error"), F.lit(m.residual).alias("residual"))
