"""Whitening of embeddings along their principal components, found by a randomised range finder.

A random block of directions, a few more than the components asked for, is multiplied by the covariance over and over:
each power pass reads all rows, centres them and sums (row - mean) (row - mean)' Q, so only a matrix of dimensions by
directions leaves a task. After each pass the Rayleigh-Ritz step gives the best components within the block, and their
residuals tell how exact they are. If these fall too slowly to meet the tolerance within a number of passes, the block
is doubled, up to as many directions as dimensions; then it spans everything and the components are exact.

Entries are taken on a grid of whole numbers, floor(scale * entry) + shift, so that sums and deviations are exact.

Defined results: rows whose vector is null or holds null, infinite or not-a-number entries go; shorter vectors count as
padded with zeros up to the longest; entries beyond +-2^48 of the grid count as that; repeated rows and ties of vec_id
are kept one by one, a null vec_id too; components without variance (all vectors equal, or fewer rows than components)
are left out, so an empty table or equal vectors give no rows; a deviation beyond a long is null; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, BOUND = 1024.0, 100_000, 1 << 48
COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 8, 6, 13
#: How far a component may be off, and the share of the largest eigenvalue that its residual may have at any rate, being rounding.
TOLERANCE, FLOOR = 1e-12, 16 * float(np.finfo(float).eps)
#: Entries of vectors worked on at once, and partial sums that are added up before the driver adds the rest.
BLOCK_ENTRIES, PARTS = 1 << 20, 16


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: (x - sums / n) @ components / sqrt(eigenvalues), x on the grid."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: float
    shift: int
    passes: int
    directions: int


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows whose vector is there and has finite entries only; entries as doubles."""
    vec = F.col(vec_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & F.coalesce(F.forall(vec, finite), F.lit(False))).select(F.col(id_col).alias("vec_id"), vec.alias("vec"))


def blocks(batch: pa.RecordBatch, dims: int, scale: float, shift: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors on the grid) of a batch, in pieces of bounded size."""
    ids, vecs = batch.column(0), batch.column(1)
    step = max(1, BLOCK_ENTRIES // max(dims, 1))
    for at in range(0, batch.num_rows, step):
        part = vecs.slice(at, step)
        offsets = part.offsets.to_numpy().astype(np.int64)
        flat = part.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        lengths = np.diff(offsets)
        if (lengths == dims).all():
            dense = flat.reshape(-1, dims)
        else:
            dense = np.zeros((len(lengths), dims))
            dense[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
        yield ids.slice(at, step), np.clip(np.floor(dense * scale), -BOUND, BOUND).astype(np.int64) + shift


def added(vectors: DataFrame, dims: int, scale: float, shift: int, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of work(block) over all blocks of all rows, `size` numbers of float64: tasks add their own, a few tasks add those, the driver adds the last."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, x in blocks(batch, dims, scale, shift):
                total += work(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % PARTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for t in batch.column(1):
                total += np.frombuffer(t.as_py())
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    schema = "part int, total binary"
    rows = vectors.mapInArrow(own, schema).repartition(PARTS, "part").mapInArrow(together, schema).collect()  # at most PARTS rows
    return sum((np.frombuffer(r["total"]) for r in rows), np.zeros(size))


def exact_sums(vectors: DataFrame, dims: int, scale: float, shift: int) -> tuple[int, np.ndarray]:
    """(n, sums) as whole numbers, exact: tasks split sums into halves of 32 bits before they are added as decimals."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            for _, x in blocks(batch, dims, scale, shift):
                n += len(x)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high, low)]
        cols = [pa.array(range(-1, dims), pa.int32()), pa.array([str(v) for v in (n, *total)], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "total"])

    parts = vectors.mapInArrow(own, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got = {r["dim"]: int(r["total"]) for r in parts.collect()}  # one row a dimension
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(dims)], object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n in double precision: n * x - sums is a whole number, and one division rounds it."""
    return deviations(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact; in Python's integers only where a long can't hold it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    return x * n - sums.astype(np.int64) if top < 1 << 62 else x.astype(object) * n - sums


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Of each row the sum of squares of n * x - sums, exact."""
    d = deviations(x, n, sums)
    if d.dtype != object and x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, scale: float = SCALE, shift: int = SHIFT, seed: int = SEED) -> Whitening:
    """The components of (vec_id, vec), all rows counted; vectors is read once for the sums and once for each power pass."""
    dims = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    n, sums = exact_sums(vectors, dims, scale, shift) if dims else (0, np.zeros(0, object))
    k = min(components, dims)
    if n == 0 or k == 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, scale, shift, 0, 0)
    random = np.random.default_rng(seed)
    width, since, done, before = min(dims, k + oversample), 0, 0, 0.0
    basis = np.linalg.qr(random.standard_normal((dims, width)))[0]
    while True:
        q = basis

        def product(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums)
            return np.concatenate(((z.T @ (z @ q)).ravel(), [(z * z).sum()]))

        got = added(vectors, dims, scale, shift, dims * width + 1, product) / n
        image, trace = got[:-1].reshape(dims, width), float(got[-1])
        done, since = done + 1, since + 1
        small = q.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz = q @ turns
        residual = np.linalg.norm(image @ turns - ritz * values, axis=0)[:k]
        # A vector is off by its residual over the distance to the nearest other eigenvalue; below the floor it is rounding.
        apart = np.array([np.abs(np.delete(values, j) - values[j]).min(initial=max(values[j], 0.0)) for j in range(k)])
        worst, goal = (residual / np.maximum(tolerance * apart, FLOOR * max(values[0], 1e-300))).max(), 1.0
        if width == dims or worst <= goal:
            break
        gain = worst / before if since > 1 else 0.0
        before = worst
        if since < passes and worst * gain ** (passes - since) <= goal:
            basis = np.linalg.qr(image)[0]
        else:  # not exact yet: keep what is found and add as many random directions again
            more = random.standard_normal((dims, min(dims, 2 * width) - width))
            basis, since = np.linalg.qr(np.concatenate((ritz, more), axis=1))[0], 0
            width = basis.shape[1]
    held = [j for j in range(k) if values[j] > 1e-12 * max(trace, 0.0)]
    return Whitening(n, sums, ritz[:, held], values[held], trace, scale, shift, done, width)


def whiten(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every row: one pass, no shuffle."""
    dims = len(fit.sums)
    turn = fit.components / np.sqrt(fit.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in blocks(batch, dims, fit.scale, fit.shift):
                far = [v if v < 1 << 63 else None for v in squares(x, fit.n, fit.sums)]
                white = centred(x, fit.n, fit.sums) @ turn
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays([ids, pa.array(far, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """The largest entry, without sign, of the whitened rows' covariance less the identity, over all rows."""
    turn, k = fit.components / np.sqrt(fit.eigenvalues), len(fit.eigenvalues)

    def product(x: np.ndarray) -> np.ndarray:
        w = centred(x, fit.n, fit.sums) @ turn
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

    got = added(vectors, len(fit.sums), fit.scale, fit.shift, k * k + k, product) / fit.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitening_digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for every valid vector and component: its whitened coordinate, and what the fit says of the component."""
    kept = valid_vectors(vectors)
    fit = fit_whitening(kept, components)
    if not len(fit.eigenvalues):
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))).limit(0)
    error = identity_error(kept, fit)
    shares = F.array(*(F.lit(float(e / fit.trace)) for e in fit.eigenvalues))
    rows = whiten(kept, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
