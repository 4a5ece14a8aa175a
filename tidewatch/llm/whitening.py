"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become whole numbers, floor(scale * entry), so every sum is exact and the same on any layout. A shift
added to all of them would cancel in each result, as everything is centred first.

1. One pass counts the vectors and sums each dimension; the centre is the mean rounded to a whole number.
2. A second pass multiplies the centred numbers. A task adds up products of blocks small enough for
   floating point to be exact; the sums of tasks meet as decimals. With the exact rest of the mean the
   driver holds n * n times the covariance as whole numbers, and rounds once, entry by entry.
3. The driver factors the d x d covariance with complete pivoting, V = L L', up to its rank, and rotates
   pairs of columns of L until all are orthogonal: squared norms are the eigenvalues, normalised columns
   the components. Nothing else reaches the driver, so its share depends on d alone.
4. A map projects each vector. The covariance of what it gives is summed again over all vectors, which
   yields the error stated beside the result.

Defined cases: vectors that are null or hold null or non-finite entries are left out of the fit and the
result; a vector shorter than the longest sound one lacks entries, which counts as null entries; entries
whose scaled size passes 2^46 count as that size; repeated rows count as often as they occur; rows without
an id stay; there are as many components as the covariance has rank (none for an empty table, one vector or
equal vectors, so the result is empty); a component's sign makes its largest entry positive; squared
deviations beyond a long are null in ``deviation`` and whole in ``deviation_exact``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import written
from tidewatch.llm.registry import query

SCALE, COMPONENTS = 64, 32
_LARGEST = 1 << 46  # size of a scaled entry
_BLOCK = 1 << 13  # rows multiplied at once: products below 2^40 add up exactly in doubles
_SMALL = 1 << 20
_FLUSH = 512
_EXACT = pa.decimal128(38, 0)


def _sound(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each row's vector, -1 where it is unsound; row of each entry; entries) of a list column."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    lengths[owner[~np.isfinite(entries)]] = -1
    return lengths, owner, entries


def _whole(entries: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(entries * scale), -_LARGEST, _LARGEST).astype(np.int64)


def _matrix(column: pa.Array, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their whole numbers) of the sound vectors of length ``d``."""
    lengths, owner, entries = _sound(column)
    kept = lengths == d
    return np.flatnonzero(kept), _whole(entries[kept[owner]], scale).reshape(-1, d)


def _decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], _EXACT)


def _totals(vectors: DataFrame, scale: int) -> DataFrame:
    """(length, dim, n, total) of the sound vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            lengths, owner, entries = _sound(batch.column(0))
            for d in np.unique(lengths[lengths > 0]).tolist():
                kept = lengths == d
                part = _whole(entries[kept[owner]], scale).reshape(-1, d)
                held = sums.setdefault(d, [0, np.zeros(d, object)])
                held[0] += len(part)
                for lo in range(0, len(part), _BLOCK):
                    held[1] = held[1] + part[lo : lo + _BLOCK].sum(axis=0).astype(object)
        for d, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([d] * d, pa.int32()), "dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": _decimals(total),
            })

    parts = vectors.mapInArrow(run, "length int, dim int, n bigint, total decimal(38,0)")
    return parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class _Scatter:
    """Exact sums of the products of a task's rows."""

    def __init__(self, d: int) -> None:
        self.whole, self.part, self.held = np.zeros((d, d), object), np.zeros((d, d), np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        large = np.abs(rows).max(axis=1, initial=0) >= _SMALL
        for lo in range(0, len(rows), _BLOCK):
            block = rows[lo : lo + _BLOCK][~large[lo : lo + _BLOCK]].astype(float)
            self.part += (block.T @ block).astype(np.int64)
            self.held += 1
            if self.held == _FLUSH:
                self.flush()
        for row in rows[large].astype(object):  # products beyond 2^40, one by one
            self.whole = self.whole + np.multiply.outer(row, row)

    def flush(self) -> np.ndarray:
        self.whole, self.held = self.whole + self.part, 0
        self.part[:] = 0
        return self.whole


def _scatter(vectors: DataFrame, d: int, scale: int, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of the products of entries less ``centre``, of each pair of dimensions."""
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Scatter(d)
        for batch in batches:
            held.add(_matrix(batch.column(0), d, scale)[1] - centre)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "p": _decimals(held.flush()[i, j])})

    parts = vectors.mapInArrow(run, "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p"))
    return {(r.i, r.j): int(r.p) for r in parts.collect()}  # one row per pair of dimensions


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L): v[order][:, order] = L L' with L lower trapezoidal, its columns as many as the rank."""
    d = len(v)
    order, low, left = np.arange(d), np.zeros((d, d)), np.diag(v).copy()
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return order, low[:, :k]
        for a in (order, left, low):
            a[[k, p]] = a[[p, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (v[order[k + 1 :], order[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return order, low


def orthogonal_columns(low: np.ndarray, turns: int = 60) -> np.ndarray:
    """The factor with pairs of its columns rotated until all are orthogonal (one-sided Jacobi).

    A turn meets every pair once; the pairs of a round are disjoint and rotated together.
    """
    g = low.copy()
    r = g.shape[1]
    seats = np.arange(r + r % 2)
    tiny = np.finfo(float).eps
    for _ in range(turns):
        rotated = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            a, b = seats[:half], seats[half:][::-1]
            real = (a < r) & (b < r)
            p, q = np.minimum(a[real], b[real]), np.maximum(a[real], b[real])
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            do = np.abs(gamma) > tiny * np.sqrt(alpha * beta)
            if do.any():
                rotated = True
                p, q, x, y = p[do], q[do], x[:, do], y[:, do]
                zeta = (beta[do] - alpha[do]) / (2 * gamma[do])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, p], g[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not rotated:
            break
    return g


@dataclass(frozen=True)
class Whitening:
    """What the fit keeps: ``centre`` and ``rest`` give the mean, ``values`` and ``components`` the spectrum."""

    n: int
    scale: int
    centre: np.ndarray  # whole numbers, without the shift
    rest: list[int]  # sums of the centred numbers; the mean is centre + rest / n
    values: np.ndarray  # falling eigenvalues
    components: np.ndarray  # one a row
    trace: float

    def projected(self, rows: np.ndarray) -> np.ndarray:
        """Whitened values of centred rows."""
        off = np.array([r / self.n for r in self.rest])
        return (rows - off) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, rows: np.ndarray) -> list[int]:
        """Sums over the dimensions of (n * x - total)^2, exact."""
        if np.abs(rows).max(initial=0) >= _SMALL:
            return [sum((self.n * int(z) - q) ** 2 for z, q in zip(row, self.rest)) for row in rows.tolist()]
        squares, mixed = (rows * rows).sum(axis=1), rows @ np.array(self.rest, np.int64)
        fixed = sum(q * q for q in self.rest)
        return [self.n * self.n * s - 2 * self.n * m + fixed for s, m in zip(squares.tolist(), mixed.tolist())]


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The model of a one-column frame of array<double>; None where no component has any variance."""
    totals = written(_totals(vectors, scale), "dimension-sums")
    d = totals.agg(F.max("length")).first()[0]
    if not d:
        return None
    rows = totals.where(F.col("length") == d).orderBy("dim").collect()  # one row per dimension
    n, total = rows[0]["n"], [int(r["total"]) for r in rows]
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, centre)]
    products = _scatter(vectors, d, scale, np.array(centre, np.int64))
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    order, low = pivoted_cholesky(v)
    if not low.shape[1]:
        return None
    turned = orthogonal_columns(low)
    values = (turned * turned).sum(axis=0)
    falling = np.argsort(-values, kind="stable")[:components]
    found = np.zeros((len(falling), d))
    found[:, order] = (turned[:, falling] / np.sqrt(values[falling])).T
    found *= np.where(found[np.arange(len(found)), np.abs(found).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, scale, np.array(centre, np.int64), rest, values[falling], found, float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened values differs from the identity, summed over all vectors."""
    k, d = model.components.shape
    i, j = np.triu_indices(k)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, products, sums = sent.value, np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = m.projected(_matrix(batch.column(0), d, m.scale)[1] - m.centre)
            products += w.T @ w
            sums += w.sum(axis=0)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([*i, *range(k)], pa.int32()), "j": pa.array([*j, *[-1] * k], pa.int32()), "p": pa.array([*products[i, j], *sums], pa.float64()),
        })

    # Decimals, so that the order in which tasks end does not change the sums.
    parts = vectors.mapInArrow(run, "i int, j int, p double").groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,14)")).alias("p"))
    total = {(r.i, r.j): float(r.p) for r in parts.collect()}  # one row per pair of components
    mean = [total[a, -1] / model.n for a in range(k)]
    return max(abs(total[a, b] / model.n - mean[a] * mean[b] - (a == b)) for a, b in zip(i.tolist(), j.tolist()))


def whitened(df: DataFrame, model: Whitening, key: str, vector: str) -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened) of the sound vectors: exact squared deviation, one value per component."""
    d = model.components.shape[1]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            kept, rows = _matrix(batch.column(1), d, m.scale)
            rows = rows - m.centre
            w, deviations = m.projected(rows), m.deviations(rows)
            ends = pa.array(np.arange(len(kept) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(kept)), "deviation": pa.array([x if x < 1 << 63 else None for x in deviations], pa.int64()),
                "deviation_exact": _decimals(deviations), "whitened": pa.ListArray.from_arrays(ends, pa.array(w.ravel())),
            })

    plain = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "vec_id bigint, deviation bigint, deviation_exact decimal(38,0), whitened array<double>")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) per sound vector and component."""
    vectors = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    model = fit(vectors, components, scale)
    if model is None:
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return df.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    error = identity_error(vectors, model)
    long = whitened(df, model, key, vector).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
