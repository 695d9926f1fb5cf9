"""Whitening of embeddings by a block Golub-Kahan-Lanczos bidiagonalisation.

Each step multiplies the centred rows X with a block of vectors V and the product's columns with X transposed, in one
pass over the distinct rows; bases on both sides are fully reorthogonalised. A left basis vector is a combination of
the columns of X, so it is kept as its few coefficients and never as a column over all rows. The singular value
decomposition of the small block bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import _shared as S


@dataclass(frozen=True)
class Lanczos:
    """Parameters. A step's pass over the rows serves `block` vectors; equal eigenvalues are all found, up to so many."""

    components: int = 4
    block: int = 8
    seed: int = 20262
    #: Residuals of the wanted components, relative to the largest singular value, at which no further step is made.
    tolerance: float = 1e-15


_PACKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])
_EDGE = 2.0**63


def integers(values: np.ndarray, scale: float = 256.0) -> np.ndarray:
    """floor(scale * values) as 64-bit integers; what lies beyond their range becomes the nearest of them."""
    f = np.floor(values * scale)
    with np.errstate(invalid="ignore"):
        out = f.astype(np.int64)
    out[f >= _EDGE] = np.iinfo(np.int64).max
    out[f < -_EDGE] = np.iinfo(np.int64).min
    return out


def pack(x: np.ndarray) -> bytes:
    """A vector of integers in the narrowest width that holds it, so equal vectors are equal bytes."""
    for kind in (np.int16, np.int32):
        if len(x) and np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind).tobytes()
    return x.astype(np.int64).tobytes()


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    if len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), kinds[len(packed[0]) // dims]).reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(p, kinds[len(p) // dims]) for p in packed], np.int64).reshape(-1, dims)


def _pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        lists, keep, dims, packed = t.column(1), [], [], []
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN, null lists nothing
        ends = np.cumsum(sizes)
        for at, (size, end) in enumerate(zip(sizes, ends, strict=True)):
            v = values[end - size : end]
            if size and np.isfinite(v).all():
                keep.append(at)
                dims.append(size)
                packed.append(pack(integers(v)))
        rows = pa.array(keep, pa.int64())
        yield S.batch(_PACKED.names, [t.column(0).take(rows), t.column(2).take(rows), dims, packed], _PACKED)


def packed_rows(table: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """vec_id, label, dims, x: rows with a vector of finite entries, its entries times 256 rounded down, packed."""
    label = F.col(label_col) if label_col else F.lit(None)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), label.cast("long").alias("label"))
    return rows.mapInArrow(_pack_rows, "vec_id long, label long, dims int, x binary")


def usual_dims(rows: DataFrame) -> int | None:
    """The most frequent number of entries (the larger one of a tie)."""
    r = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return r["dims"] if r else None


def _sums(dims: int):
    def run(batches):
        n, total = 0, [0] * dims
        for t in batches:
            x = unpack(t.column(0).to_pylist(), dims) if t.num_rows else np.zeros((0, dims), np.int64)
            part = x.sum(axis=0) if not len(x) or np.abs(x.astype(float)).max() < 2.0**40 else x.astype(object).sum(axis=0)
            total, n = [a + int(b) for a, b in zip(total, part, strict=True)], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], names=["slot", "value"])

    return run


def _slots(value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["slot", "value"])


def _gather(fit: DataFrame, run, kind: str) -> list:
    """What the tasks of run yield, summed by slot: as many numbers reach the driver however many tasks there are."""
    rows = fit.mapInArrow(run, f"slot int, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["slot"])]


def _products(dims: int, mean: np.ndarray, v: np.ndarray, left: np.ndarray):
    """Of the centred rows X: the squares' sum, W'W, X'W and (X left)'W for W = X v."""

    def run(batches):
        b, k = v.shape[1], left.shape[1]
        trace, gram, back, dots = 0.0, np.zeros((b, b)), np.zeros((dims, b)), np.zeros((k, b))
        for t in batches:
            if t.num_rows:
                x = unpack(t.column(0).to_pylist(), dims) - mean
                w = x @ v
                trace += float((x * x).sum())
                gram += w.T @ w
                back += x.T @ w
                dots += (x @ left).T @ w
        yield _slots(np.concatenate([[trace], gram.ravel(), back.ravel(), dots.ravel()]))

    return run


def _rest(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vectors = vectors - basis @ (basis.T @ vectors)
    return vectors


def bidiagonalise(fit: DataFrame, dims: int, mean: np.ndarray, p: Lanczos) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, their singular values, the squares' sum) of the centred rows of fit (column x)."""
    random = np.random.default_rng(p.seed)
    block, eps = min(max(p.block, p.components), dims), np.finfo(float).eps
    new = np.linalg.qr(random.standard_normal((dims, block)))[0]
    v, left, z = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))  # right basis; left basis as coefficients of X; X'U
    small, link = np.zeros((0, 0)), np.zeros((0, block))  # X V = U small; what ties the new block to the last left one
    while True:
        r = link.shape[0]
        q = new - left[:, left.shape[1] - r :] @ link
        got = np.array(_gather(fit, _products(dims, mean, q, left), "double"))
        b, k = q.shape[1], left.shape[1]
        trace, gram, back, dots = got[0], got[1 : 1 + b * b].reshape(b, b), got[1 + b * b : 1 + b * b + dims * b].reshape(dims, b), got[1 + b * b + dims * b :].reshape(k, b)
        q, back, gram = q - left @ dots, back - z @ dots, gram - dots.T @ dots
        g, e = np.linalg.eigh((gram + gram.T) / 2)
        keep = g > eps * max(trace / dims, g.max(initial=0.0))
        root, e = np.sqrt(g[keep]), e[:, keep]
        column = dots.copy()
        column[k - r :] += link
        small = np.block([[small, column], [np.zeros((len(root), small.shape[1])), root[:, None] * e.T]])
        left, z, v = np.hstack([left, (q @ e) / root]), np.hstack([z, (back @ e) / root]), np.hstack([v, new])
        u_s, s, vt = np.linalg.svd(small, full_matrices=False)
        room = dims - v.shape[1]
        if room == 0 or not len(s) or trace == 0:
            break
        y, size, h = np.linalg.svd(_rest(z[:, z.shape[1] - len(root) :], v), full_matrices=False)
        ties = size > eps * s[0]
        y, tied = y[:, ties][:, :room], (size[:, None] * h)[ties][:room]
        wanted = u_s[len(u_s) - len(root) :, : p.components]
        if len(s) >= p.components and np.linalg.norm(tied @ wanted, axis=0).max(initial=0.0) <= p.tolerance * s[0]:
            break
        if (more := min(block, room) - y.shape[1]) > 0:  # the space is used up: go on outside it
            y = np.hstack([y, np.linalg.qr(_rest(random.standard_normal((dims, more)), np.hstack([v, y])))[0]])
        new = np.linalg.qr(_rest(y, v))[0]
        link = np.zeros((len(root), new.shape[1]))
        link[:, : len(tied)] = tied.T
        turn = np.sign((new * y).sum(axis=0))  # qr may flip signs
        new = new * turn
    m = int((s[: p.components] ** 2 > dims * eps * s[0] ** 2).sum()) if len(s) and s[0] > 0 else 0
    found = v @ vt[:m].T
    found /= np.linalg.norm(found, axis=0)
    return found * np.sign(found[np.abs(found).argmax(axis=0), range(m)]), s[:m], float(trace)


def _covariance(dims: int, mean: np.ndarray, turn: np.ndarray):
    def run(batches):
        m = turn.shape[1]
        total, square = np.zeros(m), np.zeros((m, m))
        for t in batches:
            if t.num_rows:
                y = (unpack(t.column(0).to_pylist(), dims) - mean) @ turn
                total += y.sum(axis=0)
                square += y.T @ y
        yield _slots(np.concatenate([total, square.ravel()]))

    return run


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _signed(v: int) -> int:
    return (v + 2**63) % 2**64 - 2**63


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n*x - S)^2, exact; null from 10^38 on.

    64-bit arithmetic is exact modulo 2^64, so it is right wherever the result fits; the other rows take whole numbers of any size.
    """
    s = np.array([_signed(v) for v in sums], np.int64)
    with np.errstate(over="ignore"):
        out = np.int64(_signed(n * n)) * (x * x).sum(axis=1) - np.int64(_signed(2 * n)) * (x * s).sum(axis=1) + np.int64(_signed(sum(v * v for v in sums)))
    about = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(axis=1)
    if not (large := np.flatnonzero(about > 9.2e18)).size:
        return pa.array(out).cast(pa.decimal128(38, 0), safe=False)
    exact = {i: sum((n * int(a) - b) ** 2 for a, b in zip(x[i], sums, strict=True)) for i in large}
    return pa.array([None if (v := exact.get(i, int(y))) >= 10**38 else Decimal(v) for i, y in enumerate(out)], pa.decimal128(38, 0))


def _apply(dims: int, n: int, sums: list[int], turn: np.ndarray, explained: np.ndarray, error: float):
    mean, m = np.array([s / n for s in sums]), turn.shape[1]

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            x = unpack(t.column(1).to_pylist(), dims)
            each = pa.array(np.repeat(np.arange(len(x)), m))
            y = (x - mean) @ turn
            columns = [t.column(0).take(each), np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(len(x) * m, n), deviations(x, n, sums).take(each), y.ravel(), np.tile(explained, len(x)), np.full(len(x) * m, error)]
            yield S.batch(_OUT.names, columns, _OUT)

    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: Lanczos = Lanczos()) -> DataFrame:
    """A row for each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null or a number that isn't finite are dropped, and so are vectors whose
    number of entries isn't the table's most frequent one. Entries times 256 are rounded down to integers (nearest long
    beyond their range). The fit list is each distinct vector once. deviation is decimal(38,0), null from 10^38 on. There
    are fewer components than asked for if the fit list has fewer directions, none at all if all vectors are equal. Null
    and repeated ids and repeated rows are rows like any other, further columns aren't read, an empty table gives an empty result.
    """
    spark = table.sparkSession
    S.prepare(spark)
    rows = S.materialise(packed_rows(table, id_col, vector_col).drop("label"), "vectors")
    none = S.empty(spark, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if (dims := usual_dims(rows)) is None:
        return none
    rows = rows.filter(F.col("dims") == dims).select("vec_id", "x")
    fit = S.materialise(rows.select("x").distinct(), "fit")
    *sums, n = (int(v) for v in _gather(fit, _sums(dims), "decimal(38,0)"))
    mean = np.array([s / n for s in sums])
    found, s, trace = bidiagonalise(fit, dims, mean, params)
    if not (m := len(s)):
        return none
    turn = found / (s / np.sqrt(n))
    got = np.array(_gather(fit, _covariance(dims, mean, turn), "double"))
    centre = got[:m] / n
    error = float(np.abs(got[m:].reshape(m, m) / n - np.outer(centre, centre) - np.eye(m)).max())
    return rows.mapInArrow(_apply(dims, n, sums, turn, s**2 / trace, error), "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
