"""Whitening of embeddings by an incremental eigendecomposition of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, written

_EPS = np.finfo(float).eps
SPECTRUM = "part long, n long, sums array<decimal(38,0)>, mean array<double>, vals array<double>, vecs array<double>"
_SPECTRUM = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("vals", pa.list_(pa.float64())), ("vecs", pa.list_(pa.float64()))])
#: Entries are held within this of 0 after scaling; a double has no finer parts beyond it.
_MOST = 2.0**52


def roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots m of 1 + sum(z**2 / (d - m)), and the matrix m[i] - d[j]. d rises strictly, and no z is 0.

    A root is sought as its distance from the nearer of the two poles around it. Each step puts a pole term with the value
    and slope of the sum at its side in place of that sum and solves the quadratic; where it leaves the bracket, it is halved.
    """
    k, w = len(d), z * z
    right = np.append(d[1:], d[-1] + w.sum())
    middle = d + (right - d) / 2
    nearer = (1 + (w / (d - middle[:, None])).sum(axis=1) < 0) & (np.arange(k) < k - 1)
    origin = np.where(nearer, right, d)
    delta = d - origin[:, None]
    low = np.where(nearer, -(right - d) / 2, 0.0)
    high = np.where(nearer, 0.0, np.append((right - d)[:-1] / 2, w.sum()))
    at, own, end = low + (high - low) / 2, d - origin, right - origin
    left = np.tri(k)
    for _ in range(100):
        inverse = 1 / (delta - at[:, None])
        squares, held = inverse * inverse, inverse * left
        before, total, fall, slope = held @ w, inverse @ w, (held * inverse) @ w, squares @ w
        value, size = 1 + total, 1 + total - 2 * before
        if (np.abs(value) <= _EPS * (8 * size + np.abs(at) * slope)).all():  # what rounding leaves
            break
        low, high = np.where(value < 0, at, low), np.where(value >= 0, at, high)
        rise = slope - fall
        a, b = own - at, end - at
        s, r = a * a * fall, b * b * rise
        c = 1 + before - a * fall + (total - before) - b * rise
        p, q = c * (a + b) + s + r, a * b * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            move = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            move[-1] = -a[-1] * a[-1] * value[-1] / (s[-1] - a[-1] * value[-1])  # it has no pole to its right
        step = at + move
        bad = ~((step >= low) & (step <= high) & (step != own) & (step != end))
        step[bad] = (low + (high - low) / 2)[bad]
        if (step == at).all():
            break
        at = step
    return origin + at, at[:, None] - delta


def updated(vals: np.ndarray, vecs: np.ndarray, x: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vecs diag(vals) vecs' + weight x x', for a weight of 0 or more.

    - Deflation: directions that x hardly has stay, and of directions with equal values one takes all of x's share after a
      reflection. The others follow from the secular equation.
    - Vectors are of the x for which the roots are exact, so they are orthogonal however near the roots are.
    """
    z = vecs.T @ x * np.sqrt(weight)
    norm = np.sqrt(z @ z)
    small = 8 * _EPS * max(np.abs(vals).max(), norm * norm)
    if norm * norm <= small * _EPS:
        return vals, vecs
    order = np.argsort(vals, kind="stable")
    vals, vecs, z = vals[order], vecs[:, order], z[order]
    edges = np.flatnonzero(np.diff(vals) > small) + 1
    if len(edges) < len(vals) - 1:
        for start, end in zip([0, *edges], [*edges, len(vals)], strict=True):
            length = np.sqrt(z[start:end] @ z[start:end])
            if end - start > 1 and length * norm > small:
                v = z[start:end].copy()
                v[-1] += np.copysign(length, v[-1])
                block = vecs[:, start:end]
                vecs[:, start:end] = block - np.outer(block @ v, v) * (2 / (v @ v))
                z[start : end - 1], z[end - 1] = 0, -np.copysign(length, z[end - 1])
    active = np.flatnonzero(np.abs(z) * norm > small)
    if not len(active):
        return vals, vecs
    d = vals[active]
    new, far = roots(d, z[active])
    k = len(d)
    shifted = np.append(d[1:], d[-1])
    below = np.arange(k)[:, None] < np.arange(k)
    gaps = np.where(below, d[:, None] - d, shifted[:, None] - d)
    gaps[-1] = 1
    exact = np.copysign(np.sqrt(np.abs(np.prod(far / gaps, axis=0))), z[active])
    turn = (exact / far).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vals[active], vecs[:, active] = new, vecs[:, active] @ turn
    return vals, vecs


@dataclass
class Spectrum:
    """Rows seen so far: their number, exact sums, mean, and the eigenvalues and eigenvectors of their centred scatter."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vals: np.ndarray
    vecs: np.ndarray

    @staticmethod
    def none(size: int) -> Spectrum:
        return Spectrum(0, [0] * size, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """Rows of whole numbers, each a centred rank-one update; equal rows are one of their number."""
        rows, times = np.unique(x, axis=0, return_counts=True)
        high, low = x >> 24, x & 0xFFFFFF
        self.sums = [s + (int(h) << 24) + int(l) for s, h, l in zip(self.sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
        for row, w in zip(rows, times.tolist(), strict=True):
            away = row - self.mean
            self.vals, self.vecs = updated(self.vals, self.vecs, away, self.n * w / (self.n + w))
            self.n += w
            self.mean = self.mean + away * (w / self.n)

    def join(self, other: Spectrum) -> None:
        """Rows of another spectrum: an update for each of its directions, and one for the distance of the means."""
        n = self.n + other.n
        for i in np.flatnonzero(other.vals > 0):
            self.vals, self.vecs = updated(self.vals, self.vecs, other.vecs[:, i], other.vals[i])
        away = other.mean - self.mean
        if n:
            self.vals, self.vecs = updated(self.vals, self.vecs, away, self.n * other.n / n)
            self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def batch(self, part: int) -> pa.RecordBatch:
        row = [part, self.n, [Decimal(s) for s in self.sums], self.mean, self.vals, self.vecs.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SPECTRUM, strict=True)], schema=_SPECTRUM)

    @staticmethod
    def read(row: dict) -> Spectrum:
        size = len(row["vals"])
        return Spectrum(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["vals"]), np.array(row["vecs"]).reshape(size, size))


@dataclass
class Whitening:
    """What `whiten` needs: n, exact sums, the trace of the covariance, and values and vectors (columns) by falling value."""

    n: int
    sums: list[int]
    trace: float
    vals: np.ndarray
    vecs: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id and x, an array of longs floor(scale * c) + shift, of the rows whose vectors can be used.

    Rows go whose vector is null, empty, or holds a null or an entry that isn't finite. If lengths differ, only rows of the
    most frequent length stay, the shortest of these. Scaled entries beyond 2**52 on either side are held there.
    """
    finite = F.forall(vector_col, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(vector_col, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-_MOST)), F.lit(_MOST))).cast("long") + shift)
    fit = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite)
    rows = written(fit.select(F.col(id_col).alias("vec_id"), scaled.alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), "k").limit(2).collect()  # two rows
    return rows.filter(F.size("x") == sizes[0].k) if len(sizes) > 1 else rows


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(batch.num_rows, -1)


def spectra(rows: DataFrame, fan_in: int = 8) -> Spectrum | None:
    """The spectrum of all rows (x): one for each task, joined by `fan_in` in rounds until one is left. Null without rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                seen = seen or Spectrum.none(x.shape[1])
                for i in range(0, len(x), 1024):
                    seen.add(x[i : i + 1024])
        if seen:
            yield seen.batch(TaskContext.get().partitionId())

    def joined(group: pa.Table) -> pa.Table:
        first, *rest = sorted(group.to_pylist(), key=lambda r: r["part"])
        seen = Spectrum.read(first)
        for row in rest:
            seen.join(Spectrum.read(row))
        return pa.Table.from_batches([seen.batch(first["part"])])

    parts, n = counted(rows.select("x").mapInArrow(each, SPECTRUM), "spectra")
    while n > 1:
        groups = -(-n // fan_in)
        dealt = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
        parts, n = counted(dealt.groupBy("group").applyInArrow(lambda t: joined(t.drop_columns(["group"])), SPECTRUM), "joined")
    found = parts.first()
    return Spectrum.read(found.asDict()) if found else None


def _gram(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, fan_in: int = 8) -> np.ndarray:
    """The scatter of all rows, centred and then projected on the columns of `basis`."""
    size = basis.shape[1]
    schema = "part long, sums array<double>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch) - mean) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "sums": [total.ravel()]})

    def added(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("part")
        return pa.table({"part": ordered.column("part")[:1], "sums": [np.sum([np.array(v) for v in ordered.column("sums").to_pylist()], axis=0)]})

    parts, n = counted(rows.select("x").mapInArrow(each, schema), "scatter")
    while n > 1:
        groups = -(-n // fan_in)
        dealt = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))
        parts, n = counted(dealt.groupBy("group").applyInArrow(added, schema), "added")
    return np.array(parts.first().sums).reshape(size, size)


def fit(rows: DataFrame) -> Whitening | None:
    """The spectrum of the covariance (divisor n) of `whole_vectors`; null without rows.

    1. Each task starts from nothing and updates the eigenvalues and eigenvectors of its rows' centred scatter, row by row,
       by the secular equation. 2. Spectra are joined in a tree, direction by direction. 3. All rows are projected on the
    vectors found (made orthogonal again), and the small matrix of their scatter gives the final ones (Rayleigh-Ritz).
    What a task or the driver holds is a few square matrices of the vectors' length, however many rows there are.
    """
    seen = spectra(rows)
    if seen is None:
        return None
    mean = np.array([s / seen.n for s in seen.sums])
    basis = np.linalg.qr(seen.vecs[:, np.argsort(-seen.vals)])[0]
    vals, turn = np.linalg.eigh(_gram(rows, mean, basis) / seen.n)
    order = np.argsort(-vals, kind="stable")
    return Whitening(seen.n, seen.sums, float(vals.sum()), vals[order], basis @ turn[:, order])


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the sum of (n * x - sums)**2, exactly; null where it is beyond a long."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(x).max(initial=0))
    away = (x * np.int64(n) - np.array(sums, np.int64)) if most < 1 << 62 else x.astype(object) * n - np.array(sums, object)
    if x.size and int(np.abs(away).max()) ** 2 * x.shape[1] >= 1 << 62:
        away = away.astype(object)
    return [v if v < 1 << 63 else None for v in map(int, (away * away).sum(axis=1))]


def whiten(vectors: DataFrame, n_components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Fit the covariance of all vectors and whiten each by its first components.

    Returns vec_id, component (int, from 1), n, deviation (long), whitened, explained and identity_error (double), a row for
    each usable vector and component; `whole_vectors` tells which vectors are usable and what becomes of their entries.

    - Components are the first `n_components` unit eigenvectors by falling eigenvalue. Fewer come out if the vectors are
      shorter or vary in fewer directions (a value of 1e-12 of the sum of all, or less, is none), and none if all are equal.
    - deviation is null where it is beyond a long. identity_error is measured over the whitened rows themselves.
    - Repeated rows are each returned and count each; null ids stay null. An empty table gives no rows. Other columns are
      not used.
    """
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    out = out.format(rows.schema["vec_id"].dataType.simpleString())
    model = fit(rows)
    k = 0 if model is None else int((model.vals[:n_components] > 1e-12 * model.trace).sum())
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    n, sums, mean, vals = model.n, model.sums, model.mean, model.vals[:k]
    turn, explained = model.vecs[:, :k] / np.sqrt(vals), vals / model.trace
    error = float(np.abs(_gram(rows, mean, turn) / n - np.eye(k)).max())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch) if batch.num_rows else np.zeros((0, len(sums)), np.int64), batch.num_rows
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(exact_deviation(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviation, ((x - mean) @ turn).ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(each, out)
