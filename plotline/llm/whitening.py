"""Operator 11: whitening of embeddings by Chebyshev-filtered subspace iteration.

An entry c stands for the integer x = floor(1024 * c) + 100000. The leading eigenvectors of
the covariance V of all x-vectors come from passes over the table that return VQ, the sum of
centred xᵀ(xQ) over all rows, for a block Q of some thirty columns; V itself is never built.

1. ``blocks``: usable vectors as blocks of small integers, written once.
2. Exact sums of every dimension, so that rows are centred before they are multiplied.
3. Two blocks of a Krylov space give the start and, by the least Ritz value less its
   residual, the lower end of the spectrum. Each round then damps the interval between that
   end and the smallest Ritz value kept by a Chebyshev polynomial of V, one pass for each
   degree, and ends with QR and Rayleigh-Ritz.
4. Rounds end when the residuals of all wanted pairs are certified: |Vq - eq| at most
   ``RESIDUAL`` times the largest eigenvalue.

A pass sends one row for each task and dimension to a map-side combined sum; the driver
holds dimensions x columns numbers, whatever the rows. A lost task is read again from the
written blocks.

Results in odd cases: vectors that are null, empty or hold null or non-finite entries, or
entries whose x is no 64-bit integer, take no part; rows without an id do, and repeated
rows count each time. Vectors of different lengths are fitted apart. There are as many
components as V has eigenvalues above rounding, so a table of one distinct vector gives no
rows. Equal eigenvalues give any orthonormal basis of their space, one for all rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import durable

SCALE, SHIFT = 1024, 100000
BLOCK_BYTES = 1 << 20
DEGREE = 12
RESIDUAL = 1e-13
ROUNDS = 100
BLOCK = "dims int, ids array<long>, kind string, data binary"
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def usable(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all vectors of a column (length 0: takes no part) and the values scaled by 1024."""
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE)
        wrong = ~(np.abs(values) < 2.0 ** 62)
    before = np.r_[0, np.cumsum(wrong)]
    ends = lists.offsets.to_numpy().astype(np.int64)
    fine = (before[ends[1:]] == before[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
    return ends[:-1], np.where(fine, np.diff(ends), 0), values


def blocks(vectors: DataFrame) -> DataFrame:
    """floor(1024 * c) of all usable vectors, in blocks of one length, by the narrowest integers that hold them."""
    def run(batches):
        for batch in batches:
            starts, lengths, values = usable(batch.column("vector"))
            for dims in np.unique(lengths[lengths > 0]).tolist():
                chosen = np.flatnonzero(lengths == dims)
                step = max(1, BLOCK_BYTES // (8 * dims))
                for at in range(0, len(chosen), step):
                    rows = chosen[at:at + step]
                    x = values[starts[rows][:, None] + np.arange(dims)].astype(np.int64)
                    kind = next(k for k in ("int16", "int32", "int64") if x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max)
                    ids = batch.column("vec_id").take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids),
                         pa.array([kind]), pa.array([x.astype(kind).tobytes()])], names=["dims", "ids", "kind", "data"])
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).mapInArrow(run, BLOCK)


def opened(batch: pa.RecordBatch):
    """(dims, ids, x without the shift) of every block of a batch."""
    for i in range(batch.num_rows):
        dims = batch.column("dims")[i].as_py()
        ids = batch.column("ids")[i].values if "ids" in batch.schema.names else None
        yield dims, ids, np.frombuffer(batch.column("data")[i].as_buffer(), batch.column("kind")[i].as_py()).reshape(-1, dims)


def moments(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For every length the number of vectors and the exact sums S of their x."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for dims, _, x in opened(batch):
                wide = x.dtype == np.int64
                sums = x.astype(object).sum(axis=0) if wide else x.sum(axis=0, dtype=np.int64).astype(object)
                n, total = held.get(dims, (0, 0))
                held[dims] = [n + len(x), total + sums]
        for dims, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                 pa.array([Decimal(int(s) + SHIFT * n) for s in total], pa.decimal128(38, 0))], names=["dims", "place", "n", "s"])
    rows = (table.select("dims", "kind", "data").mapInArrow(run, "dims int, place int, n long, s decimal(38,0)")
            .groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r.dims, r.place)):
        out.setdefault(r.dims, (r.n, []))[1].append(int(r.s))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double precision: whole parts are taken off as integers first."""
    whole = np.array([s // n - SHIFT for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x.astype(np.int64) - whole).astype(np.float64) - part


def totals(table: DataFrame, width: int, part) -> dict[int, np.ndarray]:
    """The sum over all blocks of ``part(dims, x)``, arrays of ``width`` columns, for every length; None is left out."""
    names = [f"c{i}" for i in range(width)]

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in opened(batch):
                got = part(dims, x)
                if got is not None:
                    held[dims] = held[dims] + got if dims in held else got
        for dims, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()),
                                              *(pa.array(total[:, i]) for i in range(width))], names=["dims", "place", *names])
    schema = "dims int, place int, " + ", ".join(f"{c} double" for c in names)
    rows = (table.select("dims", "kind", "data").mapInArrow(run, schema)
            .groupBy("dims", "place").agg(*(F.sum(c).alias(c) for c in names)).collect())
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.dims, r.place)):
        out.setdefault(r.dims, []).append(r[2:])
    return {dims: np.array(rows) for dims, rows in out.items()}


class Spectrum:
    """The eigenpairs of one length's covariance, in the making."""

    def __init__(self, dims: int, k: int):
        self.dims, self.k = dims, min(k, dims)
        self.columns = min(dims, 2 * k + 8)
        whole = self.columns == dims
        self.basis = np.eye(dims) if whole else np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, self.columns)))[0]
        self.low, self.done, self.rounds, self.worst = 0.0, False, 0, np.inf

    def beside(self, image: np.ndarray) -> np.ndarray:
        """An orthonormal basis of what V adds to the start: the next block of its Krylov space."""
        rest = image - self.basis @ (self.basis.T @ image)
        u, size, _ = np.linalg.svd(rest - self.basis @ (self.basis.T @ rest), full_matrices=False)
        return u[:, (size > 1e-10 * np.abs(image).max(initial=0))][:, :self.dims - self.columns]

    def settle(self, image: np.ndarray) -> None:
        """Rayleigh-Ritz over the basis, whose image under V is given."""
        h = self.basis.T @ image
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        self.values = values[order]
        basis, image = self.basis @ vectors[:, order], image @ vectors[:, order]
        residuals = np.linalg.norm(image - basis * self.values, axis=0)
        if self.rounds == 0:
            self.low = max(0.0, self.values[-1] - residuals[-1])
        self.basis, self.image, self.values = basis[:, :self.columns], image[:, :self.columns], self.values[:self.columns]
        self.worst = float(residuals[:self.k].max())
        self.rounds += 1
        self.done = self.worst <= RESIDUAL * max(self.values[0], 0.0) or self.values[0] <= 0
        if not self.done and self.rounds > ROUNDS:
            raise RuntimeError(f"not certified after {ROUNDS} rounds: residual {self.worst}, largest eigenvalue {self.values[0]}")

    def start_filter(self) -> np.ndarray:
        """The first step of the recurrence needs no pass: the image of the basis is known."""
        high = max(self.values[-1], self.low * (1 + 1e-12), 1e-300)
        self.half, self.mid = max((high - self.low) / 2, 1e-12 * self.values[0]), (high + self.low) / 2
        self.sigma = self.first = self.half / (self.values[0] - self.mid)
        self.before, self.now = self.basis, (self.image - self.mid * self.basis) * (self.sigma / self.half)
        return self.now

    def step(self, image: np.ndarray) -> np.ndarray:
        """The three-term recurrence, scaled so that the largest eigenvalue keeps its size."""
        sigma = 1 / (2 / self.first - self.sigma)
        self.before, self.now = self.now, (image - self.mid * self.now) * (2 * sigma / self.half) - self.before * (self.sigma * sigma)
        self.sigma = sigma
        return self.now

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues above rounding, largest first, and their unit eigenvectors."""
        above = self.values[:self.k] > 1e-14 * self.dims * max(self.values[0], 0.0)
        return self.values[:self.k][above], self.basis[:, :self.k][:, above]


def fitted(table: DataFrame, stats: dict[int, tuple[int, list[int]]], k: int, degree: int = DEGREE) -> dict[int, Spectrum]:
    """Certified eigenpairs of every length's covariance."""
    spectra = {dims: Spectrum(dims, k) for dims in stats}

    def images(of: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        if not of:
            return {}
        width = max(q.shape[1] for q in of.values())

        def part(dims, x):
            if dims not in of:
                return None
            rows = centred(x, *stats[dims])
            out = np.zeros((dims, width))
            out[:, :of[dims].shape[1]] = rows.T @ (rows @ of[dims]) / stats[dims][0]
            return out
        return {dims: v[:, :of[dims].shape[1]] for dims, v in totals(table, width, part).items()}

    first = images({d: s.basis for d, s in spectra.items()})
    beside = {d: s.beside(first[d]) for d, s in spectra.items() if s.columns < d}
    second = images({d: q for d, q in beside.items() if q.shape[1]})
    for d, s in spectra.items():
        if d in second:
            s.basis = np.hstack([s.basis, beside[d]])
        s.settle(np.hstack([first[d], second[d]]) if d in second else first[d])
    while open_ := {d: s for d, s in spectra.items() if not s.done}:
        now = {d: s.start_filter() for d, s in open_.items()}
        for _ in range(degree - 1):
            got = images(now)
            now = {d: s.step(got[d]) for d, s in open_.items()}
        for d, s in open_.items():
            s.basis = np.linalg.qr(np.linalg.qr(now[d])[0])[0]
        got = images({d: s.basis for d, s in open_.items()})
        for d, s in open_.items():
            s.settle(got[d])
    return spectra


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum over dimensions of (n * x - S)²; null beyond 38 digits."""
    whole = np.array([s // n - SHIFT for s in sums], np.int64)
    part = [s % n for s in sums]
    gap = x.astype(np.int64) - whole
    if n * (int(np.abs(gap).max(initial=0)) + 1) < 2 ** 31 and len(sums) * (n * (int(np.abs(gap).max(initial=0)) + 1)) ** 2 < 2 ** 63:
        return pa.array(((n * gap - np.array(part, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    exact = ((n * gap.astype(object) - np.array(part, object)) ** 2).sum(axis=1)
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact.tolist()], pa.decimal128(38, 0))


def whitened(vectors: DataFrame, k: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component up to k."""
    table = durable(blocks(vectors))
    stats = moments(table)
    model: dict[int, tuple] = {}
    for dims, s in fitted(table, stats, k).items():
        values, units = s.found()
        if len(values):
            model[dims] = values, units / np.sqrt(values)
    means, trace = _check(table, stats, model, k)
    spread = totals(table, k, lambda dims, x: _products(dims, x, stats, model, means, k)) if model else {}
    shown = {}
    for dims, (values, units) in model.items():
        m = len(values)
        error = float(np.abs(spread[dims][:m, :m] / stats[dims][0] - np.eye(m)).max())
        shown[dims] = units, values / trace[dims], error

    def run(batches):
        for batch in batches:
            for dims, ids, x in opened(batch):
                if dims not in shown:
                    continue
                units, explained, error = shown[dims]
                m, n = units.shape[1], stats[dims][0]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(len(x)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * m, n, np.int64)), deviations(x, *stats[dims]).take(pa.array(np.repeat(np.arange(len(x)), m))),
                     pa.array((centred(x, *stats[dims]) @ units).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(x) * m, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return table.mapInArrow(run, WHITENED)


def _check(table: DataFrame, stats: dict, model: dict, k: int) -> tuple[dict, dict]:
    """Means of the whitened values, and the traces of the covariances."""
    if not model:
        return {}, {}

    def part(dims, x):
        if dims not in model:
            return None
        rows, units = centred(x, *stats[dims]), model[dims][1]
        out = np.zeros((2, k))
        out[0, :units.shape[1]] = (rows @ units).sum(axis=0)
        out[1, 0] = (rows * rows).sum()
        return out
    got = totals(table, k, part)
    return {d: v[0] / stats[d][0] for d, v in got.items()}, {d: v[1, 0] / stats[d][0] for d, v in got.items()}


def _products(dims: int, x: np.ndarray, stats: dict, model: dict, means: dict, k: int):
    if dims not in model:
        return None
    units = model[dims][1]
    m = units.shape[1]
    w = centred(x, *stats[dims]) @ units - means[dims][:m]
    out = np.zeros((k, k))
    out[:m, :m] = w.T @ w
    return out
