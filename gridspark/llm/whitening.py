"""Operator 13: whitening of embeddings by incremental eigendecomposition.

Every task keeps a spectrum: number of rows, mean, and eigenvalues and eigenvectors of their scatter matrix.  A row is
one centred rank-one update: deflation of what the update doesn't move, roots of the secular equation for the rest,
and eigenvectors from the recomputed update vector.  Two spectra are joined by successive rank-one updates, one
for each eigenpair of the second and one for the distance of the means, level by level in tasks.  The spectrum
of all rows is then only a basis: a pass over all rows projects them on it, and the eigenpairs of that projected
covariance (Rayleigh-Ritz) are exact to double precision whatever error the updates have gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.scratch import settle

#: Components returned, factor of the integer entries (their offset changes no result), and spectra joined by one task.
COMPONENTS, SCALE, FAN_IN = 8, 1024, 8
#: Spectra that a task forms side by side, at most.
LANES = 16
#: Entries beyond this don't become a long.
LARGEST = float(1 << 62)
_LOW_BITS, _EPS = 31, np.finfo(float).eps
_SPECTRUM = "d int, n long, mean binary, eigenvalues binary, eigenvectors binary, low binary, high binary"
_SUMS = "d int, i int, j int, v double"


@lru_cache(maxsize=4)
def _workspace(lanes: int, k: int) -> tuple[np.ndarray, ...]:
    """Large arrays that every update uses again: getting fresh memory for them costs more than the arithmetic."""
    return tuple(np.empty((lanes, k, k)) for _ in range(5))


def secular_roots(poles: np.ndarray, after: np.ndarray, square: np.ndarray, iterations: int = 30, tolerance: float = 1e-14) -> np.ndarray:
    """Differences poles[j] - root[i] (lane, j, i) for the roots of 1 + sum_j square[j] / (poles[j] - x), in every lane.

    Poles ascend and are distinct; those that take no part are infinite with square 0, and their columns mean nothing.
    ``after`` is the next pole of each (infinite for the last).  Root i lies between its pole and the next one, the last
    within sum(square) of its pole.  Each is sought from the nearer pole, by the rational function with the two
    neighbouring poles that has the same value and the same slopes of both halves of the sum; a step that
    leaves the root's bracket is a bisection.
    """
    lanes, k = poles.shape
    last = np.isinf(after)
    gap = np.where(last, square.sum(axis=1, keepdims=True), after - poles)
    below = np.tri(k).T  # row j, column i: j <= i
    away, terms, other, from_pole, _ = _workspace(lanes, k)
    np.subtract(poles[:, :, None], poles[:, None, :], out=away)
    np.subtract(away, gap[:, None, :] / 2, out=away)
    np.divide(square[:, :, None], away, out=terms)
    left = last | (1 + terms.sum(axis=1) >= 0)
    origin = np.where(left, poles, after)
    np.subtract(poles[:, :, None], origin[:, None, :], out=from_pole)
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, np.where(last, gap, gap / 2), 0.0)
    pole1, pole2 = poles - origin, np.where(last, 0.0, after - origin)
    at = (low + high) / 2
    for _ in range(iterations):
        np.subtract(from_pole, at[:, None, :], out=away)
        np.divide(square[:, :, None], away, out=terms)
        f = 1 + terms.sum(axis=1)
        np.abs(terms, out=other)
        open_ = np.abs(f) > tolerance * (1 + other.sum(axis=1))
        if not open_.any():
            return away
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        np.divide(terms, away, out=terms)
        np.multiply(terms, below, out=other)
        psi = other.sum(axis=1)
        phi = terms.sum(axis=1) - psi
        d1, d2 = pole1 - at, pole2 - at
        a, b, c = (d1 + d2) * f - d1 * d2 * (psi + phi), d1 * d2 * f, f - d1 * psi - d2 * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(last, d1 + psi * d1 ** 2 / (f - psi * d1), step)
        new = at + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        at = np.where(open_, new, at)
    np.subtract(from_pole, at[:, None, :], out=away)
    return away


class Spectra:
    """Several spectra side by side (lanes): number, mean, ascending eigenvalues and eigenvectors (columns) of the rows so far.

    Every operation works on all lanes at once; a lane that gets a zero vector stays as it is.
    """

    def __init__(self, lanes: int, d: int):
        self.n, self.mean = np.zeros(lanes), np.zeros((lanes, d))
        self.values, self.vectors = np.zeros((lanes, d)), np.broadcast_to(np.eye(d), (lanes, d, d)).copy()

    def rank_one(self, v: np.ndarray) -> None:
        """Add v v' to the scatter matrix of each lane."""
        with np.errstate(all="ignore"):
            self._rank_one(v)

    def _rank_one(self, v: np.ndarray) -> None:
        z = (v[:, None, :] @ self.vectors)[:, 0]
        size = (z * z).sum(axis=1, keepdims=True)
        top = np.maximum(np.abs(self.values).max(axis=1, keepdims=True), size)
        tolerance = 8 * _EPS * top
        z = self._turn_null_space(z, self.values <= tolerance)
        kept = np.abs(z) * np.sqrt(size) > tolerance
        after = self._next(kept)
        here = np.where(np.isinf(after), 0.0, self._next_of(z, kept))
        close = kept & ~np.isinf(after) & (np.abs((after - self.values) * z * here) <= tolerance * (z ** 2 + here ** 2))
        for lane in np.flatnonzero(close.any(axis=1)):
            self._merge_close(lane, z[lane], kept[lane], float(tolerance[lane, 0]))
        if close.any():
            after = self._next(kept)
        d = z.shape[1]
        poles = np.where(kept, self.values, np.inf)
        away = secular_roots(poles, after, np.where(kept, z ** 2, 0.0))
        roots = np.where(kept, self.values - np.diagonal(away, axis1=1, axis2=2), self.values)
        # the update vector whose exact roots these are: its eigenvectors are orthogonal however exact the roots
        earlier = np.tri(d, k=-1, dtype=bool)  # row j, column i: i < j
        turn, spare = _workspace(*z.shape)[1], _workspace(*z.shape)[4]
        np.copyto(turn, after[:, None, :])
        np.copyto(turn, self.values[:, None, :], where=earlier)
        np.subtract(turn, self.values[:, :, None], out=turn)
        np.copyto(turn, -1.0, where=np.isinf(after)[:, None, :] & ~earlier)
        np.divide(away, turn, out=turn)
        np.negative(turn, out=turn, where=~(np.isinf(after)[:, None, :] & ~earlier))
        every = bool(kept.all())
        if not every:
            np.copyto(turn, 1.0, where=~kept[:, None, :])
        moved = np.where(kept, np.sign(z) * np.sqrt(np.maximum(turn.prod(axis=2), 0.0)), 0.0)
        np.divide(moved[:, :, None], away, out=turn)
        if not every:
            np.copyto(turn, 0.0, where=~(kept[:, :, None] & kept[:, None, :]))
        np.multiply(turn, turn, out=spare)
        length = np.sqrt(spare.sum(axis=1))
        fine = kept & np.isfinite(length) & (length > 0)
        if fine.all():
            np.divide(turn, length[:, None, :], out=turn)
        else:
            turn = np.where(fine[:, None, :], turn / length[:, None, :], np.eye(d))
        np.matmul(self.vectors, turn, out=spare)
        np.copyto(self.vectors, spare)
        self.values = roots
        if (self.values[:, 1:] < self.values[:, :-1]).any():
            order = np.argsort(self.values, axis=1, kind="stable")
            self.values = np.take_along_axis(self.values, order, axis=1)
            self.vectors = np.take_along_axis(self.vectors, order[:, None, :], axis=2)

    def _next(self, kept: np.ndarray) -> np.ndarray:
        """For each place the value of the next kept one, infinite behind the last."""
        poles = np.where(kept, self.values, np.inf)
        out = np.full_like(poles, np.inf)
        out[:, :-1] = np.minimum.accumulate(poles[:, ::-1], axis=1)[:, ::-1][:, 1:]
        return out

    @staticmethod
    def _next_of(z: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """For each place the z of the next kept one."""
        d = z.shape[1]
        place = np.where(kept, np.arange(d), d)
        after = np.full_like(place, d)
        after[:, :-1] = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, 1:]
        return np.take_along_axis(np.append(z, np.zeros((len(z), 1)), axis=1), after, axis=1)

    def _turn_null_space(self, z: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Reflect the eigenvectors of value zero so that the update only meets the last of them."""
        many = null.sum(axis=1) > 1
        if not many.any():
            return z
        d = z.shape[1]
        last = d - 1 - np.argmax(null[:, ::-1], axis=1)
        own = np.where(null & many[:, None], z, 0.0)
        size = np.sqrt((own * own).sum(axis=1))
        mirror = own.copy()
        mirror[np.arange(len(z)), last] -= size * many
        norm = (mirror * mirror).sum(axis=1)
        scale = np.where(norm > 0, 2 / np.where(norm > 0, norm, 1.0), 0.0)
        self.vectors -= (self.vectors @ mirror[:, :, None]) * (scale[:, None] * mirror)[:, None, :]
        out = np.where(null & many[:, None], 0.0, z)
        out[np.arange(len(z))[many], last[many]] = size[many]
        return out

    def _merge_close(self, lane: int, z: np.ndarray, kept: np.ndarray, tolerance: float) -> None:
        """Turn pairs of (almost) equal eigenvalues so that the update moves only one of each."""
        values, vectors = self.values[lane], self.vectors[lane]
        now = None
        for j in np.flatnonzero(kept).tolist():
            if now is not None:
                length = float(np.hypot(z[now], z[j]))
                c, s = z[j] / length, -z[now] / length
                if abs((values[j] - values[now]) * c * s) <= tolerance:
                    a, b = vectors[:, now].copy(), vectors[:, j].copy()
                    vectors[:, now], vectors[:, j] = c * a + s * b, c * b - s * a
                    low, high = values[now], values[j]
                    values[now], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
                    z[now], z[j], kept[now] = 0.0, length, False
            now = j

    def add(self, rows: np.ndarray, times: np.ndarray) -> None:
        """Take in one row per lane that stands ``times`` times (0: none)."""
        total = self.n + times
        share = times / np.maximum(total, 1)
        away = rows - self.mean
        self.rank_one(away * np.sqrt(self.n * share)[:, None])
        self.mean = self.mean + away * share[:, None]
        self.n = total

    def joined(self) -> Spectra:
        """Half as many lanes: each takes in the rows of its partner, eigenpair by eigenpair."""
        half = -(-len(self.n) // 2)
        out = self._some(slice(0, half))
        other = self._some(slice(half, None))
        missing = half - len(other.n)
        n = np.append(other.n, np.zeros(missing))
        pad = lambda x: np.concatenate([x, np.zeros((missing, *x.shape[1:]))]) if missing else x
        mean, scaled = pad(other.mean), pad(other.vectors * np.sqrt(np.maximum(other.values, 0.0))[:, None, :])
        for i in range(scaled.shape[2]):
            if scaled[:, :, i].any():
                out.rank_one(scaled[:, :, i])
        share = n / np.maximum(out.n + n, 1)
        away = mean - out.mean
        out.rank_one(away * np.sqrt(out.n * share)[:, None])
        out.mean = out.mean + away * share[:, None]
        out.n = out.n + n
        return out

    def _some(self, lanes: slice) -> Spectra:
        out = Spectra.__new__(Spectra)
        out.n, out.mean, out.values, out.vectors = (x[lanes].copy() for x in (self.n, self.mean, self.values, self.vectors))
        return out

    def one(self) -> Spectra:
        out = self
        while len(out.n) > 1:
            out = out.joined()
        return out

    @staticmethod
    def stacked(parts: list[Spectra]) -> Spectra:
        out = Spectra.__new__(Spectra)
        out.n, out.mean, out.values, out.vectors = (np.concatenate([getattr(p, c) for p in parts]) for c in ("n", "mean", "values", "vectors"))
        return out


def lanes_for(rows: int, d: int) -> int:
    """Lanes of a task: so many that joining them costs less than the rows do."""
    return max(1, min(LANES, 1 << max(0, (rows // (8 * d)).bit_length() - 1)))


def integer_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, floor(1024 c) of their entries) of the usable vectors, by length."""
    column = batch.column("embedding")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(column.offsets.to_numpy()), 0)
    ends = np.cumsum(sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        entries = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)  # nulls become NaN
        bad = np.append(0, np.cumsum(~(np.abs(entries) < LARGEST)))
    usable = valid & (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for d in np.unique(sizes[usable]).tolist():
        places = np.flatnonzero(usable & (sizes == d))
        yield places, entries[(ends[places] - d)[:, None] + np.arange(d)].astype(np.int64)


def fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spectrum of a task's rows, and the exact sums of their entries in two parts."""
    own: dict[int, list] = {}
    for batch in batches:
        for _, rows in integer_rows(batch):
            d = rows.shape[1]
            if d not in own:
                own[d] = [Spectra(lanes_for(len(rows), d), d), np.zeros((2, d), np.int64)]
            spectra = own[d][0]
            own[d][1] += [(rows & (1 << _LOW_BITS) - 1).sum(axis=0), (rows >> _LOW_BITS).sum(axis=0)]
            _, first, times = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, d * 8))).ravel(), return_index=True, return_counts=True)
            lanes = len(spectra.n)
            fill = -len(first) % lanes
            first, times = np.append(first, np.zeros(fill, np.int64)), np.append(times, np.zeros(fill, np.int64))
            for at in range(0, len(first), lanes):
                spectra.add(rows[first[at:at + lanes]].astype(np.float64), times[at:at + lanes])
    yield from _packed({d: (s.one(), sums) for d, (s, sums) in own.items()})


def join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spectrum for each length out of a task's spectra."""
    own: dict[int, tuple[Spectra, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            spectrum, sums = _unpacked(row)
            if row["d"] in own:
                own[row["d"]] = Spectra.stacked([own[row["d"]][0], spectrum]).one(), own[row["d"]][1] + sums
            else:
                own[row["d"]] = spectrum, sums
    yield from _packed(own)


def _packed(own: dict[int, tuple[Spectra, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SPECTRUM.split(", ")]
    for d, (s, sums) in own.items():
        arrays = [np.ascontiguousarray(x).tobytes() for x in (s.mean, s.values, s.vectors, sums[0], sums[1])]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([int(s.n[0])], pa.int64()), *(pa.array([x], pa.binary()) for x in arrays)], names)


def _unpacked(row) -> tuple[Spectra, np.ndarray]:
    d = row["d"]
    spectrum = Spectra(1, d)
    spectrum.n = np.array([float(row["n"])])
    spectrum.mean, spectrum.values = np.frombuffer(row["mean"]).reshape(1, d).copy(), np.frombuffer(row["eigenvalues"]).reshape(1, d).copy()
    spectrum.vectors = np.frombuffer(row["eigenvectors"]).reshape(1, d, d).copy()
    return spectrum, np.stack([np.frombuffer(row[c], np.int64) for c in ("low", "high")])


class Fit:
    """What the passes over all rows need for one length: exact count and sums, and a map of centred rows."""

    def __init__(self, n: int, sums: list[int], basis: np.ndarray):
        self.n, self.basis = n, basis
        self.whole, self.rest = [s // n for s in sums], [s % n for s in sums]
        self.explained, self.usable = np.zeros(0), np.zeros(0, bool)

    def times_n(self, rows: np.ndarray) -> np.ndarray:
        """n * x - S, exact: long where it fits, else Python's integers."""
        whole, rest = np.array(self.whole, np.int64), np.array(self.rest, np.int64)
        if len(rows) and self.n * (float(np.abs(rows.astype(np.float64) - whole).max()) + 1) < LARGEST:
            return (rows - whole) * self.n - rest
        return (rows.astype(object) - np.array(self.whole, object)) * self.n - np.array(self.rest, object)

    def projected(self, rows: np.ndarray) -> np.ndarray:
        return (self.times_n(rows).astype(np.float64) / self.n) @ self.basis

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2, exact; null where it is no long."""
        away = self.times_n(rows)
        if away.dtype == np.int64 and len(away) and float((away.astype(np.float64) ** 2).sum(axis=1).max()) < LARGEST:
            return (away * away).sum(axis=1).tolist()
        sums = (away.astype(object) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in sums]


def second_moments(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Per length, the sums of products of projected rows (last row and column: of the rows themselves, and their number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in integer_rows(batch):
                p = fits[rows.shape[1]].projected(rows)
                p = np.append(p, np.ones((len(p), 1)), axis=1)
                own[rows.shape[1]] = own.get(rows.shape[1], 0.0) + p.T @ p
        for d, m in own.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())],
                                             ["d", "i", "j", "v"])

    out = {d: np.zeros((f.basis.shape[1] + 1,) * 2) for d, f in fits.items()}
    for r in vectors.select("embedding").mapInArrow(run, _SUMS).groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["d"]][r["i"], r["j"]] = r["v"]
    return out


def fit_spectra(vectors: DataFrame, fan_in: int = FAN_IN) -> dict[int, Fit]:
    """Per length of the vectors: count, exact sums, and the eigenvectors that the rank-one updates found."""
    spectra = settle(vectors.select("embedding").mapInArrow(fit_task, _SPECTRUM), "spectra")
    left, lengths = spectra.count(), spectra.select("d").distinct().count()
    while left > max(fan_in, lengths):
        spectra = settle(spectra.repartition(-(-left // fan_in)).mapInArrow(join_task, _SPECTRUM), "spectra")
        now = spectra.count()
        if now == left:
            break
        left = now
    own: dict[int, Spectra] = {}
    totals: dict[int, list[int]] = {}
    for row in spectra.collect():
        spectrum, sums = _unpacked(row)
        exact = [int(a) + (int(b) << _LOW_BITS) for a, b in zip(*sums, strict=True)]
        totals[row["d"]] = [a + b for a, b in zip(totals.get(row["d"], [0] * row["d"]), exact, strict=True)]
        own[row["d"]] = Spectra.stacked([own[row["d"]], spectrum]).one() if row["d"] in own else spectrum
    return {d: Fit(int(s.n[0]), totals[d], np.linalg.qr(s.vectors[0])[0]) for d, s in own.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector of ``vectors`` (vec_id, embedding).

    Vectors that are null or empty, or hold a null, a non-finite entry or one whose integer is no long, take no part.
    Vectors of each length are whitened among themselves.  Null ids and repeated rows are kept, and each repeated row
    counts in the fit.  A component that the rows don't vary in has null ``whitened`` and no share in
    ``identity_error``; a deviation that is no long is null.  Other columns are never read; an empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = fit_spectra(vectors, fan_in)
    for d, m in second_moments(vectors, fits).items():
        fit = fits[d]
        centred = m[:-1, :-1] / fit.n - np.outer(m[-1, :-1], m[-1, :-1]) / fit.n ** 2
        values, turn = np.linalg.eigh((centred + centred.T) / 2)
        first = np.argsort(-values, kind="stable")[:components]
        basis, values, trace = fit.basis @ turn[:, first], values[first], float(np.trace(centred))
        basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
        fit.usable = values > trace * d * _EPS
        fit.explained = np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(values))
        fit.basis = basis / np.sqrt(np.where(fit.usable, values, 1.0))
    errors = {}
    for d, m in second_moments(vectors, fits).items():
        fit = fits[d]
        error = m[:-1, :-1] / fit.n - np.outer(m[-1, :-1], m[-1, :-1]) / fit.n ** 2 - np.eye(len(fit.usable))
        errors[d] = float(np.abs(error[np.ix_(fit.usable, fit.usable)]).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, rows in integer_rows(batch):
                fit, d = fits[rows.shape[1]], rows.shape[1]
                k = len(fit.usable)
                white = fit.projected(rows).ravel()
                deviation = pa.array(fit.deviations(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                    pa.array(np.full(len(rows) * k, fit.n), pa.int64()), deviation.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(white, pa.float64(), mask=~np.tile(fit.usable, len(rows))), pa.array(np.tile(fit.explained, len(rows))),
                    pa.array(np.full(len(rows) * k, errors[d]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
