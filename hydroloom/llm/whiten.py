"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of the scatter matrix of its rows and updates it row by row: a centred rank-one change, whose
new eigenvalues are the roots of a secular equation, components that the change does not touch being deflated. Spectra of
partitions are combined in a tree, again by successive rank-one changes. A Rayleigh-Ritz step over all rows then makes
the basis exact to double precision: rows seen in the combined basis, centred by exact sums, have a nearly diagonal
covariance, whose own eigenvectors turn the basis.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroloom.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LANES = 16  # spectra that a task updates side by side, each with every sixteenth row
LANE_ROWS = 256
FAN_IN = 8  # spectra that one task combines
MOST_DIMENSIONS = 4096
TOLERANCE = 1e-11  # of a secular equation's value; the basis is orthogonal whatever it is, and exact after the last step
_EPS = np.finfo(float).eps


def _deflate(d: np.ndarray, z: np.ndarray, u: np.ndarray) -> None:
    """Rotate, in place, neighbours of nearly equal eigenvalue so that only the later one has a part in the change."""
    width = np.maximum(np.abs(d[:, -1]), (z * z).sum(axis=1))
    size = np.sqrt((z * z).sum(axis=1))
    for k in range(d.shape[1] - 1):
        lanes = np.flatnonzero((d[:, k + 1] - d[:, k] <= 64 * _EPS * width) & (np.abs(z[:, k]) > 8 * _EPS * size))
        if len(lanes):
            long = np.hypot(z[lanes, k], z[lanes, k + 1])
            c, s = z[lanes, k + 1] / long, z[lanes, k] / long
            z[lanes, k], z[lanes, k + 1] = 0, long
            a, b = u[lanes, :, k], u[lanes, :, k + 1]
            u[lanes, :, k], u[lanes, :, k + 1] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b


def _secular(d: np.ndarray, q: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum q / (d - x), one right of each d: the pole each is measured from, and the distance to it.

    `q` are squares of the change (0 where deflated), `high` the next pole or bound. The middle way: the sums left and right
    of the root are fitted by one pole each; a step that leaves the bracket halves it instead.
    """
    lanes, size = d.shape
    gap = high - d
    middle = d + gap / 2
    away = d[:, None, :] - middle[:, :, None]
    away[away == 0] = 1
    at_middle = 1 + (q[:, None, :] / away).sum(axis=2)
    last = np.zeros((lanes, size), bool)
    right = (at_middle < 0) & (gap > 0)  # the root lies nearer to the pole on its right
    step_to = np.where(right, high, d)
    # The last root has no pole on its right: it is measured from its own.
    free = q > 0
    last_free = np.where(free.any(axis=1), size - 1 - np.argmax(free[:, ::-1], axis=1), -1)
    last[np.arange(lanes), last_free] = last_free >= 0
    right &= ~last
    step_to = np.where(last, d, step_to)
    origin = step_to
    far = last & (at_middle < 0)
    low = np.where(right, -gap / 2, np.where(far, gap / 2, 0.0)).ravel()
    top = np.where(right, 0.0, np.where(far, gap, gap / 2)).ravel()
    mu = (low + top) / 2
    poles = (d[:, None, :] - origin[:, :, None]).reshape(-1, size)  # seen from each root's origin
    parts = np.repeat(q, size, axis=0)
    left = np.tile(np.tri(size), (lanes, 1))
    own, other, last = (d - origin).ravel(), (high - origin).ravel(), last.ravel()
    live = np.flatnonzero(gap.ravel() > 0)
    poles, parts, left = poles[live], parts[live], left[live]
    for _ in range(40):
        x = mu[live]
        away = poles - x[:, None]
        away[away == 0] = _EPS
        part = parts / away
        slope = part / away
        psi, dpsi = np.einsum("ij,ij->i", part, left), np.einsum("ij,ij->i", slope, left)
        phi, dphi = part.sum(axis=1) - psi, slope.sum(axis=1) - dpsi
        f = 1 + psi + phi
        going = np.abs(f) > TOLERANCE * (1 + np.abs(psi) + np.abs(phi))
        if not going.all():
            live, poles, parts, left = live[going], poles[going], parts[going], left[going]
            x, f, dpsi, dphi = x[going], f[going], dpsi[going], dphi[going]
        if not len(live):
            break
        low[live] = np.where(f < 0, x, low[live])
        top[live] = np.where(f >= 0, x, top[live])
        final = last[live]
        left_gap, right_gap = own[live] - x, other[live] - x  # left_gap < 0 < right_gap
        # f is taken as c + s / (d - x) + t / (high - x), equal in value and in slope left and right; the last root has no t.
        with np.errstate(divide="ignore", invalid="ignore"):
            c = f - left_gap * dpsi - right_gap * dphi
            a = c * (left_gap + right_gap) + dpsi * left_gap**2 + dphi * right_gap**2
            b = f * left_gap * right_gap
            root = np.sqrt(np.maximum(a * a - 4 * c * b, 0))
            eta = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            eta = np.where(final, f * left_gap / (f - left_gap * dpsi), eta)
        new = x + eta
        bad = ~np.isfinite(new) | (new <= low[live]) | (new >= top[live])
        mu[live] = np.where(bad, (low[live] + top[live]) / 2, new)
    mu = mu.reshape(lanes, size)
    return origin, mu


def rank_one(d: np.ndarray, u: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra (`d` ascending, vectors in the columns of `u`) of each lane's matrix plus `weight` * x x^T."""
    z = np.einsum("lij,li->lj", u, x) * np.sqrt(weight)[:, None]
    u = u.copy()
    _deflate(d, z, u)
    total = (z * z).sum(axis=1)
    scale = np.maximum(d[:, -1], total)
    z[np.abs(z) * np.sqrt(total)[:, None] <= 4 * _EPS * scale[:, None]] = 0
    lanes, size = d.shape
    # Components with a part in the change come first, in order, so that each one's right neighbour is the next pole.
    order = np.argsort(z == 0, axis=1, kind="stable")
    d, z = np.take_along_axis(d, order, axis=1), np.take_along_axis(z, order, axis=1)
    u = np.take_along_axis(u, order[:, None, :], axis=2)
    q = z * z
    free = q > 0
    count = free.sum(axis=1)
    high = np.empty_like(d)
    high[:, :-1] = d[:, 1:]
    rows = np.flatnonzero(count)
    high[rows, count[rows] - 1] = d[rows, count[rows] - 1] + total[rows] * (1 + 4 * _EPS)
    high = np.where(free, high, d)
    poles = np.where(free, d, 0)
    origin, mu = _secular(poles, q, np.where(free, high, poles))
    # Parts that belong exactly to the roots found, so that the vectors are orthogonal whatever the roots' last digits.
    apart = (poles[:, None, :] - origin[:, :, None]) - mu[:, :, None]  # [root, pole]
    both = free[:, :, None] & free[:, None, :]
    gaps = poles[:, :, None] - poles[:, None, :]  # [root's own pole, pole]
    eye = np.eye(size, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(both, np.where(eye, -apart, apart / -gaps), 1.0)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1)))
    exact = np.where(free, np.copysign(exact, z), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(both, exact[:, None, :] / apart, 0.0).transpose(0, 2, 1)  # [pole, root]
    norm = np.sqrt((turn * turn).sum(axis=1))
    turn = turn / np.where(norm > 0, norm, 1)[:, None, :]
    still = ~free
    turn[:, range(size), range(size)] = np.where(still, 1.0, turn[:, range(size), range(size)])
    d = np.where(free, origin + mu, d)
    u = u @ turn
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(u, order[:, None, :], axis=2)


class Spectra:
    """Counts, means and scatter spectra of some lanes."""

    def __init__(self, lanes: int, size: int) -> None:
        self.n = np.zeros(lanes)
        self.mean = np.zeros((lanes, size))
        self.d = np.zeros((lanes, size))
        self.u = np.tile(np.eye(size), (lanes, 1, 1))

    def add(self, rows: np.ndarray) -> None:
        """One row to each of the first lanes."""
        k = len(rows)
        n, away = self.n[:k], rows - self.mean[:k]
        self.d[:k], self.u[:k] = rank_one(self.d[:k], self.u[:k], away, n / (n + 1))
        self.n[:k] = n + 1
        self.mean[:k] += away / self.n[:k, None]

    def absorb(self, other: Spectra) -> None:
        """The other spectra, lane by lane: one change for each of their components and one for the difference of means."""
        n = self.n + other.n
        away = other.mean - self.mean
        weight = np.where(n > 0, self.n * other.n / np.maximum(n, 1), 0)
        self.d, self.u = rank_one(self.d, self.u, away, weight)
        for k in range(other.d.shape[1]):
            self.d, self.u = rank_one(self.d, self.u, other.u[:, :, k], np.maximum(other.d[:, k], 0))
        self.mean = self.mean + away * np.where(n > 0, other.n / np.maximum(n, 1), 0)[:, None]
        self.n = n

    def lanes(self, chosen: slice) -> Spectra:
        out = Spectra.__new__(Spectra)
        out.n, out.mean, out.d, out.u = self.n[chosen], self.mean[chosen], self.d[chosen], self.u[chosen]
        return out

    def folded(self) -> Spectra:
        """All lanes in one."""
        held = self
        while len(held.n) > 1:
            half = len(held.n) // 2
            left, right, rest = held.lanes(slice(0, half)), held.lanes(slice(half, 2 * half)), held.lanes(slice(2 * half, None))
            left.absorb(right)
            if len(rest.n):
                one = left.lanes(slice(0, 1))
                one.absorb(rest)
                for name in ("n", "mean", "d", "u"):
                    setattr(left, name, np.concatenate([getattr(one, name), getattr(left, name)[1:]]))
            held = left
        return held


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """`vec_id, x`: rows whose vector is there and has only finite entries, entries as whole numbers."""
    entry = F.col(column).cast("array<double>")
    good = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    whole = F.transform(entry, lambda c: F.floor(c * SCALE) + OFFSET)
    # The filter must hold before entries are made whole numbers: elsewhere a cast of NaN would be an error.
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, whole).alias("x")).filter(F.col("x").isNotNull())


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * size or (len(column) and (np.diff(column.offsets.to_numpy()) != size).any()):
        raise ValueError("vectors differ in length")
    return flat.reshape(-1, size)


SPECTRUM = "part long, n long, sums array<long>, mean array<double>, d array<double>, u array<double>"


def _packed(held: Spectra, part: int, n: int, sums: list[int]) -> dict:
    return {
        "part": [part], "n": [n], "sums": [sums], "mean": [held.mean[0].tolist()], "d": [held.d[0].tolist()], "u": [held.u[0].ravel().tolist()],
    }


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def partition_spectra(rows: DataFrame) -> DataFrame:
    """One spectrum with exact sums for every partition that has rows."""
    arrow = _arrow(SPECTRUM)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, sums, turn = None, 0, None, 0
        for batch in source:
            if not batch.num_rows:
                continue
            if held is None:
                size = len(batch.column(0)[0])
                held = Spectra(max(1, min(LANES, batch.num_rows // LANE_ROWS)), size)
                sums = np.zeros(size, np.int64)
            x = _matrix(batch.column(0), size)
            n, sums = n + len(x), sums + x.sum(axis=0)
            centred = (x - OFFSET).astype(float)
            for at in range(0, len(x), len(held.n)):
                held.add(centred[at : at + len(held.n)])
        if held is not None:
            yield pa.RecordBatch.from_pydict(_packed(held.folded(), TaskContext.get().partitionId(), n, sums.tolist()), schema=arrow)

    return rows.select("x").mapInArrow(run, SPECTRUM)


def _unpacked(rows: list[dict]) -> Spectra:
    size = len(rows[0]["d"])
    if any(len(r["d"]) != size for r in rows):
        raise ValueError("vectors differ in length")
    out = Spectra.__new__(Spectra)
    out.n = np.array([float(r["n"]) for r in rows])
    out.mean, out.d = np.array([r["mean"] for r in rows]), np.array([r["d"] for r in rows])
    out.u = np.array([r["u"] for r in rows]).reshape(-1, size, size)
    return out


def combine(spectra: DataFrame) -> DataFrame:
    """One spectrum of all: rounds of at most FAN_IN spectra a task, each round a table."""
    arrow = _arrow(SPECTRUM)

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        held = _unpacked(rows).folded()
        sums = [sum(c) for c in zip(*(r["sums"] for r in rows), strict=True)]
        return pa.Table.from_pydict(_packed(held, rows[0]["part"] // FAN_IN, sum(r["n"] for r in rows), sums), schema=arrow)

    held = cut_lineage(spectra, "spectra")
    top = held.agg(F.max("part")).first()[0]
    while top:
        held = cut_lineage(held.groupBy(F.expr(f"part div {FAN_IN}").alias("group")).applyInArrow(fold, SPECTRUM), "spectra", held)
        top //= FAN_IN
    return held


def _summed(rows: DataFrame, side: int, build) -> np.ndarray:
    """Sum over all rows of a matrix of `side` x `side`, made partition by partition and added up by Spark."""
    arrow = _arrow("cell int, value double")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in source:
            if batch.num_rows:
                total += build(batch.column(0))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(side * side, dtype=np.int32), "value": total.ravel()}, schema=arrow)

    cells = rows.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(side * side)
    for cell, value in cells.collect():  # side * side cells, whatever the number of rows
        out[cell] = value
    return out.reshape(side, side)


def _centred(column: pa.Array, sums: np.ndarray, n: int) -> np.ndarray:
    """x - S / n with the division made last, on whole numbers that doubles hold exactly."""
    whole, rest = sums // n, sums % n
    return (_matrix(column, len(sums)) - whole).astype(float) - rest / n


def whitening(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Rows, exact sums, eigenvalues (falling), unit eigenvectors in columns, and trace of the covariance; None without rows."""
    rows = usable(vectors)
    one = combine(partition_spectra(rows)).collect()  # a single row of one spectrum
    if not one:
        return None
    n, sums = one[0]["n"], np.array(one[0]["sums"], np.int64)
    size = len(sums)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors have more than {MOST_DIMENSIONS} entries")
    basis = np.linalg.qr(np.array(one[0]["u"]).reshape(size, size))[0]  # orthogonal to the last digit

    def products(column: pa.Array) -> np.ndarray:
        seen = _centred(column, sums, n) @ basis
        return seen.T @ seen

    small = _summed(rows, size, products) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return n, sums, values[::-1].copy(), (basis @ turn)[:, ::-1].copy(), float(np.trace(small))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` for each usable row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out; vectors of different lengths are an error.
    Repeated rows count as often as they stand there. Components without variance (as of equal rows, or of fewer rows
    than dimensions) cannot be whitened and are left out. `deviation` is exact, and NULL where it does not fit a long.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = whitening(vectors)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, values, basis, trace = model
    kept = int((values[:components] > max(values[0], 0) * 1e-13).sum())
    rows, arrow = usable(vectors), _arrow(schema)
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    white = basis[:, :kept] / np.sqrt(values[:kept])

    def products(column: pa.Array) -> np.ndarray:
        seen = _centred(column, sums, n) @ white
        return seen.T @ seen

    error = float(np.abs(_summed(rows, kept, products) / n - np.eye(kept)).max())
    explained = values[:kept] / trace

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part.column(1), len(sums))
                away = [n * row - sums for row in (x if np.abs(x - OFFSET).max(initial=0) < 2**40 and n < 2**20 else x.astype(object))]
                deviation = [int((a * a).sum()) if float((a.astype(float) ** 2).sum()) < 4e18 else _exact(a) for a in away]
                count = len(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(count), kept))),
                    "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), count), "n": np.full(count * kept, n),
                    "deviation": [value for value in deviation for _ in range(kept)],
                    "whitened": (_centred(part.column(1), sums, n) @ white).ravel(),
                    "explained": np.tile(explained, count), "identity_error": np.full(count * kept, error),
                }, schema=arrow)

    return rows.mapInArrow(run, schema)


def _exact(away: np.ndarray) -> int | None:
    """Sum of squares in whole numbers of any size; None beyond a long."""
    total = functools.reduce(lambda total, a: total + int(a) * int(a), away, 0)
    return total if total < 2**63 else None
