"""Whitening of integer vectors by an incremental eigendecomposition.

Each partition keeps the spectrum of the scatter of its vectors and takes new ones in
by centred rank-one updates: the roots of a secular equation, with deflation of
directions a vector does not touch and of eigenvalues that are equal. A block of
vectors first becomes as many rows as there are dimensions, with the same scatter (the
triangle of its QR decomposition). Spectra of partitions are combined the same way,
one eigenvector after the other, in a tree of groups. The basis found is then refined
by Rayleigh-Ritz steps over all vectors until its residual is at rounding level, so
the result does not depend on how the vectors were dealt out.

Sums and deviations are integers throughout; vectors are centred before anything is
multiplied.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors that become one block of updates, and partial results a task folds into one.
BLOCK = 1024
FAN = 16
# Residual, as a share of the largest eigenvalue, at which refinement ends, and its most rounds.
RESIDUAL, ROUNDS = 1e-13, 60
# Entries are whole numbers that a double holds exactly.
EXACT = float(2**52)
LONGEST = 2**63 - 1
EPS = float(np.finfo(float).eps)


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """``(roots, gaps)`` of ``1 + rho * sum(z2 / (d - x)) = 0``, ``d`` rising and distinct.

    ``gaps[i, j]`` is ``d[i] - root[j]``, taken from the pole next to the root so that
    no digits cancel. All roots are iterated at once: each step fits the poles on
    either side of a root by one pole each and solves the quadratic, inside a bracket.
    """
    k, ends = len(d), np.append(d[1:], d[-1] + rho * z2.sum())
    middle = (d + ends) / 2
    at_middle = 1 / rho + (z2[:, None] / (d[:, None] - middle)).sum(0)
    upper = (at_middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(upper, ends, d)
    delta = d[:, None] - origin
    lo = np.where(at_middle < 0, middle, d) - origin
    hi = np.where(at_middle < 0, ends, middle) - origin
    left, right = d - origin, np.where(np.arange(k) < k - 1, ends - origin, np.inf)
    below = np.tri(k, dtype=bool).T
    x = (lo + hi) / 2
    for _ in range(80):
        gap = delta - x
        part = z2[:, None] / gap
        slope = part / gap
        psi, phi = np.where(below, part, 0).sum(0), np.where(below, 0, part).sum(0)
        f = 1 / rho + psi + phi
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        near = left - x
        s = np.where(below, slope, 0).sum(0) * near * near
        far = np.where(np.isinf(right), 1.0, right - x)
        t = np.where(below, 0, slope).sum(0) * far * far
        c = 1 / rho + (psi - s / near) + (phi - t / far)
        # c * u**2 - b * u + g = 0 for the step u from x.
        b = c * (near + far) + s + t
        g = c * near * far + s * far + t * near
        lone = np.isinf(right)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * c * g, 0))
            step = np.where(b > 0, 2 * g / (b + root), (b - root) / (2 * c))
            step = np.where(lone, near + s / c, step)
            new = x + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done = (np.abs(f) <= 4 * EPS * k * (1 / rho + np.abs(psi) + np.abs(phi))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        x = np.where(done, x, new)
    return origin + x, delta - x


class Spectrum:
    """Number, mean and eigendecomposition of the centred scatter of some vectors."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.basis = np.zeros(dim), np.eye(dim)

    def rank_one(self, row: np.ndarray) -> None:
        """Add ``row`` times itself to the scatter."""
        norm = float(row @ row)
        if norm == 0:
            return
        d, q = self.values, self.basis
        z = q.T @ (row / np.sqrt(norm))
        tiny = 8 * EPS * max(float(d[-1]), norm)
        # Equal eigenvalues: a reflection of their vectors leaves one that the row touches.
        edges = np.flatnonzero(np.diff(d) > tiny) + 1
        for group in np.split(np.arange(len(d)), edges):
            if len(group) > 1 and np.count_nonzero(np.abs(z[group[:-1]]) * norm > tiny):
                u, size = z[group].copy(), float(np.linalg.norm(z[group]))
                u[-1] += size if u[-1] >= 0 else -size
                u /= np.linalg.norm(u)
                q[:, group] -= 2 * np.outer(q[:, group] @ u, u)
                last = z[group[-1]]
                z[group[:-1]], z[group[-1]] = 0, -size if last >= 0 else size
        live = np.abs(z) * norm > tiny
        if not live.any():
            return
        own, zs = d[live], z[live]
        found, gaps = _roots(own, zs * zs, norm)
        # The row for which the roots found are exact: vectors of it are orthogonal.
        between = np.abs(own[:, None] - own)
        np.fill_diagonal(between, 1)
        size = np.exp((np.log(np.maximum(np.abs(gaps), 1e-300)).sum(1) - np.log(between).sum(1)) / 2)
        with np.errstate(divide="ignore"):
            turn = (np.sign(zs) * size)[:, None] / np.where(gaps == 0, 1e-300, gaps)
        turn /= np.linalg.norm(turn, axis=0)
        values = d.copy()
        values[live] = found
        basis = q.copy()
        basis[:, live] = q[:, live] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.basis = values[order], basis[:, order]

    def absorb(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Take in ``n`` vectors of that mean whose centred scatter is that of ``rows``."""
        if not n:
            return
        for row in rows:
            self.rank_one(row)
        apart, total = mean - self.mean, self.n + n
        self.rank_one(apart * np.sqrt(self.n * n / total))
        self.mean, self.n = self.mean + apart * (n / total), total

    def add(self, vectors: np.ndarray) -> None:
        for at in range(0, len(vectors), BLOCK):
            part = vectors[at : at + BLOCK]
            mean = part.mean(0)
            rows = part - mean
            self.absorb(len(part), mean, np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows)

    def merge(self, other: Spectrum) -> None:
        self.absorb(other.n, other.mean, (other.basis * np.sqrt(np.maximum(other.values, 0))).T)

    def pack(self) -> bytes:
        return np.concatenate(([self.n], self.mean, self.values, self.basis.ravel())).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, dim: int) -> Spectrum:
        flat, out = np.frombuffer(raw), cls(dim)
        out.n, out.mean, out.values = int(flat[0]), flat[1 : dim + 1].copy(), flat[dim + 1 : 2 * dim + 1].copy()
        out.basis = flat[2 * dim + 1 :].reshape(dim, dim).copy()
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _gather(rows: DataFrame, start: Callable, step: Callable, fold: Callable) -> bytes | None:
    """``step`` over the batches of each partition, then partial results folded in a tree."""

    def run(batches):
        state, any_row = start(), False
        for batch in batches:
            if batch.num_rows:
                state, any_row = step(state, batch.column(0)), True
        if any_row:
            raw = state if isinstance(state, bytes) else state.pack() if hasattr(state, "pack") else state.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([raw], pa.binary())], names=["id", "raw"])

    def some(table):
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        raws = table.column("raw").take(pa.array(order)).to_pylist()
        return pa.table({"id": pa.array([table.column("id")[0].as_py() // FAN], pa.int64()), "raw": pa.array([fold(raws)], pa.binary())})

    parts = materialize(rows.mapInArrow(run, "id long, raw binary"), "parts")
    highest = parts.agg(F.max("id")).first()[0]
    while highest is not None and highest > 0:
        parts = parts.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(some, "id long, raw binary")
        highest //= FAN
    found = parts.select("raw").collect()
    return bytes(found[0][0]) if found else None


def _added(raws: list[bytes], kind) -> bytes:
    return np.sum([np.frombuffer(r, kind) for r in raws], axis=0, dtype=kind).tobytes()


def integers(rows: DataFrame, vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000, dim: int | None = None) -> DataFrame:
    """Rows with ``x``, the entries as ``floor(scale * entry) + shift``; other columns stay.

    Left out: null vectors, vectors with null, non-finite or too large entries (over
    2**52 after scaling) and, if lengths differ, those of another length than ``dim``
    (not given: the most frequent length, ties to the longer).
    """
    vec = F.col(vec_col)
    entry = vec.cast("array<double>")
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < EXACT))
    kept = rows.where(vec.isNotNull() & (F.size(vec) > 0)).where(fine)
    if dim is None:
        sizes = kept.groupBy(F.size(vec).alias("size")).agg(F.count("*").alias("n"))
        dim = sizes.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    x = F.transform(entry, lambda c: F.floor(c * scale) + F.lit(shift))
    return kept.where(F.size(vec) == F.lit(dim or 0)).withColumn("x", x)


def fit(x: DataFrame, keep: int | None = None, components: int = 16) -> dict | None:
    """Statistics and components of the distinct vectors of ``x``; none without rows.

    ``keep`` directions are carried through (not given: all; memory is its product
    with the dimension). Components whose eigenvalue is nil at double precision are
    left out.
    """
    listed = materialize(x.select("x").distinct(), "fit")
    head = listed.select(F.size("x")).first()
    if head is None:
        return None
    dim = head[0]
    low = (1 << 24) - 1

    def count(state, column):
        v = _vectors(column, dim)
        return state + np.concatenate(([len(v)], (v >> 24).sum(0), (v & low).sum(0)))

    flat = np.frombuffer(
        _gather(listed, lambda: np.zeros(2 * dim + 1, np.int64), count, lambda raws: _added(raws, np.int64)), np.int64
    ).tolist()
    n, sums = flat[0], [(a << 24) + b for a, b in zip(flat[1 : dim + 1], flat[dim + 1 :])]
    base = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(b) for s, b in zip(sums, base)]
    offset = np.array([r / n for r in rest])

    def centred(column):
        return (_vectors(column, dim) - base) - offset

    def grow(state, column):
        state.add(centred(column))
        return state

    def join(raws):
        out = Spectrum.unpack(raws[0], dim)
        for raw in raws[1:]:
            out.merge(Spectrum.unpack(raw, dim))
        return out.pack()

    first = Spectrum.unpack(_gather(listed, lambda: Spectrum(dim), grow, join), dim)
    width = min(dim, keep or dim)
    basis = np.linalg.qr(first.basis[:, ::-1][:, :width])[0]
    for _ in range(ROUNDS):
        def apply(state, column, basis=basis):
            y = centred(column)
            return state + np.append((y.T @ (y @ basis)).ravel(), (y * y).sum())

        flat = np.frombuffer(_gather(listed, lambda: np.zeros(dim * width + 1), apply, lambda raws: _added(raws, np.float64)))
        image, trace = flat[:-1].reshape(dim, width) / n, float(flat[-1]) / n
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        image, basis = image @ turn, basis @ turn
        top = min(components, width)
        residual = np.abs(image[:, :top] - basis[:, :top] * values[:top]).max()
        if residual <= RESIDUAL * max(values[0], 0) or values[0] <= 0:
            break
        basis = np.linalg.qr(image)[0] if width < dim else np.linalg.qr(basis)[0]
    else:
        raise RuntimeError(f"components did not settle: residual {residual:g}, largest eigenvalue {values[0]:g}")
    real = values[:top] > 8 * dim * EPS * max(values[0], 0)
    values, basis = values[:top][real], basis[:, :top][:, real]
    turned = basis / np.sqrt(values)
    k = len(values)

    def cover(state, column):
        t = centred(column) @ turned
        return state + np.concatenate((t.sum(0), (t.T @ t).ravel()))

    flat = np.frombuffer(_gather(listed, lambda: np.zeros(k + k * k), cover, lambda raws: _added(raws, np.float64)))
    mean = flat[:k] / n
    error = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return {
        "n": n, "sums": sums, "base": base, "rest": rest, "offset": offset, "values": values, "basis": basis,
        "turned": turned, "trace": trace, "identity_error": error,
    }


def whiten(x: DataFrame, model: dict, id_col: str = "vec_id") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of every row.

    ``deviation`` is exact, and null where it is larger than a long holds.
    """
    n, base, offset, turned = model["n"], model["base"], model["offset"], model["turned"]
    dim, k = turned.shape
    rest = np.array(model["rest"], object)
    share = model["values"] / model["trace"] if k else np.zeros(0)
    constant = int((rest * rest).sum())

    def run(batches):
        for batch in batches:
            y = _vectors(batch.column(1), dim) - base
            wide = y.astype(object) if len(y) and int(np.abs(y).max()) ** 2 * dim > LONGEST or n * dim * int(np.abs(y).max(initial=0)) > LONGEST else y
            own = rest if wide.dtype == object else rest.astype(np.int64)
            squares, cross = (wide * wide).sum(1).tolist(), (wide * own).sum(1).tolist()
            deviation = [n * n * a - 2 * n * b + constant for a, b in zip(squares, cross)]
            deviation = pa.array([v if v <= LONGEST else None for v in deviation], pa.int64())
            row = np.repeat(np.arange(len(y)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                 deviation.take(pa.array(row)), pa.array(((y - offset) @ turned).ravel()), pa.array(np.tile(share, len(y)))],
                names=[id_col, "component", "deviation", "whitened", "explained"],
            )

    kind = x.schema[id_col].dataType.simpleString()
    found = x.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, component int, deviation long, whitened double, explained double")
    return found.select(
        id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model["identity_error"]).alias("identity_error"),
    )


def whitened_components(
    rows: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", keep: int | None = None
) -> DataFrame:
    """Whitened components of every usable row (see ``integers``, ``fit``, ``whiten``).

    Repeated vectors weigh once in the fit and have a result each; ties of
    eigenvalues leave a basis of their space. Without usable rows, or if all vectors
    are equal, there are no components and no rows.
    """
    x = integers(rows.select(F.col(id_col), F.col(vec_col)), vec_col)
    model = fit(x, keep, components)
    if model is None:
        kind = rows.schema[id_col].dataType.simpleString()
        return rows.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    return whiten(x, model, id_col)
