"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson.

The fit list is every distinct quantised vector once.  Its covariance is never formed: the eigensolver
sees it only through products ``V u = sum (x - mean) ((x - mean) . u) / n``, and a product with a whole
block of vectors is one Spark pass over the list.  The driver holds a few vectors of the embeddings'
dimension, never rows.

* Rayleigh-Ritz: the covariance is projected on a growing orthonormal basis; its Ritz pairs are the
  candidates.  Leading pairs are locked, in order, once their residuals are at double precision.
* Correction: for each wanted pair that is not locked, ``P (V - theta) P t = -r`` is solved by a few steps of
  MINRES on the complement of the locked and current Ritz vectors.  The solvers of all pairs advance
  together, so a step costs one pass for all of them.  The corrections join the basis, which restarts from
  its best Ritz vectors when it is full.  When the basis spans the whole space the pairs are exact.

Counts, sums and the trace are whole numbers.  Every pass reads a written table, so a lost executor repeats
its tasks only.

Nulls and edge cases: rows whose vector is null or holds nulls, NaN or infinite entries go; if lengths differ,
the most frequent one counts (the greater of equally frequent ones) and other rows go; entries beyond the long
range stop at 2^62; repeated rows and a null vec_id stay and give rows of their own; components whose
eigenvalue is zero up to rounding are not given (fewer than ``k`` are returned, none for a single distinct
vector); a deviation beyond the long range is null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import stored

SCALE = 256
LARGEST = float(1 << 62)
KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
TOLERANCE = 2.0**-44  # of the largest eigenvalue
BASIS, STEPS, ROUNDS = 64, 8, 200
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def vectors(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): the valid vectors of that length, quantised to whole numbers."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = pc.fill_null(lists.take(pa.array(at)).flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    entries = flat.reshape(len(at), width)
    good = np.isfinite(entries).all(axis=1)
    return at[good], np.clip(np.floor(SCALE * entries[good]), -LARGEST, LARGEST).astype(np.int64)


def _pack_task(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector as the bytes of its smallest kind of integers, which its values alone decide."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = vectors(batch.column("embedding"), width)
            most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
            level = np.searchsorted([1 << 15, 1 << 31], most, side="right")
            for i, kind in enumerate(KINDS):
                rows = x[level == i].astype(kind)
                raw, size = rows.tobytes(), kind.itemsize * width
                yield pa.record_batch([pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())], ["x"])

    return task


def _unpacked(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for kind in KINDS:
        at = np.flatnonzero(sizes == kind.itemsize * width)
        if len(at):
            yield np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), width)


def _fold(fit: DataFrame, width: int, size: int, piece: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``piece(x)``, ``size`` numbers, over blocks of the fit list: a row of partial sums per task, added up in one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in _unpacked(batch.column("x"), width):
                total += piece(x).ravel()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column("sums").flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return np.array(fit.mapInArrow(partial, "sums array<double>").repartition(1).mapInArrow(add, "sums array<double>").first().sums)


def _sum_task(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * width, [0] * width
        for batch in batches:
            for x in _unpacked(batch.column("x"), width):
                whole = x.astype(np.int64 if float(np.abs(x.astype(float)).max()) ** 2 * len(x) < LARGEST else object)
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, whole.sum(axis=0), strict=True)]
                squares = [a + int(b) for a, b in zip(squares, (whole * whole).sum(axis=0), strict=True)]
        kind = pa.decimal128(38, 0)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(map(Decimal, sums), kind), pa.array(map(Decimal, squares), kind)], ["i", "n", "s", "q"])

    return task


@dataclass
class Fitted:
    """n distinct vectors, their exact sums, the components (columns) with eigenvalues, and how well they whiten."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float]
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def minres(theta: float, frame: np.ndarray, residual: np.ndarray, steps: int, goal: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solves the projected correction equation; yields each vector whose product with the matrix it needs."""

    def project(v: np.ndarray) -> np.ndarray:
        v = v - frame @ (frame.T @ v)
        return v - frame @ (frame.T @ v)

    v = project(-residual)
    x, start = np.zeros_like(v), float(np.linalg.norm(v))
    if start == 0:
        return x
    v, v_old = v / start, np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    left, beta, c, c_old, s, s_old = start, 0.0, 1.0, 1.0, 0.0, 0.0
    for _ in range(steps):
        image = yield v
        p = project(image - theta * v)
        alpha = float(v @ p)
        p = p - alpha * v - beta * v_old
        ahead = float(np.linalg.norm(p))
        delta = c * alpha - c_old * s * beta
        rho = math.hypot(delta, ahead)
        if rho == 0:
            break
        second, third = s * alpha + c_old * c * beta, s_old * beta
        c_old, c, s_old, s = c, delta / rho, s, ahead / rho
        w, w_old = (v - third * w_old - second * w) / rho, w
        x = x + c * left * w
        left = -s * left
        if abs(left) <= goal * start or ahead <= 1e-300:
            break
        v, v_old, beta = p / ahead, v, ahead
    return project(x)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k leading (values, vectors) of a symmetric matrix that is known by its products with blocks of vectors only."""
    k = min(k, width)
    limit = min(width, max(BASIS, 6 * k))

    def extended(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Orthonormal directions that ``new`` adds to ``basis``."""
        found = np.zeros((width, 0))
        for column in new.T:
            size = np.linalg.norm(column)
            for _ in range(2):
                for frame in (basis, found):
                    column = column - frame @ (frame.T @ column)
            rest = np.linalg.norm(column)
            if rest > 1e-10 * size and rest > 0 and basis.shape[1] + found.shape[1] < limit:
                column = column / rest
                for frame in (basis, found):
                    column = column - frame @ (frame.T @ column)
                found = np.column_stack([found, column / np.linalg.norm(column)])
        return found

    basis = extended(np.zeros((width, 0)), np.random.default_rng(seed).standard_normal((width, min(2 * k, width))))
    images = product(basis)
    for _ in range(ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_images = basis @ turn, images @ turn
        residuals = ritz_images[:, :k] - ritz[:, :k] * values[:k]
        sizes = np.linalg.norm(residuals, axis=0)
        goal = TOLERANCE * max(float(np.abs(values).max()), 1e-300)
        locked = int(np.argmax(np.append(sizes > goal, True)))
        if locked == k or basis.shape[1] == width:
            return values[:k], ritz[:, :k]
        if basis.shape[1] + (k - locked) > limit:
            basis, images = ritz[:, : 3 * k], ritz_images[:, : 3 * k]
        frame = ritz[:, :k]  # locked pairs and those being corrected
        solvers = [minres(float(values[i]), frame, residuals[:, i], STEPS, 0.02) for i in range(locked, k)]
        asked = {i: None for i in range(len(solvers))}
        answers: dict[int, np.ndarray] = {}
        while asked:
            wanted: dict[int, np.ndarray] = {}
            for i, image in asked.items():
                try:
                    wanted[i] = solvers[i].send(image)
                except StopIteration as done:
                    answers[i] = done.value
            block = product(np.column_stack(list(wanted.values()))) if wanted else None
            asked = {i: block[:, j] for j, i in enumerate(wanted)}
        new = extended(basis, np.column_stack([answers[i] for i in sorted(answers)]))
        if not new.shape[1]:  # corrections lie in the basis: a new direction instead
            new = extended(basis, np.random.default_rng(seed + basis.shape[1]).standard_normal((width, 1)))
        basis, images = np.column_stack([basis, new]), np.column_stack([images, product(new)])
    raise RuntimeError(f"Jacobi-Davidson did not settle in {ROUNDS} rounds")


def _width(embeddings: DataFrame) -> int | None:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    sizes = embeddings.where(F.col("embedding").isNotNull()).where(~bad).groupBy(F.size("embedding").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return top and top["size"]


def fitted(embeddings: DataFrame, k: int = 4) -> Fitted | None:
    """The whitening of ``embeddings(embedding, ...)``; None if no row is valid."""
    width = _width(embeddings)
    if not width:
        return None
    fit = stored(embeddings.select("embedding").mapInArrow(_pack_task(width), "x binary").distinct())
    totals = fit.mapInArrow(_sum_task(width), "i int, n long, s decimal(38,0), q decimal(38,0)").groupBy("i").agg(*(F.sum(c).alias(c) for c in "nsq")).orderBy("i").collect()
    n, sums, squares = totals[0].n, [int(r.s) for r in totals], sum(int(r.q) for r in totals)
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    mean = np.array([s / n for s in sums])
    passes = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def piece(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _fold(fit, width, block.size, piece).reshape(block.shape) / n

    values, found = jacobi_davidson(product, width, k) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    real = values > width * 2.0**-50 * trace
    values, found = values[real], found[:, real]
    found = found * np.where(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])] < 0, -1.0, 1.0) if len(values) else found
    error = 0.0
    if len(values):
        turn = found / np.sqrt(values)
        middle = _fold(fit, width, len(values), lambda x: ((x - mean) @ turn).sum(axis=0)) / n

        def piece(x: np.ndarray) -> np.ndarray:
            white = (x - mean) @ turn - middle
            return white.T @ white

        error = float(np.abs(_fold(fit, width, len(values) ** 2, piece).reshape(len(values), -1) / n - np.eye(len(values))).max())
    return Fitted(n, sums, found, values, [float(v) / trace for v in values], error, passes)


def whitened(embeddings: DataFrame, model: Fitted | None) -> DataFrame:
    """A row per valid vector of ``embeddings(vec_id, embedding, ...)`` and component."""
    if model is None or not len(model.values):
        return embeddings.sparkSession.range(0).selectExpr(*(f"cast(null as {t}) as {c}" for c, t in (x.split() for x in OUT.split(", "))))
    n, sums, mean, k = model.n, model.sums, model.mean, len(model.values)
    turn, width = model.vectors / np.sqrt(model.values), len(model.sums)
    shift = np.array(sums, dtype=object)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors(batch.column("embedding"), width)
            if not len(at):
                continue
            reach = n * int(np.abs(x).max()) + max(map(abs, sums))
            exact = n * (x if width * reach * reach < 1 << 62 else x.astype(object)) - (shift.astype(np.int64) if width * reach * reach < 1 << 62 else shift)
            deviation = (exact * exact).sum(axis=1)
            deviations = [int(d) if d < 1 << 63 else None for d in deviation.tolist()]
            white = (x - mean) @ turn
            ids = batch.column("vec_id").take(pa.array(np.repeat(at, k))).cast(pa.int64())
            m = len(at)
            yield pa.record_batch(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array([d for d in deviations for _ in range(k)], pa.int64()),
                    pa.array(white.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    return embeddings.select("vec_id", "embedding").mapInArrow(task, OUT)
