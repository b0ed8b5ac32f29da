"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

No covariance matrix is formed. Every product of the covariance with a block of directions is one
pass over the table: a task centres its vectors, multiplies them twice and hands on one sum of
(dimension x directions) numbers, which Spark adds up. The driver keeps matrices of that size
only, whatever the number of rows. One round of the search:

* Rayleigh-Ritz in the search space gives approximate pairs and their residuals;
* pairs whose residual has reached double precision are locked: they stay in the space and are
  projected out of the corrections, and are worked on no more;
* the correction equation (I - QQ')(V - theta)(I - QQ')t = -r of every other pair is solved by a
  few steps of MINRES, all pairs side by side, so that a step is one pass;
* the corrections are made orthogonal to the space and join it. A full space is cut back to its
  best Ritz vectors.

Entries become whole numbers x = floor(64 * c) + 1,000,000, so that counts, sums and deviations
are exact; centring subtracts the whole part of the mean first.

Nulls, ties, repeats: a row whose vector is null, or holds a null, non-finite or larger entry than
LARGEST, is left out. Vectors must be of one length: the most frequent one counts (ties: the
smaller), rows of another length are left out, as are empty vectors. Rows without vec_id and rows
that repeat one are fitted and returned each. Directions without variance cannot be whitened and
are not returned (none at all for a single row or equal rows); an empty table gives an empty
result. A deviation beyond a long is null. Only `vec_id` and `embedding` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the whole-number form of an entry.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no whole-number form that sums stay exact with.
LARGEST = 2.0**30
#: Ritz vectors that are corrected beside the wanted ones.
GUARD = 8
#: Steps of MINRES for a correction; most rounds; search directions before a restart, in blocks.
INNER, ROUNDS, BLOCKS = 5, 60, 4
#: Least eigenvalue that counts as variance, as a part of the largest.
NO_VARIANCE = 1e-10
#: Rows that are multiplied at a time.
ROWS = 2048


def _whole(batch: pa.RecordBatch, column: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors as whole numbers) of the rows that take part, of length `size`."""
    lists = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    with np.errstate(invalid="ignore"):
        wrong = ~(known & (np.abs(values) <= LARGEST))
    bad = np.concatenate([[0], np.cumsum(wrong)])
    fits = (lengths == size) & (bad[edges[1:]] == bad[edges[:-1]])
    rows = np.flatnonzero(fits)
    picked = values[edges[rows][:, None] + np.arange(size)]
    return rows, np.floor(SCALE * picked).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Moments:
    """Number of the vectors that take part, and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def centred(self, values: np.ndarray) -> np.ndarray:
        """x - S/n in double precision; the whole part of the mean goes first, exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (values - whole) - rest

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 of each row, exact; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        away = values - whole
        if len(away) and (int(np.abs(away).max()) + 1) ** 2 * self.n**2 * len(self.sums) < 1 << 62:
            return ((away * self.n - rest) ** 2).sum(axis=1).tolist()
        exact = ((away.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1) if len(away) else []
        return [int(value) if value < 1 << 63 else None for value in exact]


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: unit eigenvectors as columns, by falling eigenvalue."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _table(slots: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array(slots, pa.int64()), pa.array(values, kind)], names=["slot", "value"])


def _summed(source: DataFrame, size: int, of_rows: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all vectors of the array that `of_rows` makes of some of them; one pass."""
    whole = kind == "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, values = _whole(batch, 0, size)
            for first in range(0, len(values), ROWS):
                part = of_rows(values[first : first + ROWS])
                total = part if total is None else total + part
        if total is not None:
            yield _table(np.arange(len(total)), total, pa.int64() if whole else pa.float64())

    parts = source.select("embedding").mapInArrow(run, f"slot long, value {kind}")
    rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()  # one number a slot
    found = np.zeros(len(rows), np.int64 if whole else np.float64)
    for slot, value in rows:
        found[slot] = value
    return found


def moments(embeddings: DataFrame) -> tuple[Moments, int] | None:
    """(moments, length) of the vectors that take part; None if there are none."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST) & ~F.isnan(x.cast("double")))
    sizes = embeddings.where(F.col("embedding").isNotNull() & fit).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.where("size > 0").orderBy(F.desc("count"), "size").first()
    if most is None:
        return None
    size = most["size"]
    found = _summed(embeddings, size, lambda values: np.append(values.sum(axis=0), len(values)), "long")
    return Moments(int(found[-1]), [int(value) for value in found[:-1]]), size


class CovarianceProducts:
    """Products of the covariance with blocks of directions, a pass over the table each."""

    def __init__(self, embeddings: DataFrame, mean: Moments, size: int) -> None:
        self.source, self.mean, self.size = embeddings, mean, size
        self.passes, self.trace = 0, 0.0

    def __call__(self, directions: np.ndarray) -> np.ndarray:
        mean = self.mean

        def of_rows(values: np.ndarray) -> np.ndarray:
            centred = mean.centred(values)
            return np.append((centred.T @ (centred @ directions)).ravel(), np.square(centred).sum())

        found = _summed(self.source, self.size, of_rows, "double") / mean.n
        self.passes += 1
        self.trace = float(found[-1])
        return found[:-1].reshape(directions.shape)


def minres(
    product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, basis: np.ndarray, right: np.ndarray, steps: int
) -> np.ndarray:
    """About (P (V - shift) P)^-1 right for every column, P leaving the basis out; a step is one product."""

    def outside(block: np.ndarray) -> np.ndarray:
        return block - basis @ (basis.T @ block)

    def divided(block: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.divide(block, by, out=np.zeros_like(block), where=by > 0)

    right = outside(right)
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    now, before = divided(right, beta), np.zeros_like(right)
    solution, step_one, step_two = (np.zeros_like(right) for _ in range(3))
    rest = beta.copy()
    cos, cos_before = np.ones_like(beta), np.ones_like(beta)
    sin, sin_before = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        image = outside(product(now) - now * shifts)
        alpha = (now * image).sum(axis=0)
        image -= now * alpha + before * beta
        beta_next = np.linalg.norm(image, axis=0)
        diagonal = cos * alpha - cos_before * sin * beta
        length = np.hypot(diagonal, beta_next)
        second = sin * alpha + cos_before * cos * beta
        third = sin_before * beta
        direction = divided(now - third * step_two - second * step_one, length)
        cos_before, sin_before = cos, sin
        cos, sin = divided(diagonal, length), divided(beta_next, length)
        solution += direction * (cos * rest)
        rest = -sin * rest
        step_two, step_one = step_one, direction
        beta_next = np.where(beta_next > 1e-13 * np.maximum(start, 1e-300), beta_next, 0.0)
        before, now, beta = now, divided(image, beta_next), beta_next
        if (np.abs(rest) <= 0.05 * start).all():
            break
    return solution


def _joined(space: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Unit directions of `fresh` that are new to the space, orthogonal to it and to each other."""
    found: list[np.ndarray] = []
    for column in fresh.T:
        size = np.linalg.norm(column)
        if size == 0 or space.shape[1] + len(found) >= len(column):
            continue
        column = column / size
        for _ in range(3):
            known = np.column_stack([space, *found]) if found else space
            column = column - known @ (known.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            found.append(column)
    return np.column_stack(found) if found else np.zeros((len(space), 0))


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors) of the `wanted` largest eigenvalues, residuals at double precision."""
    wanted = min(wanted, size)
    block = min(size, wanted + GUARD)
    random = np.random.default_rng(seed)
    space = np.linalg.qr(random.standard_normal((size, block)))[0]
    images = product(space)
    before = np.full(wanted, np.inf)
    for _ in range(ROUNDS):
        inner = space.T @ images
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        ritz, ritz_images = space @ turned[:, :block], images @ turned[:, :block]
        residuals = ritz_images - ritz * values[:block]
        norms = np.linalg.norm(residuals, axis=0)
        largest = max(abs(values[0]), np.finfo(float).tiny)
        exact = size * np.finfo(float).eps * largest
        # A residual that sums of doubles cannot lower further is at double precision as well.
        floor = (norms[:wanted] <= 1e3 * exact) & (norms[:wanted] > 0.5 * before)
        locked = (norms[:wanted] <= exact) | floor
        if locked.all() or space.shape[1] >= size:
            return values[:wanted], ritz[:, :wanted]
        before = norms[:wanted]
        open_ = np.flatnonzero(np.append(~locked, np.ones(block - wanted, bool)) & (norms > exact))
        fresh = minres(product, values[open_], ritz, -residuals[:, open_], INNER)
        if space.shape[1] + len(open_) > BLOCKS * block:
            keep = min(space.shape[1], 2 * block)
            space, images = space @ turned[:, :keep], images @ turned[:, :keep]
        more = _joined(space, np.column_stack([fresh, residuals[:, open_]]) if not fresh.any() else fresh)
        if not more.shape[1]:
            more = _joined(space, random.standard_normal((size, block)))
        space, images = np.column_stack([space, more]), np.column_stack([images, product(more)])
    raise RuntimeError(f"residuals of {int((~locked).sum())} of {wanted} eigenvectors are not at double precision")


def fitted(embeddings: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all vectors that take part; None where no direction has variance."""
    known = moments(embeddings)
    if known is None:
        return None
    mean, size = known
    product = CovarianceProducts(embeddings, mean, size)
    values, vectors = leading_pairs(product, size, components)
    some = values > NO_VARIANCE * max(values[0], 0.0)
    if values[0] <= 0 or not some.any():
        return None
    return Whitening(mean, np.ascontiguousarray(vectors[:, some]), values[some], product.trace)


def identity_error(embeddings: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; one pass."""
    mean, matrix = model.moments, model.matrix
    size, count = matrix.shape

    def of_rows(values: np.ndarray) -> np.ndarray:
        white = mean.centred(values) @ matrix
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    found = _summed(embeddings, size, of_rows, "double") / mean.n
    middle = found[count * count :]
    covariance = found[: count * count].reshape(count, count) - np.outer(middle, middle)
    return float(np.abs(covariance - np.eye(count)).max())


def whitened(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays by component) and identity_error of every row that takes part."""
    spark = embeddings.sparkSession
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    model = fitted(embeddings, components)
    if model is None:
        return spark.createDataFrame([], schema)
    mean, matrix, error = model.moments, model.matrix, identity_error(embeddings, model)
    explained = pa.array((model.values / model.trace).tolist(), pa.float64())
    size, count = matrix.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = _whole(batch, 1, size)
            for first in range(0, len(rows), ROWS):
                part, some = values[first : first + ROWS], len(rows[first : first + ROWS])
                edges = pa.array(np.arange(some + 1) * count, pa.int32())
                again = explained.take(pa.array(np.tile(np.arange(count), some)))
                white = pa.array((mean.centred(part) @ matrix).ravel())
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(rows[first : first + ROWS])),
                        pa.array(np.full(some, mean.n)),
                        pa.array(mean.deviations(part), pa.int64()),
                        pa.ListArray.from_arrays(edges, white),
                        pa.ListArray.from_arrays(edges, again),
                        pa.array(np.full(some, error)),
                    ],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, schema)
