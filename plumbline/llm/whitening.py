"""Whitening of embeddings onto their leading components, by spectrum slicing.

Entries become integers, floor(256 * c). The fit list holds every distinct vector once; its size and sums
are exact. Its covariance is summed over blocks of centred vectors, one small matrix for each task, added
up by Spark. What reaches the driver is that one matrix of dims x dims, whatever the table.

There every leading eigenvalue is isolated and then refined:
* the LDL' factors of the covariance less a shift have as many positive pivots as there are eigenvalues
  above the shift (Sylvester). Bisection by that count finds an interval that holds the i-th eigenvalue
  and no other.
* Rayleigh quotient iteration from inside the interval converges cubically. If it leaves the interval,
  the interval is halved and the iteration starts again.
* counts on both sides of the result certify its number.
Equal eigenvalues can't be isolated; where an interval is as narrow as rounding, its vectors are found one after
another, each orthogonal to those before, and are as good as any others of that space.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so
are those of another length than most rows have (ties: the longer). Rows without vec_id and repeated rows are
rows like any other; equal vectors count once in the fit. Components without variance are not returned, so
fewer than `K` come of fewer dimensions or distinct vectors, and none of a single one. A deviation beyond
64 bits is null. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import settle

K = 4
EPS = float(np.finfo(float).eps)
_LOW = 20  # bits of the lower part when integers are summed


def positive_pivots(matrix: np.ndarray) -> int:
    """The number of positive eigenvalues, from LDL' with Bunch and Parlett's pivots.

    A 2 x 2 pivot is taken where the diagonal is small; it has one eigenvalue of each sign.
    """
    a, positive = np.array(matrix, float), 0
    threshold = (1 + 17 ** 0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        if not max(diagonal.max(), off.max()):
            break  # what is left is zero
        if diagonal.max() >= threshold * off.max():
            chosen = [int(diagonal.argmax())]
            positive += int(a[chosen[0], chosen[0]] > 0)
        else:
            chosen = list(divmod(int(off.argmax()), len(a)))
            positive += 1
        others = np.setdiff1d(np.arange(len(a)), chosen)
        side = a[np.ix_(others, chosen)]
        a = a[np.ix_(others, others)] - side @ np.linalg.solve(a[np.ix_(chosen, chosen)], side.T)
    return positive


def _apart(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    vector = vector / np.abs(vector).max()
    for _ in range(2):
        for other in found:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, slack: float) -> np.ndarray:
    """The vector through the inverse of the shifted matrix; an exact eigenvalue is moved by rounding."""
    shifted = matrix - shift * np.eye(len(matrix))
    try:
        return np.linalg.solve(shifted, vector)
    except np.linalg.LinAlgError:
        return np.linalg.solve(shifted - slack * np.eye(len(matrix)), vector)


def _refine(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], slack: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration to the eigenvalue in (low, high); None if it leaves the interval."""
    vector = _apart(np.random.default_rng(len(found)).standard_normal(len(matrix)), found)
    shift = (low + high) / 2
    for step in range(40):
        vector = _apart(_solve(matrix, shift, vector, slack), found)
        quotient = float(vector @ matrix @ vector)
        inside = low - slack <= quotient <= high + slack
        if step < 3:
            continue  # the first steps keep the middle as shift
        if not inside:
            return None
        if step > 5 and np.linalg.norm(matrix @ vector - quotient * vector) <= slack:
            return quotient, vector
        shift = quotient
    return None


def leading(matrix: np.ndarray, k: int = K) -> list[tuple[float, np.ndarray]]:
    """The k greatest eigenvalues above rounding, falling, with unit eigenvectors (largest entry positive)."""
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not scale:
        return []
    matrix = matrix / scale  # every eigenvalue is at most 1
    slack, eye = 4 * EPS * len(matrix), np.eye(len(matrix))
    found: list[tuple[float, np.ndarray]] = []

    def above(shift: float) -> int:
        return positive_pivots(matrix - shift * eye)

    for number in range(1, min(k, len(matrix)) + 1):
        low, high, n_low, n_high = slack, 1 + slack, above(slack), 0
        if n_low < number:
            break  # no variance is left
        while True:
            narrow = high - low <= slack
            if narrow or n_low - n_high == 1:
                refined = _refine(matrix, low, high, [v for _, v in found], slack)
                if refined and above(refined[0] + 2 * slack) < number <= above(refined[0] - 2 * slack):
                    break
                if narrow:
                    raise ArithmeticError(f"eigenvalue {number} could not be certified")
            middle = (low + high) / 2
            n_middle = above(middle)
            low, high, n_low, n_high = (middle, high, n_middle, n_high) if n_middle >= number else (low, middle, n_low, n_middle)
        value, vector = refined
        found.append((value, vector * np.sign(vector[np.abs(vector).argmax()])))
    return [(value * scale, vector) for value, vector in found]


def exact(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.transform("entries", lambda c: F.floor(c * 256))
    usable = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("entries"))
    rows = rows.where((F.size("entries") > 0) & usable).select("vec_id", whole.alias("x"))
    # One row for each length.
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], dtype: str, exact_sum: str) -> np.ndarray:
    """The sum over the fit list of an array that `part` makes of a block of it; blocks are added in their task first."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(_matrix(batch.column("x")))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.from_numpy_dtype(total.dtype)))], names=["values"])

    summed = fit.select("x").mapInArrow(blocks, f"values array<{dtype}>").select(F.posexplode("values").alias("place", "value"))
    rows = summed.groupBy("place").agg(F.sum(F.col("value").cast(exact_sum)).alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in rows], object)


@dataclass(frozen=True)
class Centre:
    """The exact size and sums of the fit list: sum = whole * n + rest in every dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the integers are subtracted first, so that nothing is lost."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2, exact; None beyond 64 bits."""
        apart = x - self.whole
        widest = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if x.shape[1] * widest * widest < 1 << 62:
            return ((self.n * apart - self.rest) ** 2).sum(axis=1).tolist()
        sums = ((self.n * apart.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [s if s < 1 << 63 else None for s in sums]


def centre(fit: DataFrame) -> Centre | None:
    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)])

    summed = _added(fit, halves, "bigint", "decimal(38,0)")
    if not len(summed):
        return None
    n, dims = int(summed[0]), (len(summed) - 1) // 2
    sums = [(int(high) << _LOW) + int(low) for high, low in zip(summed[1:dims + 1], summed[dims + 1:], strict=True)]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, k: int = K) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows = exact(embeddings)
    fit = settle(rows.select("x").distinct(), "whitening-fit")
    at = centre(fit)
    if at is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    dims = len(at.whole)

    def products(x: np.ndarray) -> np.ndarray:
        c = at.centred(x)
        return c.T @ c

    covariance = _added(fit, products, "double", "double").astype(float).reshape(dims, dims) / at.n
    found = leading((covariance + covariance.T) / 2, k)
    if not found:
        return embeddings.sparkSession.createDataFrame([], OUT)
    scale = np.array([vector / value ** 0.5 for value, vector in found]).T
    explained = [value / float(np.trace(covariance)) for value, _ in found]

    def moments(x: np.ndarray) -> np.ndarray:
        w = at.centred(x) @ scale
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    summed = _added(fit, moments, "double", "double").astype(float) / at.n
    means, squares = summed[:len(found)], summed[len(found):].reshape(len(found), len(found))
    error = float(np.abs(squares - np.outer(means, means) - np.eye(len(found))).max())

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(found)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), at.n)), pa.array(at.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array((at.centred(x) @ scale).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
            ], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(projected, OUT)
