"""Principal-component whitening of vectors by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.integer_vectors import integer_vectors

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
PASSES = 3
#: Variances below this share of the largest are not told from zero.
FLAT = 1e-10
_ROWS = 4096
_WHITENED = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer matrices of at most ``_ROWS`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part.column("id"), part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _summed(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, float]:
    """Element-wise sums over all rows of the arrays that ``made`` gives for blocks of rows.

    A task adds its blocks and sends one number a cell; Spark adds the tasks' numbers. Scans are
    merged to a few tasks a core, so what is sent does not grow with the table.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            block = made(x)
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    sums = rows.coalesce(tasks).mapInArrow(run, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in sums.collect()}  # one number a cell


def _square(cells: dict[int, float], width: int) -> np.ndarray:
    out = np.zeros(width * width)
    out[list(cells)] = list(cells.values())
    return out.reshape(width, width)


def _centre(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Rows minus the mean: the whole part of the mean is taken off in integers, so that nothing is lost to large offsets."""
    whole, rest = np.divmod(sums, n)
    return lambda x: (x - whole).astype(np.float64) - rest / n


def _factor(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix, of the matrix with a small multiple of the identity where asked or needed."""
    unit = 100 * len(gram) * np.finfo(float).eps * max(float(np.trace(gram)), np.finfo(float).tiny)
    shift = unit if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(unit, 100 * shift)


def components_of(rows: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (columns) and eigenvalues of the covariance, by falling eigenvalue, and the trace.

    Each pass forms the Gram matrix of the centred rows times the inverse of the factors found so
    far, by triangular solves inside the tasks, and takes its Cholesky factor; the first is shifted
    so that it exists for any condition. The product R of the factors is the R of the centred
    rows' QR, and its singular values and right vectors give the components. Constant dimensions
    take no part.
    """
    centre, width = _centre(n, sums), len(sums)
    spread = np.array([v for _, v in sorted(_summed(rows, lambda x: (centre(x) ** 2).sum(axis=0), "double").items())])
    live = np.flatnonzero(spread > 0)
    if not len(live):
        return np.zeros((width, 0)), np.zeros(0), 0.0
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        def gram(x: np.ndarray) -> np.ndarray:
            q = centre(x)[:, live].T
            for r in factors:
                q = _forward(r.T, q)
            return q @ q.T

        factors.append(_factor(_square(_summed(rows, gram, "double"), len(live)), k == 0))
    r = np.eye(len(live))
    for f in factors:
        r = f @ r
    _, size, right = np.linalg.svd(r)
    values = size ** 2 / n
    keep = values > FLAT * values[0]
    vectors = np.zeros((width, int(keep.sum())))
    vectors[live] = right[keep].T
    return vectors, values[keep], float(spread.sum() / n)


def _forward(lower: np.ndarray, b: np.ndarray, block: int = 32) -> np.ndarray:
    """Solve ``lower @ y = b`` by forward substitution over blocks of rows."""
    y = b.copy()
    for s in range(0, len(lower), block):
        e = min(s + block, len(lower))
        y[s:e] -= lower[s:e, :s] @ y[:s]
        for i in range(s, e):
            y[i] = (y[i] - lower[i, s:i] @ y[s:i]) / lower[i, i]
    return y


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S) squared per row, in integers; None where it passes a long."""
    whole, rest = np.divmod(sums, n)
    off = x - whole
    if float(np.abs(off).max(initial=0) + 1) * n < 2.0 ** 31 / max(1, len(sums)) ** 0.5:
        d = off * n - rest
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist())) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors are taken as integers floor(scale * c) + shift and fitted on all rows that take part.
    Every pass reads the staged integers once. ``identity_error`` is measured by one more pass over
    the whitened rows.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those
    whose length is not the most frequent one. A null id stays null; repeated rows count as often as they
    stand. Components whose variance is not told from zero (``FLAT``) are left out: with one row, or
    equal rows only, and for an empty table there are none, and no rows. Entries beyond
    2^52 / scale are outside the range of exact integers.
    """
    rows = integer_vectors(df, id_col, vector_col, scale, shift)
    totals = _summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    empty = rows.sparkSession.createDataFrame([], _WHITENED).withColumnRenamed("id", id_col)
    if not totals:
        return empty
    *sums, n = (totals[k] for k in sorted(totals))
    sums = np.array(sums, np.int64)
    vectors, values, trace = components_of(rows, n, sums)
    count = min(components, len(values))
    if not count:
        return empty
    centre, project = _centre(n, sums), vectors[:, :count] / np.sqrt(values[:count])
    second = _summed(rows, lambda x: np.column_stack([(w := centre(x) @ project), np.ones(len(x))]).T @ w, "double")
    moments = np.array([second[k] for k in sorted(second)]).reshape(count + 1, count) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(count)).max())
    share = values[:count] / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            white = centre(x) @ project
            size, row = white.size, pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, np.int64)), pa.array(_deviations(x, n, sums), pa.int64()).take(row),
                 pa.array(white.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(size, error))],
                names=[c.split()[0] for c in _WHITENED.split(", ")])

    return rows.mapInArrow(run, _WHITENED).withColumnRenamed("id", id_col)
