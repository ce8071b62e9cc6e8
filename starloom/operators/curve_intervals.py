"""Bootstrap intervals of areas under ROC curves, in one pass over the rows.

Drawing rows with replacement gives each of many rows about a Poisson(1) number of copies, independent
of the others (the Poisson bootstrap of Chamandy et al. 2012). The number is a function of the row's key and the
replicate, so no row is moved or drawn twice differently when a task runs again. A task adds the copies of all
replicates by score bin; its table has a fixed size, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.roc import curve_points, long_scores, _areas
from starloom.plans.selection import group_quantiles
from starloom.plans.session import stage_table

BINS = 512
_ROWS = 4096
_PIECE = 25
#: Upper ends of Poisson(1) on the scale of 64-bit hashes: the chance of at most k copies.
_POISSON = np.array([min(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2.0 ** 64), 2 ** 64 - 1) for k in range(16)], np.uint64)


def poisson_copies(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Copies of each key (64-bit hashes) in each replicate; replicate 0 holds every row once."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + replicates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    copies = np.searchsorted(_POISSON, z, side="right")
    copies[:, replicates == 0] = 1
    return copies


def _counted(edges: dict[str, np.ndarray], classes: int, replicates: int, bins: int):
    """Copies of the rows of a task by (curve, bin, hit, replicate), packed by curve and piece of replicates."""
    curves = [*[str(c + 1) for c in range(classes)], "micro"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(curves), bins * 2, replicates + 1), np.int64)
        for batch in batches:
            keys, truth = batch.column("key").to_numpy(), batch.column("truth").to_numpy()
            scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), classes)
            for start in range(0, len(keys), _ROWS):
                part = slice(start, start + _ROWS)
                copies = poisson_copies(keys[part], np.arange(replicates + 1))
                for c in range(classes):
                    own = np.flatnonzero(~np.isnan(scores[part, c]))
                    for curve in (c, classes):
                        if not len(own):
                            continue
                        cell = np.searchsorted(edges[curves[curve]], scores[part, c][own], side="right") * 2 + (truth[part][own] == c + 1)
                        order = np.argsort(cell, kind="stable")
                        first = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) > 0]))
                        table[curve, cell[order][first]] += np.add.reduceat(copies[own[order]], first, axis=0)
        for curve, name in enumerate(curves):
            for piece, low in enumerate(range(0, replicates + 1, _PIECE)):
                data = np.ascontiguousarray(table[curve, :, low:low + _PIECE]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece], pa.int32()), pa.array([data], pa.binary())], names=["curve", "piece", "counts"])

    return run


def _summed(bins: int):
    """Areas by (curve, replicate) from the summed tables, which come one (curve, piece) after the other."""
    def areas(name: str, piece: int, table: np.ndarray) -> pa.RecordBatch:
        neg, pos = table[::-1].reshape(bins, 2, -1).transpose(1, 0, 2)[::-1].astype(float)
        above = np.cumsum(pos, axis=0) - pos
        whole = pos.sum(axis=0) * neg.sum(axis=0)
        known = np.flatnonzero(whole > 0)
        area = (neg * (above + pos / 2)).sum(axis=0)[known] / whole[known]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(known), pa.string()), pa.array(known + piece * _PIECE, pa.int32()), pa.array(area)], names=["curve", "replicate", "auc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            for name, piece, data in zip(batch.column("curve").to_pylist(), batch.column("piece").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(data.as_buffer(), np.int64).reshape(bins * 2, -1)
                if (name, piece) != now:
                    if now is not None:
                        yield areas(*now, table)
                    now, table = (name, piece), np.zeros(counts.shape, np.int64)
                table += counts
        if now is not None:
            yield areas(*now, table)

    return run


def auc_intervals(df: DataFrame, key: str, truth: str, scores: Sequence[Column], replicates: int = 400, level: float = 0.95, bins: int = BINS, seed: int = 1) -> DataFrame:
    """(curve, auc, low, high, replicates) of every class curve (labels 1, 2, ...) and the pooled 'micro' curve.

    ``auc`` is exact. The replicates count by quantile bins of the scores, ties inside a bin as halves; the interval is
    moved by what the bins change in the whole table's area. In the pooled curve a row's scores share its copies. Rows with a null
    truth and null or NaN scores are left out; rows of equal key are drawn together. A curve without
    hits or without misses has no row.
    """
    wide = df.where(F.col(truth).isNotNull()).select(F.xxhash64(F.col(key), F.lit(seed)).alias("key"), F.col(truth).cast("int").alias("truth"),
                                                     F.transform(F.array(*[s.cast("double") for s in scores]), lambda s: F.coalesce(s, F.lit(float("nan")))).alias("scores"))
    wide = stage_table(wide, "scores")
    own = [F.when(~F.isnan(F.get("scores", F.lit(i))), F.get("scores", F.lit(i))) for i in range(len(scores))]
    rows = long_scores(wide, "truth", own).where("score IS NOT NULL")
    steps = [(i + 1) / bins for i in range(bins - 1)]
    edges = {name: np.zeros(0) for name in (*[str(c + 1) for c in range(len(scores))], "micro")}
    found: dict[str, set[float]] = {}
    for r in group_quantiles(rows, "score", steps, ["curve"]).select("curve", "quantile").collect():  # bins a curve
        found.setdefault(r.curve, set()).add(r.quantile)
    edges |= {c: np.array(sorted(q)) for c, q in found.items()}
    pieces = len(edges) * -(-(replicates + 1) // _PIECE)
    counts = wide.mapInArrow(_counted(edges, len(scores), replicates, bins), "curve string, piece int, counts binary")
    drawn = stage_table(counts.repartition(min(pieces, 200), "curve", "piece").sortWithinPartitions("curve", "piece").mapInArrow(_summed(bins), "curve string, replicate int, auc double"), "areas")
    tail = (1 - level) / 2
    spread = drawn.where("replicate > 0").groupBy("curve").agg(F.percentile("auc", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("*").alias("replicates"))
    whole = drawn.where("replicate = 0").select("curve", F.col("auc").alias("binned"))
    exact = _areas(curve_points(rows)).where("auc IS NOT NULL")
    moved = F.col("auc") - F.col("binned")
    return exact.join(whole, "curve").join(spread, "curve").select("curve", "auc", (F.get("q", F.lit(0)) + moved).alias("low"), (F.get("q", F.lit(1)) + moved).alias("high"), "replicates")
