"""Quality scores by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.session import stage_table

CUT = 0.7
SHRINK_TO_POOLED = 0.2
SHRINK_TO_SPHERE = 0.02
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_STOP, _LOUD, _SYMBOL, _BAR, _OTHER = ([ord(c) for c in x] for x in (".,;:", "!?", "#$%&*@^~<>=+_\\/", "|", "()[]{}\"'`-"))
FEATURES = 16


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text: sizes as logarithms, shares as logits with a half added to each side."""
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, words, lines = len(data), data.split(), [x for x in data.split(b"\n") if x.strip()]
    distinct, distinct_lines = len(set(words)), len(set(lines))
    letters = int(count[_UPPER].sum() + count[_LOWER].sum() + count[192:].sum())

    def share(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)) - np.log(1 / (whole + 1)) / 8)

    return [
        np.log1p(size), np.log1p(len(words)), np.log1p(sum(map(len, words)) / max(1, len(words))), np.log1p(len(lines)), np.log1p(size / max(1, len(lines))),
        share(count[_UPPER].sum(), letters), share(letters, size), share(count[_DIGIT].sum(), size), share(count[_STOP].sum(), len(words)), share(count[_LOUD].sum(), len(words)),
        share(count[_SYMBOL].sum(), size), share(count[_BAR].sum(), size), share(count[_OTHER].sum(), size), np.log1p(len(words)) - np.log1p(distinct), share(distinct_lines, len(lines)),
        share(sum(1 for w in words if len(w) == 1), len(words)),
    ]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "held_out", "x"])


_MOMENTS = "label int, n long, mean array<double>, scatter array<double>"


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and centred scatters of several parts as those of all (no sums of squares are subtracted)."""
    n, mean, scatter = 0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
    for m, other, spread in parts:
        step, total = other - mean, n + m
        scatter = scatter + spread + np.outer(step, step) * (n * m / total)
        mean, n = mean + step * (m / total), total
    return n, mean, scatter


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        x = np.array(batch.column("x").to_pylist()).reshape(len(labels), -1)
        for label in found:
            own = x[labels == label]
            if len(own):
                mean = own.mean(axis=0)
                found[label] = [_merge([*found[label], (len(own), mean, (own - mean).T @ (own - mean))])]
    rows = [(label, n, mean, scatter.ravel()) for label, parts in found.items() for n, mean, scatter in parts]
    if rows:
        label, n, mean, scatter = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(n, pa.int64()), pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(scatter), pa.list_(pa.float64()))],
                                         names=["label", "n", "mean", "scatter"])


def _merge_group(group: pd.DataFrame) -> pd.DataFrame:
    n, mean, scatter = _merge([(int(r.n), np.array(r.mean), np.array(r.scatter).reshape(FEATURES, FEATURES)) for r in group.itertuples(index=False, name="Row") if r.n])
    return pd.DataFrame({"label": [int(group["label"].iloc[0])], "n": [n], "mean": [mean], "scatter": [scatter.ravel()]})


@dataclass
class Discriminant:
    """Two Gaussian classes in standardised statistics, each with the cached Cholesky factor of its covariance."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the logistic of the difference of the Mahalanobis log-densities and the priors."""
        if not self.factors:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor in zip(self.means, self.factors):
            whitened = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * (whitened ** 2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -500, 500)))


def fit(moments: list[tuple[int, int, np.ndarray, np.ndarray]], to_pooled: float = SHRINK_TO_POOLED, to_sphere: float = SHRINK_TO_SPHERE) -> Discriminant:
    """Class covariances shrunk towards the pooled one and that towards a sphere.

    With one class only the score is that class's label; with none it is one half.
    """
    have = {label: (n, mean, scatter) for label, n, mean, scatter in moments if n}
    if len(have) < 2:
        return Discriminant(float(next(iter(have))) if have else 0.5, np.zeros(FEATURES), np.ones(FEATURES), [], [])
    total, centre, scatter = _merge([have[0], have[1]])
    scale = np.sqrt(np.maximum(np.diag(scatter) / total, 1e-12))
    pooled = (have[0][2] + have[1][2]) / total / np.outer(scale, scale)
    target = (1 - to_sphere) * pooled + to_sphere * max(np.trace(pooled) / FEATURES, 1e-9) * np.eye(FEATURES)
    means, factors = [], []
    for label in (0, 1):
        n, mean, spread = have[label]
        means.append((mean - centre) / scale)
        factors.append(np.linalg.cholesky((1 - to_pooled) * spread / n / np.outer(scale, scale) + to_pooled * target))
    return Discriminant(have[1][0] / total, centre, scale, means, factors)


def _score(model: Discriminant, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT) -> DataFrame:
    """id, held_out, score (probability of label 1) and predicted (1 from ``cut`` on) of every document.

    All labelled rows that are not ``held_out`` teach the model; only their text is looked at.
    Statistics are computed once into a staged table; counts, means and scatters are summed per
    task and merged. A null text is empty and scored like one; rows with a null id are scored and
    never learnt from; labels other than 0 and 1 are ignored; a document with several labels
    counts once for each. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    described = stage_table(rows.mapInArrow(_describe, f"id {kind}, held_out boolean, x array<double>"), "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = described.where("not held_out").join(marks, "id").select("label", "x")
    moments = known.mapInArrow(_moments, _MOMENTS).groupBy("label").applyInPandas(_merge_group, _MOMENTS).collect()  # a row for each label
    model = fit([(r["label"], r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(FEATURES, FEATURES)) for r in moments])
    return described.mapInArrow(_score(model, cut), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
