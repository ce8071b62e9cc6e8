"""t-tests, bootstrap intervals and permutation tests of classification metrics.

Resampling works on the confusion matrix: drawing n rows with replacement is a multinomial
draw over its cells, and splitting pooled predictions in two halves is a multivariate
hypergeometric draw. A replicate costs classes^2 numbers, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value column."""

    @F.pandas_udf("double")
    def values(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([student_p_value(a, b) for a, b in zip(ts, dfs)])

    return values(t, df)


def t_test(df: DataFrame, group: str, measure: str, first: object, second: object) -> DataFrame:
    """Two-sample t-test (pooled variance) between two groups: one row with t, df and p."""
    def side(value: object, name: str) -> list[Column]:
        v = F.when(F.col(group) == F.lit(value), F.col(measure))
        return [F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}"), F.count(v).alias(f"n_{name}")]

    s = df.where(F.col(group).isin(first, second)).agg(*side(first, "a"), *side(second, "b"))
    freedom = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / freedom
    s = s.select("*", freedom.alias("df"), ((F.col("mean_a") - F.col("mean_b")) / F.sqrt(
        pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"))
    return s.withColumn("p", p_value("t", "df"))


def _cells(df: DataFrame, truth: str, prediction: str, n_classes: int) -> Column:
    """Confusion counts as one row-major array (a scalar subquery over one grouped pass)."""
    k = n_classes
    counts = df.groupBy(truth, prediction).agg(F.count("*").alias("n"))
    cell = ((F.col(truth) - 1) * k + F.col(prediction) - 1).cast("int")
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct(cell.alias("k"), F.col("n").alias("v")))).alias("m"))
    return row.select(F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)),
                                  lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0))).alias("cells")).scalar()


def _scores(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hits = matrix.diagonal(axis1=-2, axis2=-1).astype(float)
    predicted, support = matrix.sum(axis=-2), matrix.sum(axis=-1)
    precision = np.divide(hits, predicted, out=np.zeros_like(hits), where=predicted > 0)
    recall = np.divide(hits, support, out=np.zeros_like(hits), where=support > 0)
    both = precision + recall
    f1 = np.divide(2 * precision * recall, both, out=np.zeros_like(hits), where=both > 0)
    return precision, recall, f1


def bootstrap_reports(df: DataFrame, truth: str, prediction: str, n_classes: int, replicates: int = 5000, seed: int = 1) -> DataFrame:
    """Per-class precision, recall and F1 of bootstrap replicates of a prediction set."""
    spark = df.sparkSession
    drawn = spark.range(replicates).select(F.col("id").alias("replicate"), _cells(df, truth, prediction, n_classes).alias("cells"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for replicate, cells in zip(batch["replicate"], batch["cells"]):
                counts = np.asarray(cells, dtype=np.int64)
                total = int(counts.sum())
                rng = np.random.default_rng([seed, int(replicate)])
                sample = rng.multinomial(total, counts / total).reshape(n_classes, n_classes)
                precision, recall, f1 = _scores(sample)
                yield pd.DataFrame({"replicate": replicate, "label": np.arange(1, n_classes + 1), "precision": precision,
                                    "recall": recall, "f1": f1})

    return drawn.mapInPandas(draw, "replicate long, label int, precision double, recall double, f1 double")


def bootstrap_interval(df: DataFrame, truth: str, prediction: str, n_classes: int, replicates: int = 5000,
                       levels: Sequence[float] = (0.025, 0.975), seed: int = 1) -> DataFrame:
    """Percentile confidence interval of every class metric."""
    reports = bootstrap_reports(df, truth, prediction, n_classes, replicates, seed)
    long = reports.unpivot(["label"], ["precision", "recall", "f1"], "metric", "value")
    return long.groupBy("label", "metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(levels[0])).alias("low"),
        F.percentile("value", F.lit(levels[1])).alias("high"))


def permutation_test(df: DataFrame, truth: str, first: str, second: str, label: int, n_classes: int,
                     replicates: int = 10000, seed: int = 1) -> DataFrame:
    """Is the difference in precision of one class between two models explained by chance?

    Predictions of both models are pooled and split into random halves; the p-value is the
    share of splits whose difference is at least the observed one (first minus second).
    """
    a, b = _cells(df, truth, first, n_classes), _cells(df, truth, second, n_classes)
    drawn = df.sparkSession.range(replicates).select(F.col("id").alias("replicate"), a.alias("a"), b.alias("b"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for replicate, x, y in zip(batch["replicate"], batch["a"], batch["b"]):
                x, y = np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)
                pooled = x + y
                total = int(pooled.sum())
                rng = np.random.default_rng([seed, int(replicate)])
                half = rng.multivariate_hypergeometric(pooled, total // 2, method="marginals")
                shape = (n_classes, n_classes)
                p1, p2 = (_scores(m.reshape(shape))[0][label - 1] for m in (half, pooled - half))
                pa, pb = (_scores(m.reshape(shape))[0][label - 1] for m in (x, y))
                rows.append((p2 - p1, pa - pb))
            yield pd.DataFrame(rows, columns=["diff", "observed"])

    diffs = drawn.mapInPandas(split, "diff double, observed double")
    return diffs.agg(F.first("observed").alias("observed"), F.count("*").alias("replicates"),
                     F.avg((F.col("diff") >= F.col("observed")).cast("double")).alias("p_value"))
