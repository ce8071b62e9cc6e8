"""Ordering, best-of, differences between runs and unions of reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def improvement(runs: DataFrame, keys: Sequence[str], order: str, metric: str, time: str) -> DataFrame:
    """Change of metric and time against the previous run of the same series, and their ratio."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.lag(metric).over(w).isNull()
    d_metric, d_time = F.col(metric) - F.lag(metric).over(w), F.col(time) - F.lag(time).over(w)
    return runs.select(
        "*", F.when(first, 0.0).otherwise(d_metric).alias(f"{metric}_diff"),
        F.when(first, 0.0).otherwise(d_time).alias(f"{time}_diff"),
        F.when(~first, F.try_divide(d_metric, d_time)).alias("improvement_ratio"))


def best_run(runs: DataFrame, metric: str, tie: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The run with the highest metric (first on ties), overall or per key; an aggregate, no sort."""
    payload = F.struct(*runs.columns)
    best = F.max_by(payload, F.struct(F.col(metric), -tie)).alias("best")
    grouped = runs.groupBy(*keys) if keys else runs
    return grouped.agg(best).select("best.*")


def largest(df: DataFrame, columns: Sequence[str], k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest values of ``columns``."""
    return df.orderBy(*[F.desc(c) for c in columns], *ties).limit(k)


def append_reports(*reports: DataFrame) -> DataFrame:
    """Union by name of reports with differing columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two frames side by side, aligned on an explicit (rank) key."""
    return left.join(right, key)


def preview(df: DataFrame, columns: Sequence[str], rows: int = 10, sample: bool = False, seed: int = 1) -> DataFrame:
    """At most ``rows`` rows of the given columns, optionally from a proportional sample."""
    out = df.select(*columns)
    if sample:
        total = df.count()
        out = out.sample(False, min(rows / total, 1.0) if total else 1.0, seed)
    return out.limit(rows)


def show_df(df: DataFrame, columns: Sequence[str], rows: int = 10, sample: bool = False, truncate: bool = True) -> None:
    """Print a preview."""
    preview(df, columns, rows, sample).show(rows, truncate=truncate)
