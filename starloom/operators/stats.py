"""Counts, shares, quantiles, bins and distribution summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.ranking import number_rows, rank_within
from starloom.plans.selection import group_quantiles
from starloom.plans.session import cut_lineage
from starloom.plans.sizing import lookup_join

#: Largest number of rows a group that Spark limits before the shuffle.
GROUP_LIMIT = 1000


def group_share(df: DataFrame, keys: Sequence[str], scale: float = 100.0, count: str = "n", share: str = "percent") -> DataFrame:
    """Rows per group and their share of all rows.

    The total is a scalar subquery over the grouped counts, so no window gathers the groups.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias(count))
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.col(count) / total * F.lit(scale))


def distinct_ratio(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, rows and their rounded percentage."""
    per_value = df.groupBy(column).agg(F.count("*").alias("__n"))
    summary = per_value.agg(F.count(column).alias("distinct_values"), F.sum("__n").alias("total_rows"))
    return summary.withColumn("percent", F.round(F.col("distinct_values") / F.col("total_rows") * 100))


def group_sizes(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    Spark limits each group before the shuffle up to its threshold; for larger ``k`` rows are ranked
    along a global order, so that a group spans many tasks.
    """
    if k > GROUP_LIMIT:
        placed = rank_within(df.withColumn("__group", F.struct(*keys)), "__group", list(order), name)
        return placed.where(F.col(name) <= k).drop("__group")
    return (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
            .where(F.col(name) <= k))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Weighted form of a numeric column: one row per distinct value (nulls included)."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("freq"))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of any measure, one row per (group and) probability."""
    return group_quantiles(df, column, probabilities, keys).select(*keys, "probability", "quantile")


def approximate_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = 10000) -> DataFrame:
    """Sketch-based quantiles for continuous measures at scale."""
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    row = df.agg(F.percentile_approx(column, list(probabilities), accuracy).alias("q"))
    return row.select(F.explode(F.arrays_zip(wanted.alias("probability"), F.col("q").alias("quantile"))).alias("z")).select(
        F.col("z.probability"), F.col("z.quantile"))


def cut(value: Column | str, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins ``(low, high]``; values outside, including the first edge, are null."""
    v = F.col(value) if isinstance(value, str) else value
    names = list(labels) if labels else [f"({low}, {high}]" for low, high in zip(edges, edges[1:])]
    out = None
    for low, high, name in zip(edges, edges[1:], names):
        inside = (v > low) & (v <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def fixed_width_bin(value: Column | str, width: float) -> Column:
    """Index of the right-closed bin of the given width (bin 1 is ``(0, width]``)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.ceil(v / F.lit(width))


def quantile_bins(df: DataFrame, column: str, probabilities: Sequence[float], name: str = "bin") -> DataFrame:
    """Number of the right-closed quantile bin of each row (null at or below the lowest edge).

    The edges are one row; they reach the rows as a scalar subquery.
    """
    found = exact_quantiles(df, column, sorted(probabilities))
    edges = found.agg(F.array_sort(F.collect_list("quantile"))).scalar()  # one entry per probability
    position = sum((F.get("__edges", F.lit(i)) < F.col(column)).cast("long") for i in range(len(probabilities)))
    placed = df.withColumn("__edges", edges).withColumn("__bin", position)
    inside = (F.col("__bin") >= 1) & (F.col("__bin") < len(probabilities))
    return placed.withColumn(name, F.when(inside, F.col("__bin"))).drop("__edges", "__bin")


def describe(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of a measure, optionally per group; all but count are null without values."""
    v = F.col(column)
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    found = group_quantiles(df.select(group.alias("__group"), v), column, [0.25, 0.5, 0.75], ["__group"])
    quartiles = found.groupBy("__group").agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    out = df.groupBy(group.alias("__group")).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    return out.join(quartiles, "__group", "left").select(*[F.col("__group")[k].alias(k) for k in keys], "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def date_part_counts(df: DataFrame, date: str) -> DataFrame:
    """Rows per month and per weekday (Monday = 0) in one pass."""
    parts = F.array(F.struct(F.lit("month").alias("part"), F.month(date).cast("long").alias("value")),
                    F.struct(F.lit("weekday").alias("part"), F.weekday(date).cast("long").alias("value")))
    return (df.select(F.inline(parts)).groupBy("part", "value").agg(F.count("*").alias("n")))


def vote_shares(df: DataFrame, helpful: str, total: str) -> DataFrame:
    """Counts and rounded percentages of rows with votes and with helpful votes."""
    counts = df.agg(F.count("*").alias("total_rows"), F.count_if(F.col(total) > 0).alias("with_votes"),
                    F.count_if(F.col(helpful) > 0).alias("with_helpful"))
    return counts.select("*", (F.round(F.col("with_votes") / F.col("total_rows"), 2) * 100).alias("votes_percent"),
                         (F.round(F.col("with_helpful") / F.col("total_rows"), 2) * 100).alias("helpful_percent"),
                         (F.round(F.col("with_helpful") / F.col("with_votes"), 2) * 100).alias("helpful_of_voted_percent"))


def compare_distributions(datasets: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Group shares of several datasets side by side, one row per dataset and group."""
    tagged = None
    for name, df in datasets.items():
        part = df.select(F.lit(name).alias("dataset"), *keys)
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("dataset", *keys).agg(F.count("*").alias("n"))
    totals = counts.groupBy("dataset").agg(F.sum("n").alias("__total"))
    return counts.join(totals, "dataset").select("dataset", *keys, "n", (F.col("n") / F.col("__total") * 100).alias("percent"))


def extreme_rows(df: DataFrame, measure: Column, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows with the largest and smallest measure; ties go to the smallest key."""
    names = list(dict.fromkeys([key, *columns]))
    payload = F.struct(*names, measure.alias("measure"))
    row = df.agg(F.max_by(payload, F.struct(measure, -F.col(key))).alias("longest"),
                 F.min_by(payload, F.struct(measure, F.col(key))).alias("shortest"))
    tagged = [F.struct(F.lit(which).alias("which"), *[F.col(f"{which}.{c}").alias(c) for c in [*names, "measure"]])
              for which in ("longest", "shortest")]
    return row.select(F.inline(F.array(*tagged)))


def term_counts(df: DataFrame, tokens: Column, name: str = "word", count: str = "occurrence") -> DataFrame:
    """Corpus frequency of every token."""
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias(count))


def mean_and_std(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of measures per group."""
    return df.groupBy(*keys).agg(*[e for m in measures for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def empirical_cdf(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative share per distinct value, overall or per group.

    The histogram is summed along a range-partitioned global order, so neither one group nor
    the whole histogram has to fit in a task.
    """
    histogram = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    running = number_rows(histogram, [*keys, column], "__rn", running={"__cum": "n"})
    if not keys:
        return running.select(column, "n", (F.col("__cum") / histogram.agg(F.sum("n")).scalar()).alias("cdf"))
    groups = running.groupBy(*keys).agg(F.min(F.col("__cum") - F.col("n")).alias("__before"), F.sum("n").alias("__total"))
    return lookup_join(running, groups, list(keys)).select(
        *keys, column, "n", ((F.col("__cum") - F.col("__before")) / F.col("__total")).alias("cdf"))


def feature_std(df: DataFrame, vector: str) -> DataFrame:
    """Sample standard deviation of every component of an array column."""
    return (df.select(F.posexplode(vector).alias("feature", "x")).groupBy("feature")
            .agg(F.stddev_samp(F.col("x").cast("double")).alias("std")))


def sparse_feature_std(cells: DataFrame, feature: str, value: str, rows: Column) -> DataFrame:
    """Sample standard deviation of every feature of a long sparse table; absent cells are zero.

    ``rows`` is the number of rows including all-zero ones (a literal or a scalar subquery).
    """
    x = F.col(value).cast("double")
    present = cells.groupBy(feature).agg(F.count(x).alias("__n"), F.avg(x).alias("__mean"), F.var_pop(x).alias("__var"))
    n, mean = F.col("__n"), F.col("__mean")
    return present.select(feature, F.sqrt((n * F.col("__var") + mean * mean * n * (rows - n) / rows) / (rows - 1)).alias("std"))


def extreme_features(stds: DataFrame, feature: str, digits: int = 9) -> DataFrame:
    """Features attaining the smallest or the largest standard deviation (to ``digits`` places)."""
    rounded = stds.select(feature, F.round("std", digits).alias("std"))
    ends = rounded.withColumns({"__lo": rounded.agg(F.min("std")).scalar(), "__hi": rounded.agg(F.max("std")).scalar()})
    which = F.array_compact(F.array(F.when(F.col("std") == F.col("__lo"), "min"), F.when(F.col("std") == F.col("__hi"), "max")))
    return ends.select(F.explode(which).alias("which"), "std", feature)


def correlations(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Pearson correlation of every component pair of an array column, as (a, b, r) rows.

    Each task reduces its rows to one matrix of cross products, so the shuffle carries
    partitions x dim^2 numbers instead of row pairs. Values are taken from those of one row, so that
    large values with a small spread keep their digits; the products are computed once.
    """
    first = df.select(vector).where(F.col(vector).isNotNull()).first()
    origin = np.array(first[0], float) if first else np.zeros(dim)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), np.stack(batch[vector].to_numpy()).astype(float) - origin])
            gram += x.T @ x
        a, b = np.indices(gram.shape)
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "s": gram.ravel()})

    cross = cut_lineage(df.select(vector).mapInPandas(partial, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")))
    n = cross.where((F.col("a") == 0) & (F.col("b") == 0)).select("s").scalar()
    moments = cross.where((F.col("b") == 0) & (F.col("a") > 0)).select("a", F.col("s").alias("sum"))
    squares = cross.where((F.col("a") == F.col("b")) & (F.col("a") > 0)).select("a", F.col("s").alias("sq"))
    spread_of = moments.join(squares, "a").select("a", "sum", F.sqrt(n * F.col("sq") - F.col("sum") * F.col("sum")).alias("dev"))
    left = spread_of.select("a", F.col("sum").alias("sum_a"), F.col("dev").alias("dev_a"))
    right = spread_of.select(F.col("a").alias("b"), F.col("sum").alias("sum_b"), F.col("dev").alias("dev_b"))
    pairs = cross.where((F.col("a") > 0) & (F.col("a") < F.col("b"))).join(left, "a").join(right, "b")
    r = (n * F.col("s") - F.col("sum_a") * F.col("sum_b")) / (F.col("dev_a") * F.col("dev_b"))
    return pairs.select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b"), r.alias("r"))
