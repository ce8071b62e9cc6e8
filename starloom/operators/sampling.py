"""Sampling, splitting and re-balancing with choices that a re-run task repeats exactly."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.hashing import key_fraction, key_hash
from starloom.operators.neighbor_graph import graph_nearest
from starloom.operators.neighbors import farthest, nearest
from starloom.plans.ranking import first_rows, number_rows, rank_within
from starloom.plans.session import cut_lineage
from starloom.plans.sizing import lookup_join
from starloom.sources.tables import sample_rule


def systematic_sample(df: DataFrame, order: Sequence[Column | str], rate: int) -> DataFrame:
    """Every ``rate``-th row along ``order`` (row 0 is the header); rate 0 keeps all."""
    if rate == 0:
        return df
    return number_rows(df, order, "__index").where(sample_rule(F.col("__index"), rate)).drop("__index")


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """Repeatable Bernoulli sample by key: a filter, no shuffle."""
    return df.where(key_fraction(key, seed) < fraction)


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Repeatable sample of exactly ``n`` rows."""
    return first_rows(df, [key_hash(key, seed), F.col(key)], n)


def train_test_split(df: DataFrame, key: str, train: float = 0.75, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Repeatable random split by key: two filters, no shuffle."""
    chosen = key_fraction(key, seed) < train
    return df.where(chosen), df.where(~chosen)


def stratified_split(df: DataFrame, key: str, label: str, drop: str | None = None, test: float = 0.25, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Split that keeps class shares: the first ``ceil(test * size)`` hash-ordered rows of each class are test rows.

    ``drop`` is a comma-separated list of columns to leave out.
    """
    if drop:
        df = df.drop(*drop.replace(" ", "").split(","))
    ranked = rank_within(df, label, [key_hash(key, seed), F.col(key)], "__r", "__n")
    is_test = F.col("__r") <= F.ceil(F.col("__n") * F.lit(test))
    return ranked.where(~is_test).drop("__r", "__n"), ranked.where(is_test).drop("__r", "__n")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Class histogram: label, count."""
    return df.groupBy(label).agg(F.count("*").alias("count"))


def class_histograms(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class histogram before and after re-balancing."""
    return class_sizes(before, label).withColumn("stage", F.lit("before")).unionByName(
        class_sizes(after, label).withColumn("stage", F.lit("after")))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach balanced class weights n / (classes * class size).

    The class table (one row per class) carries the totals; measured small, it is broadcast, so
    the rows themselves are not shuffled and a dominant class cannot pile up in one task.
    """
    sizes = class_sizes(df, label)
    totals = sizes.agg(F.struct(F.sum("count").alias("n"), F.count("*").alias("k"))).scalar()
    weights = sizes.withColumn("__t", totals).select(label, (F.col("__t.n") / (F.col("__t.k") * F.col("count"))).alias(name))
    return lookup_join(df, weights, [label])


def over_sample(df: DataFrame, key: str, label: str, seed: int = 1) -> DataFrame:
    """Repeat rows until every class is as large as the largest.

    Each row is kept floor(largest / size) times; the remainder goes to the first rows in
    hash order. ``copy`` numbers the repetitions.
    """
    ranked = rank_within(df, label, [key_hash(key, seed), F.col(key)], "__r", "__n")
    largest = class_sizes(df, label).agg(F.max("count")).scalar()
    ranked = ranked.withColumn("__max", largest)
    times = F.floor(F.col("__max") / F.col("__n")) + (F.col("__r") <= F.col("__max") % F.col("__n")).cast("long")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("__r", "__n", "__max")


def under_sample(df: DataFrame, key: str, label: str, seed: int = 1) -> DataFrame:
    """Draw, with replacement, as many rows from every class as the smallest class has.

    The rows of the smallest class themselves serve as the distributed list of draws.
    """
    ranked = rank_within(df, label, [key_hash(key, seed), F.col(key)], "__r", "__n")
    sizes = class_sizes(df, label)
    smallest = sizes.agg(F.min_by(label, F.struct("count", F.col(label)))).scalar()
    classes = sizes.agg(F.collect_list(F.struct(label, "count"))).scalar()  # one entry per class
    draws = ranked.where(F.col(label) == smallest).select(F.col("__r").alias("draw"), classes.alias("__c")).select(
        "draw", F.inline("__c"))
    wanted = draws.select("draw", label, (F.pmod(F.xxhash64("draw", label, F.lit(seed)), F.col("count")) + 1).alias("__r"))
    return ranked.drop("__n").join(wanted, [label, "__r"]).drop("__r")


def _generated(df: DataFrame, key: str, label: str, quota: DataFrame, seed: int) -> DataFrame:
    """Spread each class's quota of synthetic rows evenly over its hash-ordered rows."""
    ranked = lookup_join(rank_within(df, label, [key_hash(key, seed), F.col(key)], "__r", "__n"), quota, [label])
    times = F.floor(F.col("__quota") / F.col("__n")) + (F.col("__r") <= F.col("__quota") % F.col("__n")).cast("long")
    return ranked.select(F.col(key).alias("id"), label, times.alias("__times")).where(F.col("__times") > 0)


def _array(df: DataFrame, vec: str) -> Column:
    return vector_to_array(vec) if isinstance(df.schema[vec].dataType, VectorUDT) else F.col(vec).cast("array<double>")


def _interpolate(df: DataFrame, key: str, label: str, vec: str, requests: DataFrame, k: int, seed: int,
                 probes: int | None, graph: bool) -> DataFrame:
    """Synthetic rows between a base row and one of its k nearest rows of the same class."""
    minority = lookup_join(df, requests.select(label).distinct(), [label], "left_semi")
    asked = df.join(requests.select(F.col("id").alias(key)), key, "left_semi")
    if graph:
        near = cut_lineage(graph_nearest(minority, key, vec, k, group=label).join(requests.select("id"), "id", "left_semi").select("id", "neighbor", "rank"))
    else:
        near = nearest(asked, minority, key, vec, k, group=label, exclude_self=True, probes=probes).select("id", "neighbor", "rank")
    counts = near.groupBy("id").agg(F.count("*").alias("__k"))
    copies = requests.join(counts, "id").select("id", label, "__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("copy"))
    picked = copies.withColumn("rank", F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.col("__k")) + 1).join(near, ["id", "rank"])
    gap = (F.pmod(F.xxhash64("id", "copy", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0))
    vectors = df.select(F.col(key).alias("__key"), F.col(vec).alias("__v"))
    out = (picked.withColumn("__gap", gap)
           .join(vectors.select(F.col("__key").alias("id"), F.col("__v").alias("__a")), "id")
           .join(vectors.select(F.col("__key").alias("neighbor"), F.col("__v").alias("__b")), "neighbor"))
    return out.select("id", "neighbor", "copy", label, F.zip_with(_array(out, "__a"), _array(out, "__b"), lambda a, b: a + F.col("__gap") * (b - a)).alias(vec))


def smote(df: DataFrame, key: str, label: str, vec: str, k: int = 5, factors: Mapping[int, float] | None = None, seed: int = 1,
          probes: int | None = None, graph: bool = False) -> DataFrame:
    """Synthetic rows (SMOTE, Chawla et al. 2002) bringing every class to the majority size.

    ``factors`` gives explicit targets per class as a multiple of its size instead. ``probes``
    takes the approximate neighbour search in cells, ``graph`` the one by neighbour descent, which
    also takes ML vectors and keeps sparse ones sparse.
    """
    sizes = class_sizes(df, label)
    if factors is None:
        target = sizes.agg(F.max("count")).scalar()
    else:
        table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
        target = F.round(F.col("count") * F.coalesce(F.try_element_at(table, F.col(label)), F.lit(1.0))).cast("long")
    quota = sizes.withColumn("__quota", target - F.col("count")).where(F.col("__quota") > 0).select(label, "__quota")
    requests = cut_lineage(_generated(df, key, label, quota, seed))
    return _interpolate(df, key, label, vec, requests, k, seed, probes, graph)


def adasyn(df: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = 1, probes: int | None = None, graph: bool = False) -> DataFrame:
    """Synthetic rows (ADASYN, He et al. 2008): more of them where other classes are near.

    A row's allocation is its share of other-class rows among its k nearest neighbours,
    normalised within its class, times the rows the class lacks.
    """
    sizes = class_sizes(df, label)
    largest = sizes.agg(F.max("count")).scalar()
    quota = sizes.withColumn("__quota", largest - F.col("count")).where(F.col("__quota") > 0).select(label, "__quota")
    minority = lookup_join(df, quota, [label]).select(key, label, vec)
    found = graph_nearest(df, key, vec, k, label=label) if graph else nearest(minority, df, key, vec, k, label=label, exclude_self=True, probes=probes)
    near = found.select("id", F.col("label").alias("__other"))
    labelled = near.join(minority.select(F.col(key).alias("id"), label), "id")
    ratios = cut_lineage(labelled.groupBy("id", label).agg(F.avg((F.col("__other") != F.col(label)).cast("double")).alias("__ratio")))
    total = ratios.groupBy(label).agg(F.sum("__ratio").alias("__all"))
    times = F.rint(F.col("__ratio") / F.col("__all") * F.col("__quota")).cast("long")
    shares = lookup_join(ratios, total.join(quota, label), [label])
    requests = shares.select("id", label, times.alias("__times")).where(F.col("__times") > 0)
    return _interpolate(df, key, label, vec, cut_lineage(requests), k, seed, probes, graph)


def near_miss(df: DataFrame, key: str, label: str, vec: str, farthest_rows: int = 3) -> DataFrame:
    """NearMiss-2: keep the minority class and, from every other class, as many rows as the
    minority has, those with the smallest mean distance to their farthest minority rows."""
    sizes = class_sizes(df, label)
    smallest = sizes.agg(F.min_by(F.struct(F.col(label).alias("label"), F.col("count").alias("n")), F.struct("count", F.col(label)))).scalar()
    tagged = df.withColumn("__small", smallest)
    minority = tagged.where(F.col(label) == F.col("__small.label")).drop("__small")
    rest = tagged.where(F.col(label) != F.col("__small.label"))
    means = farthest(rest.drop("__small"), minority, key, vec, farthest_rows).groupBy("id").agg(F.avg("distance").alias("__mean"))
    scored = rest.select(key, label, F.col("__small.n").alias("__keep")).join(means.withColumnRenamed("id", key), key)
    kept = rank_within(scored, label, ["__mean", key], "__r").where(F.col("__r") <= F.col("__keep")).select(key, label, F.col("__mean").alias("mean_distance"))
    return kept.unionByName(minority.select(key, label, F.lit(None).cast("double").alias("mean_distance")))


def sample_per_class(df: DataFrame, key: str, label: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` repeatable random rows per class (small samples for reading)."""
    from starloom.operators.stats import top_per_group

    return top_per_group(df, [label], [key_hash(key, seed), F.col(key)], n)


# -- re-balanced training parts ----------------------------------------------------------------

#: Names of the methods in configuration files.
SAMPLERS = ("smote", "adasyn", "random_over_sampling", "random_under_sampling", "nearmiss2")


def rebalance(df: DataFrame, key: str, label: str, features: str, method: str | Callable[[DataFrame], DataFrame], seed: int = 1) -> DataFrame:
    """Training part (key, label, feature vector) re-balanced by a named method or a function of the caller's.

    Repeated and synthetic rows get keys of their own: hashes of their origin. Neighbours come from the
    neighbour graph, so sparse features are made dense only for the rows that are interpolated.
    """
    rows = df.select(key, label, features)
    if callable(method):
        return method(rows)
    if method not in SAMPLERS:
        raise ValueError(f"no sampling method is called {method}")
    if method in ("random_over_sampling", "random_under_sampling"):
        made = over_sample(rows, key, label, seed) if method == "random_over_sampling" else under_sample(rows, key, label, seed).withColumnRenamed("draw", "copy")
        return made.select(_derived_key(rows, key, F.col(key), F.col("copy")), label, features)
    if method == "nearmiss2":
        arrays = rows.withColumn(features, vector_to_array(features))
        return rows.join(near_miss(arrays, key, label, features).select(key), key, "left_semi")
    made = (smote if method == "smote" else adasyn)(rows, key, label, features, seed=seed, graph=True)
    new = made.select(_derived_key(rows, key, F.col("id"), F.col("neighbor"), F.col("copy")), label, array_to_vector(features).alias(features))
    return rows.unionByName(new)


def _derived_key(df: DataFrame, key: str, *origin: Column) -> Column:
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return F.xxhash64(*origin).alias(key)
    return F.concat_ws("#", *[c.cast("string") for c in origin]).alias(key)
