import numpy as np
from pyspark.sql import functions as F

from starloom.operators import roc
from starloom.operators.curve_intervals import auc_intervals, poisson_copies


def _rank_area(hit, score):
    """Area as the share of (hit, miss) pairs in the right order, ties as halves."""
    pos, neg = score[hit], np.sort(score[~hit])
    return (np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg))


def _table(spark, rows=1500):
    rng = np.random.default_rng(4)
    truth = rng.choice([1, 2, 3], rows, p=[0.6, 0.3, 0.1])
    scores = rng.normal(size=(rows, 3)) + (truth[:, None] == np.arange(1, 4)) * 0.8
    df = spark.createDataFrame([(i, int(t), *map(float, s)) for i, (t, s) in enumerate(zip(truth, scores))], "id long, truth int, s1 double, s2 double, s3 double")
    return df, truth, scores


def test_copies_are_poisson_and_repeatable():
    keys = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 4000)
    copies = poisson_copies(keys, np.arange(60))
    assert (copies[:, 0] == 1).all() and np.array_equal(copies[5:9, 7:], poisson_copies(keys[5:9], np.arange(7, 60)))
    drawn = copies[:, 1:]
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.06


def test_intervals_hold_the_area_and_are_as_wide_as_a_plain_bootstrap(spark):
    df, truth, scores = _table(spark)
    columns = [F.col(f"s{c}") for c in (1, 2, 3)]
    found = {r.curve: r for r in auc_intervals(df, "id", "truth", columns, replicates=1500).collect()}
    exact = {r.curve: r.auc for r in roc.roc_auc(df, "truth", columns).collect()}
    rng = np.random.default_rng(9)
    draws = [rng.integers(0, len(truth), len(truth)) for _ in range(1500)]
    hits = truth[:, None] == np.arange(1, 4)
    assert set(found) == {"1", "2", "3", "micro"}
    for curve, r in found.items():
        pick = (lambda d: (hits[d].ravel(), scores[d].ravel())) if curve == "micro" else (lambda d, c=int(curve) - 1: (hits[d, c], scores[d, c]))
        low, high = np.quantile([_rank_area(*pick(d)) for d in draws], [0.025, 0.975])
        assert abs(r.auc - exact[curve]) < 1e-12 and r.low < r.auc < r.high and r.replicates == 1500
        assert abs((r.high - r.low) / (high - low) - 1) < 0.1, (curve, r, low, high)


def test_partitions_do_not_matter(spark):
    df, _, _ = _table(spark, 300)
    columns = [F.col(f"s{c}") for c in (1, 2, 3)]
    a, b = (sorted(tuple(r) for r in auc_intervals(d, "id", "truth", columns, replicates=30).collect()) for d in (df.coalesce(1), df.repartition(5)))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b], atol=1e-12)


def test_nulls_ties_one_class_and_empty_tables(spark):
    rows = [(1, 1, 0.5, None), (2, 2, 0.5, 0.1), (3, None, 0.9, 0.9), (4, 1, float("nan"), 0.2), (5, 1, 0.5, 0.7)]
    df = spark.createDataFrame(rows, "id int, truth int, a double, key double")
    out = {r.curve: r for r in auc_intervals(df, "id", "truth", [F.col("a"), F.col("key")], replicates=20).collect()}
    assert out["1"].auc == 0.5 and out["1"].low == out["1"].high == 0.5 and out["2"].auc == 0.0
    assert auc_intervals(df.limit(0), "id", "truth", [F.col("a")], replicates=5).count() == 0
    assert auc_intervals(df.where("truth = 1"), "id", "truth", [F.col("a")], replicates=5).count() == 0
