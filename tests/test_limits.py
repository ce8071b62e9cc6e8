"""Nothing is cut at a fixed size, and large values keep their digits."""

import math

import pytest
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.functions.hashing import key_fraction
from starloom.operators import evaluate, joins, sampling, stats, training
from starloom.sources import tables


def test_boosted_trees_get_the_asked_depth(spark):
    assert training.make_classifier("GB", max_depth=10).getClassifier().getMaxDepth() == 10


def test_long_expansions_and_references(spark):
    long = "a" + "b" * 100
    df = spark.createDataFrame([("a'b &#00000038; &#x000026; &amp &copy; &copy &unknownname; &#99999999999;",)], "t string")
    row = df.select(tx.expand_contractions(F.lit("see a'b"), {"a'b": long}).alias("e"), tx.decode_entities("t").alias("d")).first()
    assert row.e == f"see {long}" and row.d == "a'b & & & © © &unknownname; &#99999999999;"


def test_embedding_rows_keep_all_components(spark, tmp_path):
    (tmp_path / "v.txt").write_text("w " + " ".join(["1"] * 3000) + "\nlonely\n")
    assert {r.word: len(r.vec) for r in tables.read_embeddings(spark, str(tmp_path)).collect()} == {"w": 3000, "lonely": 0}


def test_spread_of_large_values(spark):
    df = spark.createDataFrame([(g, 3_000_000_000 + v) for g in ("a", None) for v in (0, 1, 2)], "g string, v long")
    assert stats.describe(df, "v").first()["std"] == pytest.approx(1 if df.count() == 3 else math.sqrt(0.8))
    assert [r["std"] for r in stats.describe(df, "v", ["g"]).collect()] == [1.0, 1.0]
    cells = spark.createDataFrame([("f", 3e9), ("f", 3e9 + 1), ("f", 3e9 + 2)], "f string, v double")
    assert stats.sparse_feature_std(cells, "f", "v", F.lit(3)).first()["std"] == pytest.approx(1.0)
    vectors = spark.createDataFrame([([3e9 + x, 3e9 + y],) for x, y in ((0, 0), (1, 2), (2, 4), (3, 7))], "v array<double>")
    assert stats.correlations(vectors, "v", 2).first()["r"] == pytest.approx(0.99439, abs=1e-4)


def test_extreme_features_with_one_spread(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "f string, std double")
    assert sorted(map(tuple, stats.extreme_features(rows, "f").collect())) == [("max", 2.0, "c"), ("min", 1.0, "a"), ("min", 1.0, "b")]


def test_many_rows_per_group(spark):
    df = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as g")
    top = stats.top_per_group(df, ["g"], [F.col("id")], 1500)
    assert {r.g: (r.n, r.last) for r in top.groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()} == {"a": (1500, 1500), "b": (1500, 1500)}


def test_rows_without_weighted_features_score_the_intercepts(spark):
    cells = spark.createDataFrame([(1, "x", 2.0), (2, "unknown", 1.0)], "id long, feature string, value double")
    weights = spark.createDataFrame([("x", 1, 3.0), ("x", 2, -1.0)], "feature string, label int, coefficient double")
    base = spark.createDataFrame([(1, 10.0), (2, 20.0)], "label int, intercept double")
    totals = evaluate.contribution_totals(evaluate.contributions(cells, weights, "id"), base, "id", cells)
    assert {(r.id, r.label): r.final_value for r in totals.collect()} == {(1, 1): 16.0, (1, 2): 18.0, (2, 1): 10.0, (2, 2): 20.0}


def test_keys_of_any_type_and_size_split(spark):
    names = spark.range(2000).selectExpr("concat('R', id) as k", "id * 2147483648 as far")
    shares = names.select(key_fraction("k").alias("a"), key_fraction("far").alias("b")).agg(F.avg("a"), F.avg("b"), F.count_distinct("b")).first()
    assert abs(shares[0] - 0.5) < 0.05 and abs(shares[1] - 0.5) < 0.05 and shares[2] > 1990
    assert 0 < sampling.hash_sample(names, "k", 0.3).count() < 1000


def test_long_series_align_like_arrays(spark):
    left = spark.createDataFrame([("r", 3), ("r", 1), ("q", 5)], "run string, loss int")
    right = spark.createDataFrame([("r", 9)], "run string, acc int")
    got = {(r.run, r.epoch): (r.loss, r.acc) for r in joins.align_long_series([(left, "loss"), (right, "acc")], "run").collect()}
    assert got == {("r", 1): (1, 9), ("r", 2): (3, None), ("q", 1): (5, None)}
