"""The neighbour graph against exact neighbours."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators import neighbor_graph as ng
from starloom.operators import sampling
from starloom.operators.neighbors import knn_classify


def exact(x, base, k, groups=None):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    d[:, ~base] = np.inf
    if groups is not None:
        d[groups[:, None] != groups[None, :]] = np.inf
    return [set(np.argsort(r, kind="stable")[:k]) for r in d]


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.neighbor)
    return np.mean([len(got.get(a, set()) & w) / len(w) for a, w in want.items()])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    return rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))


def test_recall_on_clustered_vectors_and_pairs_in_proportion_to_rows(spark, clustered, monkeypatch):
    monkeypatch.setattr(ng, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ng, "_REVERSE", 8)
    met = {}
    for n in (375, 750, 1500):
        df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(clustered[:n])], "k long, v array<double>")
        out = ng.graph_nearest(df, "k", "v", 5, degree=16).collect()
        want = dict(enumerate(exact(clustered[:n], np.ones(n, bool), 5)))
        assert recall(out, want) >= 0.95 and len(out) == 5 * n and all(r.id != r.neighbor for r in out)
        for r in out[:200]:
            assert r.distance == pytest.approx(np.linalg.norm(clustered[r.id] - clustered[r.neighbor]), abs=1e-6)
        nodes = df.select(F.col("k").alias("node"), F.lit(0).alias("g"), F.lit(True).alias("base"), F.size("v").alias("width"), F.lit(None).cast("array<int>").alias("ix"), F.col("v").alias("x"))
        blocks = ng._blocks(ng.stage_table(nodes, "n"), n, 16, 1).groupBy("block").count().select(F.sum(F.col("count") * F.col("count") / 2)).first()[0]
        met[n] = blocks + ng.ROUNDS * n * (16 + 2 * 8) ** 2 / 2  # the most that its rounds can meet
    assert np.log(met[1500] / met[375]) / np.log(4) < 1.3


def test_sparse_vectors_queries_groups_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    kind = T.StructType([T.StructField("k", T.StringType()), T.StructField("g", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("v", VectorUDT())])
    dense = np.zeros((400, 3000))
    for r in dense:
        r[rng.choice(60, 6, replace=False) * 50] = rng.random(6)
    dense[7] = dense[8]
    rows = [(f"r{i}", int(i % 2), int(i % 3), Vectors.sparse(3000, {int(j): float(r[j]) for j in np.flatnonzero(r)}) if i % 5 else Vectors.dense(r)) for i, r in enumerate(dense)]
    df = spark.createDataFrame([*rows, (None, 1, 1, SparseVector(3000, [1], [1.0])), ("null", 1, 1, None)], kind)
    groups = np.arange(400) % 2
    out = ng.graph_nearest(df, "k", "v", 4, group="g", label="c", degree=24).collect()
    index = {f"r{i}": i for i in range(400)}
    found = {}
    for r in out:
        found.setdefault(index[r.id], set()).add(index[r.neighbor])
        assert index[r.id] % 2 == index[r.neighbor] % 2 and r.label == index[r.neighbor] % 3
    want = exact(dense, np.ones(400, bool), 4, groups)
    assert np.mean([len(found[i] & want[i]) / 4 for i in range(400)]) >= 0.95
    base, asked = df.where("c < 2 and k is not null"), df.where("c = 2")
    pairs = ng.graph_nearest(base, "k", "v", 4, queries=asked, degree=24).collect()
    assert {r.id for r in pairs} == {f"r{i}" for i in range(400) if i % 3 == 2} and not any(index[r.neighbor] % 3 == 2 for r in pairs)
    want = exact(dense, np.arange(400) % 3 < 2, 4)
    found = {}
    for r in pairs:
        found.setdefault(index[r.id], set()).add(index[r.neighbor])
    assert np.mean([len(found[i] & want[i]) / 4 for i in found]) >= 0.9
    assert ng.graph_nearest(df.limit(0), "k", "v", 3).count() == 0 and ng.graph_nearest(df.where("k = 'r1'"), "k", "v", 3).count() == 0


def test_classes_and_synthetic_rows_by_the_graph(spark, clustered):
    labels = (clustered[:600, 0] > 0).astype(int) + 2 * (clustered[:600, 1] > 1)
    df = spark.createDataFrame([(k, int(c), r.tolist()) for k, (c, r) in enumerate(zip(labels, clustered))], "k long, c int, v array<double>")
    both = [{r.id: r.prediction for r in knn_classify(df, df, "k", "v", "c", exclude_self=True, graph=g).collect()} for g in (False, True)]
    assert both[0].keys() == both[1].keys() and np.mean([both[0][k] == both[1][k] for k in both[0]]) >= 0.97
    made = sampling.smote(df, "k", "c", "v", graph=True).collect()
    sizes = np.bincount(labels)
    assert len(made) == (sizes[sizes > 0].max() - sizes[sizes > 0]).sum()
    for r in made[:100]:
        a, b, v = clustered[r.id], clustered[r.neighbor], np.array(r.v)
        assert labels[r.id] == labels[r.neighbor] == r.c and np.allclose(np.linalg.norm(v - a) + np.linalg.norm(b - v), np.linalg.norm(b - a))
    vectors = df.withColumn("v", array_to_vector("v"))
    for method in ("smote", "adasyn"):
        sizes = {r.c: r.n for r in sampling.rebalance(vectors, "k", "c", "v", method).groupBy("c").agg(F.count("*").alias("n")).collect()}
        assert min(sizes.values()) >= 0.8 * max(sizes.values())
