import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import neighbors, sampling


@pytest.fixture(scope="module")
def points(spark):
    """Clustered points; one dense cluster holds more than a third of them."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 6)) * 4
    which = np.r_[np.zeros(120, int), rng.integers(1, 5, 180)]
    x = centers[which] + rng.normal(size=(300, 6)) * np.where(which == 0, 0.3, 1.0)[:, None]
    x[7] = x[3]
    labels = np.where(which == 0, 1, np.where(which == 1, 2, 3))
    df = spark.createDataFrame([(i, int(c), list(map(float, v))) for i, (c, v) in enumerate(zip(labels, x))], "id int, label int, vec array<double>")
    return x, labels, df.repartition(3).cache()


def pairwise(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("block", [8192, 16])
def test_nearest_is_exact(points, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", block)
    x, labels, df = points
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    got = neighbors.nearest(df, df, "id", "vec", 4, label="label", exclude_self=True, pivots=12).collect()
    assert len(got) == 300 * 4
    for r in got:
        assert r.distance == pytest.approx(np.sort(d[r.id])[r.rank - 1]) and r.distance == pytest.approx(d[r.id, r.neighbor])
        assert r.label == labels[r.neighbor]


def test_nearest_within_group(points):
    x, labels, df = points
    d = pairwise(x)
    d[labels[:, None] != labels[None, :]] = np.inf
    np.fill_diagonal(d, np.inf)
    for r in neighbors.nearest(df, df, "id", "vec", 3, group="label", exclude_self=True, pivots=9).collect():
        assert r.distance == pytest.approx(np.sort(d[r.id])[r.rank - 1])


def test_pruning_skips_cells(points):
    _, _, df = points
    base = neighbors._prepare(df, "id", "vec", None, "label")
    assigned, cells = neighbors._build(base, 4, False, 12)
    assert neighbors._route(base, cells, 4, "near", 0.0).count() < 300 * 12 / 2


def test_farthest_and_radius(points):
    x, labels, df = points
    d = pairwise(x)
    for r in neighbors.farthest(df, df, "id", "vec", 3, pivots=10).collect():
        assert r.distance == pytest.approx(np.sort(d[r.id])[::-1][r.rank - 1])
    votes = {(r.id, r.label): r.n for r in neighbors.radius_votes(df, df, "id", "vec", 1.5, "label", pivots=10).collect()}
    wanted = {(i, int(c)): int(((d[i] <= 1.5) & (labels == c)).sum()) for i in range(300) for c in (1, 2, 3)}
    assert votes == {k: v for k, v in wanted.items() if v}


def test_vectors_without_clusters_are_copied_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 100)
    x = np.random.default_rng(4).normal(size=(300, 16)).astype(np.float32)
    x[40:60] = x[3] + np.float32(1e-6) * x[40:60]  # closer than single-precision products tell apart
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id int, label int, vec array<float>").repartition(3).cache()
    base = neighbors._prepare(df, "id", "vec", None, "label")
    _, cells = neighbors._build(base, 4, False, 64)
    blocks = len(cells.packed()[1])
    assert blocks <= 6 and neighbors._route(base, cells, 1, "radius", 100.0).count() == 300 * blocks  # every cell is asked
    d = pairwise(x.astype(np.float64))
    order = np.lexsort((np.broadcast_to(np.arange(300), d.shape), np.where(np.eye(300, dtype=bool), np.inf, d)))[:, :4]
    found = neighbors.nearest(df, df, "id", "vec", 4, exclude_self=True).collect()
    assert {(r.id, r["rank"]): r.neighbor for r in found} == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(order[i])}
    radius = float(np.sort(d[0])[20])  # a distance that occurs
    votes = {(r.id, r.label): r.n for r in neighbors.radius_votes(df, df, "id", "vec", radius, "label", exclude_self=True).collect()}
    wanted = {(i, c): int(((d[i] <= radius) & (np.arange(300) % 3 == c) & (np.arange(300) != i)).sum()) for i in range(300) for c in range(3)}
    assert votes == {k: v for k, v in wanted.items() if v}


def test_sparse_rows_stay_small(spark):
    x = np.random.default_rng(6).normal(size=(60, 40)) * (np.random.default_rng(7).random((60, 40)) < 0.1)
    x[7] = np.arange(40) / 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    assigned, _ = neighbors._build(neighbors._prepare(df, "id", "vec", None, None), 1, False, 4)
    sizes = {r.id: len(r.v) for r in assigned.collect()}
    assert sizes[7] == 4 + 8 * 39 + 8 and all(sizes[i] == 4 + 12 * np.count_nonzero(x[i]) for i in range(60) if i != 7)
    d = pairwise(x)
    for r in neighbors.farthest(df, df, "id", "vec", 2).collect():
        assert r.distance == pytest.approx(np.sort(d[r.id])[::-1][r.rank - 1])


def test_neighbors_of_repeated_keys(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) for _ in range(3)], "id int, vec array<double>")
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    found = neighbors.nearest(df.dropDuplicates(["id"]), df, "id", "vec", 4, exclude_self=True).groupBy("id").agg({"neighbor": "collect_list"}).collect()
    assert all(sorted(r[1]) == sorted([*[int(d[r.id].argmin())] * 3, int(d[r.id].argsort()[1])]) for r in found) and len(found) == 40


def test_balance(points):
    _, labels, df = points
    sizes = {c: int((labels == c).sum()) for c in (1, 2, 3)}
    top, low = max(sizes.values()), min(sizes.values())
    over = sampling.over_sample(df, "id", "label")
    assert {r.label: r["count"] for r in sampling.class_sizes(over, "label").collect()} == dict.fromkeys(sizes, top)
    assert over.select("id").distinct().count() == 300
    under = sampling.under_sample(df, "id", "label")
    assert {r.label: r["count"] for r in sampling.class_sizes(under, "label").collect()} == dict.fromkeys(sizes, low)
    weights = {r.label: r.weight for r in sampling.with_class_weights(df, "label").select("label", "weight").distinct().collect()}
    assert weights == pytest.approx({c: 300 / (3 * n) for c, n in sizes.items()})


def test_smote_lies_between_parents(points):
    x, labels, df = points
    sizes = {c: int((labels == c).sum()) for c in (1, 2, 3)}
    made = sampling.smote(df, "id", "label", "vec").collect()
    for c, n in sizes.items():
        assert sum(r.label == c for r in made) == max(sizes.values()) - n
    for r in made:
        assert labels[r.id] == labels[r.neighbor] == r.label
        low, high = np.minimum(x[r.id], x[r.neighbor]), np.maximum(x[r.id], x[r.neighbor])
        assert np.all(np.array(r.vec) >= low - 1e-9) and np.all(np.array(r.vec) <= high + 1e-9)
    again = sampling.smote(df.repartition(7), "id", "label", "vec").collect()
    key = lambda r: (r.id, r.copy)
    assert [(key(r), r.vec) for r in sorted(made, key=key)] == [(key(r), r.vec) for r in sorted(again, key=key)]


def test_near_miss(points):
    x, labels, df = points
    d = pairwise(x)
    small = min((1, 2, 3), key=lambda c: ((labels == c).sum(), c))
    n = int((labels == small).sum())
    mean = np.sort(d[:, labels == small], axis=1)[:, -3:].mean(1)
    wanted = {int(i) for c in (1, 2, 3) for i in (np.nonzero(labels == c)[0] if c == small else sorted(np.nonzero(labels == c)[0], key=lambda i: (round(mean[i], 9), i))[:n])}
    assert {r.id for r in sampling.near_miss(df, "id", "label", "vec").collect()} == wanted


def test_splits(points):
    _, labels, df = points
    train, test = sampling.stratified_split(df, "id", "label", drop="vec")
    assert train.columns == ["id", "label"] and train.count() + test.count() == 300
    assert {r.label: r["count"] for r in sampling.class_sizes(test, "label").collect()} == {c: int(np.ceil((labels == c).sum() / 4)) for c in (1, 2, 3)}
    left, right = sampling.train_test_split(df, "id")
    assert left.join(right, "id").count() == 0 and left.count() + right.count() == 300
    assert 180 < left.count() < 270
    assert sampling.exact_sample(df, "id", 37).count() == 37
    assert sorted(r.id for r in sampling.systematic_sample(df, ["id"], 100).collect()) == [99, 199, 299]
    assert sampling.systematic_sample(df, ["id"], 0).count() == 300
    counts = sampling.sample_per_class(df, "id", "label", 5).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert {r.n for r in counts} == {5}


def test_a_share_of_the_rows_keeps_recall_on_a_larger_table(spark):
    from starloom.catalog.sampling_queries import approximate_neighbors
    assert [tuple(r) for r in approximate_neighbors(spark, "/root/testdata/sf0.1").collect()] == [(2000, 5, True)]
