import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import evaluate as ev
from starloom.operators import inference, roc, stats


@pytest.fixture(scope="module")
def guesses(spark):
    rnd = random.Random(3)
    rows = [(i, t, t if rnd.random() < 0.6 else rnd.randint(1, 4)) for i, t in enumerate(rnd.choices([1, 2, 3, 5], [5, 3, 2, 1], k=400))]
    return rows, spark.createDataFrame(rows, "id int, truth int, guess int")


def brute_report(rows):
    out = {}
    for label in sorted({t for _, t, _ in rows} | {g for *_, g in rows}):
        hit = sum(t == g == label for _, t, g in rows)
        predicted, support = sum(g == label for *_, g in rows), sum(t == label for _, t, _ in rows)
        p, r = (hit / predicted if predicted else 0.0), (hit / support if support else 0.0)
        out[str(label)] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
    return out


def test_report(guesses):
    rows, df = guesses
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in ev.classification_report(df, "truth", "guess").collect()}
    wanted = brute_report(rows)
    for label, values in wanted.items():
        assert got[label] == pytest.approx(values)
    assert got["accuracy"][2] == pytest.approx(sum(t == g for _, t, g in rows) / len(rows))
    assert got["macro avg"][1] == pytest.approx(np.mean([v[1] for v in wanted.values()]))
    assert got["weighted avg"][0] == pytest.approx(sum(v[0] * v[3] for v in wanted.values()) / len(rows))
    assert got["4"][1] == 0.0 and got["4"][3] == 0


def test_confusion(guesses):
    rows, df = guesses
    matrix = json.loads(ev.confusion_json(df, "truth", "guess", 5).first().confusion_matrix)
    assert matrix == [[sum(t == a and g == b for _, t, g in rows) for b in range(1, 6)] for a in range(1, 6)]


def test_score(spark):
    row = spark.createDataFrame([(0.5, 0.1, 0.3, 0.3, 0.8, 0.0)], "a double, b double, c double, d double, e double, z double")
    five = [F.col(c) for c in "abcde"]
    got = row.select(ev.harmonic_mean(five).alias("h"), ev.harmonic_mean([*five, F.col("z")]).alias("z"), ev.arithmetic_mean(five).alias("m")).first()
    assert got.h == pytest.approx(5 / (1 / 0.5 + 1 / 0.1 + 1 / 0.3 + 1 / 0.3 + 1 / 0.8)) and got.z == 0 and got.m == pytest.approx(0.4)


REPORT = ('{"1": {"precision": 0.64, "recall": 0.5, "f1-score": 0.7, "support": 6981}, "2": {"precision": 0.2, "recall": 0.1}, "3": {"recall": 0.3}, '
          '"4": {"recall": 0.3}, "5": {"precision": 0.8}, "accuracy": 0.68}')


def test_stored_reports(spark):
    df = spark.createDataFrame([(7, "LSTM", "1x128", 10, 5, REPORT, None, "h", "old")],
                               "id int, model_name string, architecture string, train_examples int, test_examples int, classification_report string, "
                               "classification_report_train string, history string, network_history string")
    row = ev.enrich_reports(df).first()
    assert row.eval_metric == pytest.approx(5 / (1 / 0.5 + 1 / 0.1 + 1 / 0.3 + 1 / 0.3 + 1 / 0.8))
    assert (row.sample_size, row.display_name, row.network_history, row.eval_metric_train) == (15, "LSTM (1x128)", "h", None)
    flat = {r.name: r.value for r in ev.flatten_reports(df, ["id"], "classification_report", "train_").collect()}
    assert flat["train_1_f1-score"] == 0.7 and flat["train_accuracy"] == 0.68 and len(flat) == 10
    keys = df.select(F.map_keys(ev.remap_classes("classification_report", {"2": "5", "5": "2"}))).first()[0]
    assert keys == ["1", "5", "3", "4", "2", "accuracy"]
    flat2 = ev.flatten_reports(spark.createDataFrame([(1, '{"b": 1, "c": {"1": 2, "2": 3}}')], "id int, j string"), ["id"], "j")
    assert {r.name: r.value for r in flat2.collect()} == {"b": 1.0, "c_1": 2.0, "c_2": 3.0}


def test_matrix_text(spark):
    texts = ["[[ 1  2]\n [ 3 40]]", "[[1, 2], [3, 40]]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [json.loads(r[0]) for r in df.select(ev.repair_matrix_text("t")).collect()] == [[[1, 2], [3, 40]]] * 2


def test_metric_columns():
    names = ["1_precision", "1_recall", "1_f1-score", "macro avg_f1-score", "train_1_recall", "label"]
    assert ev.metric_columns(names) == {"f1": ["1_f1-score"], "precision": ["1_precision"], "recall": ["1_recall"]}
    assert ev.metric_columns(names, True)["recall"] == ["train_1_recall"]


def brute_curve(scores, hits):
    """Curve with collinear points dropped, as plain numpy."""
    order = np.argsort(-scores, kind="stable")
    s, h = scores[order], hits[order]
    ends = np.r_[np.nonzero(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(h)[ends]
    fps = 1 + ends - tps
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True] if len(fps) > 2 else np.ones(len(fps), bool)
    fps, tps = np.r_[0, fps[keep]], np.r_[0, tps[keep]]
    return fps / fps[-1], tps / tps[-1]


def test_roc(spark):
    rng = np.random.default_rng(5)
    n, k = 300, 3
    truth = rng.integers(1, k + 1, n)
    scores = np.round(rng.random((n, k)) + 0.5 * (truth[:, None] == np.arange(1, k + 1)), 2)
    df = spark.createDataFrame([(int(t), *map(float, s)) for t, s in zip(truth, scores)], "truth int, s1 double, s2 double, s3 double")
    got = {r.curve: r.auc for r in roc.roc_auc(df, "truth", [F.col("s1"), F.col("s2"), F.col("s3")]).collect()}
    curves = [brute_curve(scores[:, c], (truth == c + 1).astype(int)) for c in range(k)]
    for c, (fpr, tpr) in enumerate(curves):
        assert got[str(c + 1)] == pytest.approx(np.trapezoid(tpr, fpr))
    fpr, tpr = brute_curve(scores.ravel(), (truth[:, None] == np.arange(1, k + 1)).astype(int).ravel())
    assert got["micro"] == pytest.approx(np.trapezoid(tpr, fpr))
    grid = np.unique(np.concatenate([f for f, _ in curves]))
    mean = np.mean([np.interp(grid, f, t) for f, t in curves], axis=0)
    assert got["macro"] == pytest.approx(np.trapezoid(mean, grid))


def test_bootstrap_and_permutation(guesses, spark):
    rows, df = guesses
    interval = {(r.label, r.metric): r for r in inference.bootstrap_interval(df, "truth", "guess", 5, replicates=300).collect()}
    recall = brute_report(rows)["1"][1]
    r = interval[(1, "recall")]
    assert r.low < recall < r.high and abs(r.mean - recall) < 0.02
    again = {(r.label, r.metric): r.mean for r in inference.bootstrap_interval(df, "truth", "guess", 5, replicates=300).collect()}
    assert again == pytest.approx({k: v.mean for k, v in interval.items()})
    both = df.withColumn("perfect", F.col("truth"))
    assert inference.permutation_test(both, "truth", "perfect", "guess", 1, 5, replicates=200).first().p_value < 0.05
    assert inference.permutation_test(both, "truth", "guess", "guess", 1, 5, replicates=200).first().p_value > 0.2


def test_p_values():
    # Student's t: two-sided 5 % points
    for df, t in ((1, 12.706204736), (10, 2.228138852), (100, 1.983971519)):
        assert inference.student_p_value(t, df) == pytest.approx(0.05, abs=1e-8)
    assert inference.student_p_value(0.0, 5) == 1.0


def test_bins_and_quantiles(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 10, None)], "v int")
    bins = [r[0] for r in df.select(stats.cut("v", [1, 2, 3])).collect()]
    assert bins == [None, "(1, 2]", "(1, 2]", "(2, 3]", None, None]
    q = {r.probability: r.quantile for r in stats.exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert q == {0.0: 1.0, 0.5: 2.0, 0.9: pytest.approx(np.quantile([1, 2, 2, 3, 10], 0.9)), 1.0: 10.0}
    d = stats.describe(df, "v").first()
    assert (d["count"], d["mean"], d["std"], d["max"]) == (5, pytest.approx(3.6), pytest.approx(np.std([1, 2, 2, 3, 10], ddof=1)), 10.0)
    assert df.select(stats.fixed_width_bin("v", 2.0)).collect()[3][0] == 2


def test_contributions(spark):
    features = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0), (2, "b", 1.0)], "id int, feature string, value double")
    coefficients = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -1.0), ("b", 1, 3.0), ("b", 2, 0.0)], "feature string, label int, coefficient double")
    parts = ev.contributions(features, coefficients, "id")
    totals = ev.contribution_totals(parts, spark.createDataFrame([(1, 10.0), (2, 0.0)], "label int, intercept double"), "id")
    assert {(r.id, r.label): r.final_value for r in totals.collect()} == {(1, 1): 11.0, (1, 2): -2.0, (2, 1): 13.0, (2, 2): 0.0}
