import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from starloom.operators import sampling
from starloom.operators import training as tr
from starloom.plans.sweeps import feature_sweep
from starloom.streaming import scoring


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    y = rng.choice([1, 2, 3], 240, p=[0.6, 0.3, 0.1])
    x = np.eye(3)[y - 1] * 4 + rng.normal(size=(240, 3))
    df = spark.createDataFrame([(i, int(c), list(map(float, v))) for i, (c, v) in enumerate(zip(y, x))], "id int, y int, v array<double>")
    df = df.select("id", "y", array_to_vector("v").alias("features"))
    train, test = sampling.train_test_split(df, "id")
    return tr.training_frame(train, "y").cache(), test.cache()


@pytest.mark.parametrize("name,options", [("LRB", {"max_iter": 20}), ("DTB", {"max_depth": 4}), ("RF", {"max_depth": 4}), ("GB", {"max_iter": 3}),
                                          ("SVC_RBF", {"max_iter": 10, "rff_size": 64, "gamma": 0.1}), ("DNN", {"max_iter": 40, "layers": [3, 8, 3]})])
def test_classifiers_beat_the_majority(blobs, name, options):
    train, test = blobs
    model = tr.make_classifier(name, rows=train.count(), classes=3, **options).fit(train)
    rows = tr.predict(model, test).select("y", "prediction").collect()
    accuracy = np.mean([r.y == r.prediction for r in rows])
    majority = max(np.mean([r.y == c for r in rows]) for c in (1, 2, 3))
    assert accuracy > majority and {r.prediction for r in rows} <= {1, 2, 3}


def test_run_job_and_sweep(spark, blobs, tmp_path):
    train, test = blobs

    def job(settings):
        return tr.run_job(spark, settings["model_name"], settings["model_name"], tr.make_classifier(settings["model_name"], rows=180, max_iter=5), train, test,
                          "id", "y", 3, str(tmp_path))[0]

    def broken(settings):
        bad = Pipeline(stages=[tr.make_classifier("LR", features="missing")])
        return tr.run_job(spark, "LR", "broken", bad, train, test, "id", "y", 3, str(tmp_path))[0]

    report = str(tmp_path / "report")
    done = tr.sweep(spark, [{"model_name": "LRB"}, {"model_name": "nope"}], job, report) + tr.sweep(spark, [{"model_name": "LR"}], broken, report)
    assert [d["status"] for d in done] == ["success", "failed", "failed"]
    rows = {r.description: r for r in spark.read.parquet(report).collect()}
    good = rows["LRB"]
    assert np.sum(json.loads(good.confusion_matrix)) == good.test_examples and 0 < good.accuracy <= 1
    assert json.loads(good.classification_report)["accuracy"] == pytest.approx(good.accuracy)
    assert rows["broken"].status == "failed" and "missing" in rows["broken"].message


def test_search(spark, blobs):
    train, _ = blobs
    estimator = tr.make_classifier("LR", rows=180, max_iter=5)
    model, scores = tr.search(spark, estimator, train, "id", {"regParam": [0.001, 10.0], "elasticNetParam": [0.0, 0.5]}, 3, folds=3, n_iter=3)
    rows = scores.collect()
    assert len(rows) == 3 and sum(r.best for r in rows) == 1
    assert max(rows, key=lambda r: r.score).best


def test_explanation_matches_the_model(spark, blobs):
    from starloom.operators import evaluate as ev
    from pyspark.ml.functions import vector_to_array
    train, test = blobs
    model = tr.make_classifier("LR", rows=180, max_iter=10).fit(train)
    coefficients, intercepts = tr.model_coefficients(spark, model, ["0", "1", "2"])
    cells = test.select("id", F.posexplode(vector_to_array("features")).alias("feature", "value")).withColumn("feature", F.col("feature").cast("string"))
    totals = ev.contribution_totals(ev.contributions(cells, coefficients, "id"), intercepts, "id")
    best = {r.id: r.label for r in totals.groupBy("id").agg(F.max_by("label", "final_value").alias("label")).collect()}
    assert best == {r.id: r.prediction for r in tr.predict(model, test).select("id", "prediction").collect()}


def test_text_model_and_streaming(spark, tmp_path):
    good, bad = "great phone love it", "terrible broken junk"
    rows = [(i, (good if i % 2 else bad) + f" item {i % 5}", 2 if i % 2 else 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, review string, y int")
    stages = tr.ngram_tfidf_stages("review", 60, 1, 2).getStages()
    model = Pipeline(stages=[*stages, tr.make_classifier("LR", rows=60, max_iter=20)]).fit(tr.training_frame(df, "y"))
    incoming = spark.createDataFrame([(i, f"I LOVE it, great phone {i}!" if i % 2 else "<b>Terrible</b> junk", r) for i, r in enumerate([5, 1, 9, 3, None, 2])],
                                     "id int, review string, product_rating int")
    source, log, rejected, checkpoint = (str(tmp_path / n) for n in ("in", "log", "rejected", "checkpoint"))
    incoming.repartition(3).write.parquet(source)

    def to_log(batch):
        return scoring.score_reviews(batch, scoring.model_scorer(model), "LR", "v1")

    def run():
        stream = spark.readStream.schema(incoming.schema).option("maxFilesPerTrigger", 1).parquet(source)
        scoring.stream_scores(stream, to_log, log, rejected, checkpoint).awaitTermination()

    run()
    rows = {r.id: r for r in scoring.history(spark, log).collect()}
    assert set(rows) == {0, 1, 3, 5} and [rows[i].class_predicted for i in (0, 1, 3, 5)] == [1, 2, 2, 2]
    assert rows[1].input_preprocessed == "i love it great phone 1" and rows[1].input_raw.startswith("I LOVE")
    assert sorted(r.id for r in spark.read.parquet(rejected).collect()) == [2, 4]
    chances = json.loads(rows[1].class_predicted_raw)
    assert sum(map(float, chances.values())) == pytest.approx(1.0)
    incoming.where("id = 1").withColumn("id", F.lit(10)).write.mode("append").parquet(source)
    run()
    assert {r.id for r in scoring.history(spark, log).collect()} == {0, 1, 3, 5, 10}


def test_feature_sweep(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 4} common text {'x y' * i}", i % 5 + 1) for i in range(40)], "id int, body string, star_rating int")
    config = [{"description": "bow", "fn_name": "generate_bow_file", "max_features": 5, "feature_columns": "body", "lda_topics": 2},
              {"description": "w2v", "fn_name": "generate_word2vec_file", "feature_size": 4, "min_word_count": 1, "iterations": 1, "feature_columns": "body"},
              {"description": "bad", "fn_name": "none", "feature_columns": "body"}]
    done = feature_sweep(df, config, "id", "star_rating", str(tmp_path))
    assert [d["status"] for d in done] == ["success", "success", "failed"]
    first = spark.read.parquet(done[0]["outfile"])
    assert first.count() == 40 and {"topics", "features", "helpful_product"} <= set(first.columns)
    assert done[0]["outfile"].endswith("body-bow-40-5-lda2")


def test_tree_statistics_fit_the_heap(spark):
    """The statistics of all tasks of an executor take half of what Spark manages of its heap, whatever its size."""
    assert tr.tree_memory(1800, 2) == 225 and tr.tree_memory(64_000, 2) == tr.TREE_MEMORY and tr.tree_memory(400, 8) == 64
    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory() / 2**20
    for name in ("DT", "RF"):
        held = tr.make_classifier(name, max_depth=3).getMaxMemoryInMB()
        assert held * spark.sparkContext.defaultParallelism <= max(0.3 * heap, 64 * spark.sparkContext.defaultParallelism)
