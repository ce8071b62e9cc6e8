"""Classifiers, feature models, search, timed runs and sweeps on Spark ML.

Labels are 1-based; Spark ML wants 0-based ones, so training adds ``label0`` and prediction
adds the 1-based ``prediction``.
"""

from __future__ import annotations

import itertools
import json
import time
import traceback
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import (IDF, PCA, CountVectorizer, NGram, RegexTokenizer, VectorAssembler, Word2Vec)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.operators import evaluate as ev
from starloom.operators.boosting import HistogramBoosting
from starloom.operators.features import average_vectors
from starloom.operators.neighbor_classifier import NeighborClassifier
from starloom.operators.sampling import exact_sample, with_class_weights
from starloom.plans.concurrent import TimedOut, run_each
from starloom.plans.session import fresh_path, stage_table


# -- features ----------------------------------------------------------------------------------

def ngram_tfidf_stages(text: str, rows: int, low: int = 1, high: int = 3, output: str = "features", share: float = 0.001,
                       vocab_size: int = (1 << 31) - 1) -> Pipeline:
    """Tokenizer, n-grams, one count vectoriser per n (minimum document frequency as a share), assembled and IDF-weighted.

    Every term in that share of the rows is kept: at most 1 / share times the mean number of
    distinct terms of a text, whatever the number of rows. Fit it on the training part only.
    """
    minimum = float(max(int(share * rows), 1))
    stages: list = [RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)]
    for n in range(low, high + 1):
        stages.append(NGram(n=n, inputCol="__words", outputCol=f"__{n}_grams"))
        stages.append(CountVectorizer(inputCol=f"__{n}_grams", outputCol=f"__{n}_counts", minDF=minimum, vocabSize=vocab_size))
    stages.append(VectorAssembler(inputCols=[f"__{n}_counts" for n in range(low, high + 1)], outputCol="__counts"))
    stages.append(IDF(inputCol="__counts", outputCol=output))
    return Pipeline(stages=stages)


def lda_features(df: DataFrame, vectors: str, topics: int, iterations: int = 10, seed: int = 0) -> tuple[LDAModel, DataFrame]:
    """Topic shares of each row as a ``topics`` array column."""
    model = LDA(k=topics, maxIter=iterations, seed=seed, featuresCol=vectors, topicDistributionCol="__topics").fit(df)
    return model, model.transform(df).withColumn("topics", vector_to_array("__topics")).drop("__topics")


def train_word2vec(df: DataFrame, words: Column, size: int = 100, window: int = 5, min_count: int = 5, iterations: int = 5,
                   partitions: int = 8, seed: int = 1) -> DataFrame:
    """Word vectors (word, vec) trained on token arrays.

    More training ``partitions`` run faster but mix their updates less often; the result depends
    on their number and not on the machine.
    """
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, numPartitions=partitions, seed=seed,
                     inputCol="__words", outputCol="__doc").fit(df.select(words.alias("__words")))
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def subword_tokens(words: Column, low: int = 3, high: int = 6) -> Column:
    """Each word followed by its character n-grams (with word-boundary marks)."""
    def pieces(word: Column) -> Column:
        marked = F.concat(F.lit("<"), word, F.lit(">"))
        none = F.array().cast("array<string>")
        grams = [_char_grams(marked, n, none) for n in range(low, high + 1)]
        return F.concat(F.array(word), *grams)

    return F.flatten(F.transform(words, pieces))


def _char_grams(marked: Column, n: int, none: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(marked) - F.lit(n - 1))
    return F.when(F.length(marked) >= n, F.transform(starts, lambda i: F.substring(marked, i, F.lit(n)))).otherwise(none)


def word2vec_features(df: DataFrame, key: str, text: str, subwords: bool = False, **options) -> DataFrame:
    """Mean word vector per text, of words only or of words and their character n-grams."""
    words = tx.word_punct_tokens(text)
    tokens = subword_tokens(words) if subwords else words
    vectors = train_word2vec(df, tokens, **options)
    return average_vectors(df, key, tokens, vectors)


def pca_features(df: DataFrame, key: str, vec: str, components: int = 2, rows: int = 5000, seed: int = 1) -> DataFrame:
    """First principal components of a repeatable sample of rows."""
    sampled = exact_sample(df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("__v")), key, rows, seed)
    model = PCA(k=components, inputCol="__v", outputCol="__p").fit(sampled)
    scores = vector_to_array("__p")
    return model.transform(sampled).select(key, *[F.get(scores, F.lit(i)).alias(f"pc{i + 1}") for i in range(components)])


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features (Rahimi and Recht 2007) for the RBF kernel exp(-gamma |x - y|^2)."""

    size = Param(Params._dummy(), "size", "number of features", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, gamma=1.0, seed=1):
        super().__init__()
        self._setDefault(size=256, gamma=1.0, seed=1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            data = np.stack(x.to_numpy())
            rng = np.random.default_rng(seed)
            weights = rng.normal(scale=np.sqrt(2 * gamma), size=(data.shape[1], size))
            shift = rng.uniform(0, 2 * np.pi, size)
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(data @ weights + shift)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


# -- classifiers -------------------------------------------------------------------------------

#: Megabytes of split statistics a task may hold at most; deep trees need fewer passes with more.
TREE_MEMORY = 1024


def tree_memory(heap_mb: float | None = None, tasks: int | None = None) -> int:
    """Megabytes of split statistics a task of this session may hold: half of its share of the heap Spark manages.

    Every task of a pass holds its own, beside the cached rows. ``heap_mb`` of an executor and its ``tasks`` at a time are the session's.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and heap_mb is None:
        sc = spark.sparkContext
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        heap_mb = (sc._jvm.java.lang.Runtime.getRuntime().maxMemory() / 2**20 if local
                   else sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(sc.getConf().get("spark.executor.memory", "1g")))
        executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)
        tasks = tasks or max(1, -(-sc.defaultParallelism // executors))
    if heap_mb is None:
        return 256
    return int(min(TREE_MEMORY, max(64, (heap_mb - 300) * 0.6 / (2 * (tasks or 1)))))


def make_classifier(name: str, rows: int = 1, classes: int = 5, features: str = "features", max_iter: int = 100, c: float = 1.0,
                    max_depth: int = 10, layers: Sequence[int] | None = None, seed: int = 1, rff_size: int = 256,
                    gamma: float = 1.0, trees: int = 100, key: str = "id", neighbors: int = 5, radius: float = 1.0) -> Estimator:
    """Classifier by configuration name; a trailing B (LRB, DTB) means class-balanced weights.

    LR's ``c`` divides a summed loss, Spark's penalty a mean loss: regParam = 1 / (c * rows).
    GB is one-vs-rest boosted trees, the histogram variants (lGBM, XGB, CB) are one multi-class operator. KNN and RN
    keep the training rows and ask the neighbour graph (KNN) or the search in cells; they need the row ``key``.
    The model codes are fixed values of configuration files.
    """
    common = {"featuresCol": features, "labelCol": "label0"}
    balanced = {"weightCol": "weight"} if name in ("LRB", "DTB") else {}
    if name in ("LR", "LRB"):
        return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(rows, 1)), standardization=False, **common, **balanced)
    if name in ("DT", "DTB"):
        return DecisionTreeClassifier(maxDepth=max_depth, seed=seed, maxMemoryInMB=tree_memory(), **common, **balanced)
    if name == "RF":
        return RandomForestClassifier(maxDepth=max_depth, numTrees=trees, seed=seed, maxMemoryInMB=tree_memory(), **common)
    if name in ("lGBM", "XGB", "CB"):
        return HistogramBoosting(maxIter=max_iter, maxDepth=max_depth, **common)
    if name == "GB":
        return OneVsRest(classifier=GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed, featuresCol=features), parallelism=4, **common)
    if name in ("KNN", "RN"):
        return NeighborClassifier(key=key, features=features, label="label0", k=neighbors, radius=radius if name == "RN" else None, graph=name == "KNN")
    if name == "SVC_RBF":
        machine = OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(rows, 1)), featuresCol="__rff", weightCol="weight"),
                            labelCol="label0", featuresCol="__rff", weightCol="weight", parallelism=4)
        return Pipeline(stages=[RandomFourierFeatures(inputCol=features, outputCol="__rff", size=rff_size, gamma=gamma, seed=seed), machine])
    if name == "DNN":
        if not layers:
            raise ValueError("DNN needs layers: [inputs, hidden..., classes]")
        return MultilayerPerceptronClassifier(layers=list(layers), maxIter=max_iter, seed=seed, **common)
    raise ValueError(f"no classifier has the code {name}")


def training_frame(df: DataFrame, label: str) -> DataFrame:
    """Add the 0-based label and balanced class weights."""
    return with_class_weights(df, label).withColumn("label0", (F.col(label) - 1).cast("double"))


def training_partitions(df: DataFrame, rows: int, width: int = 4000, cells_per_task: int = 3_000_000) -> DataFrame:
    """As many partitions as the work of a pass, ``rows`` times ``width``, can fill.

    An iterative fit starts its tasks anew for every pass, so more would cost their starts; a stored
    table of fewer splits is spread over idle cores.
    """
    wanted = max(1, -(-rows * width // cells_per_task))
    held, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(wanted) if wanted <= held else df.repartition(max(held, min(wanted, cores)))


def predict(model: Transformer, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Model output with a 1-based integer prediction."""
    return model.transform(df).withColumn(prediction, (F.col("prediction") + 1).cast("int"))


def model_coefficients(spark: SparkSession, model, terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Coefficients (feature, label, coefficient) and intercepts (label, intercept) of a linear model."""
    matrix = model.coefficientMatrix.toArray()
    rows = [(term, int(c) + 1, float(matrix[c, j])) for c in range(matrix.shape[0]) for j, term in enumerate(terms)]
    offsets = [(i + 1, float(v)) for i, v in enumerate(model.interceptVector)]
    return (spark.createDataFrame(rows, "feature string, label int, coefficient double"),
            spark.createDataFrame(offsets, "label int, intercept double"))


class ScoreEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Harmonic-mean score of recall(1..k-1) and precision(k) as a tuning metric: one aggregate."""

    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=5):
        super().__init__()
        self._setDefault(classes=5)
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        k = self.getOrDefault(self.classes)
        terms = [(c, "recall") for c in range(1, k)] + [(k, "precision")]
        rows = dataset.select((F.col("label0") + 1).cast("int").alias("truth"), (F.col("prediction") + 1).cast("int").alias("guess"))
        return float(ev.overall_score(ev.classification_report(rows, "truth", "guess"), [], terms).first()["eval_metric"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def parameter_maps(estimator: Estimator, space: Mapping[str, Sequence[object]], n_iter: int | None = None, seed: int = 1) -> list[dict]:
    """All combinations of a parameter grid, or ``n_iter`` of them drawn at random."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    if n_iter is not None and n_iter < len(grid):
        picks = np.random.default_rng(seed).choice(len(grid), n_iter, replace=False)
        grid = [grid[i] for i in sorted(picks)]
    return [{estimator.getParam(k): v for k, v in combo.items()} for combo in grid]


def search(spark: SparkSession, estimator: Estimator, train: DataFrame, key: str, space: Mapping[str, Sequence[object]], classes: int = 5,
           folds: int = 5, n_iter: int | None = None, parallelism: int = 2, seed: int = 1) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated grid or random search with hash folds; returns the model and all scores."""
    maps = parameter_maps(estimator, space, n_iter, seed)
    # not the hash of the train and test split, whose training part holds only a range of it
    folded = train.withColumn("__fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int"))
    model = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ScoreEvaluator(classes=classes), numFolds=folds,
                           foldCol="__fold", parallelism=parallelism).fit(folded)
    best = int(np.argmax(model.avgMetrics))
    rows = [(i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(s), i == best)
            for i, (m, s) in enumerate(zip(maps, model.avgMetrics))]
    return model, spark.createDataFrame(rows, "candidate int, params string, score double, best boolean")


# -- runs --------------------------------------------------------------------------------------

RUN_SCHEMA = ("model_name string, description string, status string, status_date string, message string, model_file string, "
              "train_examples long, test_examples long, train_time_min double, model_save_time_min double, predict_time_min double, "
              "cr_time_min double, accuracy double, eval_metric double, classification_report string, confusion_matrix string")


class Stopwatch:
    """Named durations in true minutes."""

    def __init__(self) -> None:
        self.minutes: dict[str, float] = {}

    def time(self, name: str, action: Callable):
        start = time.monotonic()
        try:
            return action()
        finally:
            self.minutes[name] = round((time.monotonic() - start) / 60, 4)


def run_job(spark: SparkSession, name: str, description: str, estimator: Estimator, train: DataFrame, test: DataFrame, key: str, label: str,
            classes: int = 5, model_dir: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Fit, save, predict and report one model: (one-row report, staged predictions).

    A failure becomes a row with status 'failed' and its message. Predictions are written once
    and every metric comes from one grouped pass over them.
    """
    watch, row = Stopwatch(), {"model_name": name, "description": description, "status": "success"}
    staged = None
    try:
        model = watch.time("train_time_min", lambda: estimator.fit(train))
        row["model_file"] = f"{model_dir or fresh_path(spark, 'models')}/{description}"
        watch.time("model_save_time_min", lambda: model.write().overwrite().save(row["model_file"]))
        staged = watch.time("predict_time_min", lambda: stage_table(predict(model, test).select(key, label, "prediction"), "predictions"))
        row.update(watch.time("cr_time_min", lambda: _report_cells(staged, label, classes)))
        row.update(train_examples=train.count(), test_examples=staged.count())
    except Exception as error:  # noqa: BLE001 - a failed run is a result
        row.update(status="failed", message=str(error)[:2000] or traceback.format_exc(limit=1))
    row["status_date"] = _now()
    row.update(watch.minutes)
    return _run_row(spark, row), staged


def _run_row(spark: SparkSession, row: Mapping[str, object]) -> DataFrame:
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA)


def _report_cells(staged: DataFrame, label: str, classes: int) -> dict:
    report = ev.classification_report(staged, label, "prediction").withColumn("run", F.lit(1)).cache()
    terms = [(c, "recall") for c in range(1, classes)] + [(classes, "precision")]
    try:
        # one value each: accuracy, score, report text and a classes x classes matrix
        return {"accuracy": report.where("label = 'accuracy'").first()["f1"],
                "eval_metric": ev.overall_score(report, [], terms).first()["eval_metric"],
                "classification_report": ev.report_json(report, ["run"]).first()["classification_report"],
                "confusion_matrix": ev.confusion_json(staged, label, "prediction", classes).first()["confusion_matrix"]}
    finally:
        report.unpersist()


def sweep(spark: SparkSession, config: Iterable[Mapping[str, object]], job: Callable[[Mapping[str, object]], DataFrame],
          report_path: str, parallel: int = 1, timeout: float | None = None, resume: bool = False) -> list[dict]:
    """Run one job per configuration row, append each report, and return the rows with their status.

    Each job is a distributed Spark run, ``parallel`` of them at a time; the rows are returned in the order of the
    configuration. A job that takes more than ``timeout`` seconds is cancelled and becomes 'failed', in the report as
    well. With ``resume``, rows whose settings the report holds as 'success' are not run again.
    """
    rows = [dict(settings) for settings in config]
    finished = _finished(spark, report_path) if resume else {}

    def run(settings: dict) -> dict:
        if _settings_key(settings) in finished:
            return {"status": "success", "message": None, "status_date": finished[_settings_key(settings)]}
        report = job(settings)
        first = report.select("status", "message").first()
        return {"status": first["status"], "message": first["message"], "report": report}

    done = []
    with ThreadPoolExecutor(1) as writer:
        # the report is written when a job has ended within its limit, one at a time
        def ended(settings: dict, result: dict | None, error: Exception | None) -> dict:
            outcome = result or {"status": "failed", "message": str(error)[:2000]}
            report = outcome.pop("report", None)
            outcome.setdefault("status_date", _now())
            if report is None and isinstance(error, TimedOut):
                report = _run_row(spark, {"model_name": settings.get("model_name"), "description": settings.get("description"), **outcome})
            if report is not None:
                report.withColumn("settings", F.lit(_settings_key(settings))).write.mode("append").parquet(report_path)
            return {**settings, **outcome}

        def guarded(settings: dict, result: dict | None, error: Exception | None) -> dict:
            try:
                return ended(settings, result, error)
            except Exception as failure:  # noqa: BLE001 - recorded per row
                return {**settings, "status": "failed", "message": str(failure)[:2000], "status_date": _now()}

        waiting = run_each(spark, rows, run, parallel, timeout, lambda row, result, error: writer.submit(guarded, row, result, error))
        done = [future.result() for future in waiting]
    return done


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


def _settings_key(settings: Mapping[str, object]) -> str:
    return json.dumps(settings, sort_keys=True, default=str)


def _finished(spark: SparkSession, report_path: str) -> dict[str, str]:
    """Settings of the jobs a report holds as done, with their dates (one row a job)."""
    try:
        report = spark.read.parquet(report_path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return {}
        raise
    if "settings" not in report.columns:
        return {}
    return {r["settings"]: r["status_date"] for r in report.where("status = 'success'").select("settings", "status_date").collect()}


def load_model(path: str) -> PipelineModel:
    """Read a saved pipeline model."""
    return PipelineModel.load(path)
