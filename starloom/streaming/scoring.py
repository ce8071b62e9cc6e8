"""Score reviews in batch or as a stream and keep the prediction log."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from starloom.operators.features import encode_sequences
from starloom.operators.normalizer import TextNormalizer

MAX_TEXT = 256
Scorer = Callable[[DataFrame], DataFrame]


def split_valid(reviews: DataFrame, rating: str = "product_rating") -> tuple[DataFrame, DataFrame]:
    """Reviews with a rating from 1 to 5, and the rejected rest."""
    valid = F.coalesce(F.col(rating).between(1, 5), F.lit(False))
    return (reviews.where(valid),
            reviews.where(~valid).withColumn("error", F.lit(f"{rating} must be between 1 and 5")))


def class_map(probabilities: Column) -> Column:
    """JSON object class -> probability, both as text."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((i + 1).cast("string").alias("k"), p.cast("string").alias("v")))
    return F.to_json(F.map_from_entries(pairs))


def model_scorer(model: Transformer) -> Scorer:
    """Adds the class probabilities of a fitted pipeline as the array column ``scores``."""
    def score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("scores", vector_to_array("probability"))

    return score


def score_reviews(reviews: DataFrame, scorer: Scorer, model_name: str, model_version: str, key: str = "id", text: str = "review",
                  rating: str = "product_rating", created: Column | None = None, index: DataFrame | None = None,
                  length: int = 100) -> DataFrame:
    """Normalise, encode, predict and lay out valid reviews as prediction-log rows.

    Serving keeps stop words, unlike training. ``index`` (word, index) adds the padded id sequence.
    """
    clean = TextNormalizer(inputCols=[text], removeStopWords=False).transform(reviews.withColumn("__raw", F.col(text)))
    scored = scorer(clean)
    if index is not None:
        encoded = encode_sequences(clean, key, text, index, length, mode="post").select(key, F.to_json("sequence").alias("__encoded"))
        scored = scored.join(encoded, key)
    else:
        scored = scored.withColumn("__encoded", F.lit(None).cast("string"))

    def short(c: Column) -> Column:
        return F.substring(c, 1, MAX_TEXT)

    return scored.select(
        F.col(key).alias("id"), F.col("__raw").alias("input_raw"), F.col(text).alias("input_preprocessed"),
        F.col("__encoded").alias("input_encoded"), F.col(rating).cast("int").alias("class_expected"),
        F.array_position("scores", F.array_max("scores")).cast("int").alias("class_predicted"),
        short(class_map(F.col("scores"))).alias("class_predicted_raw"), short(F.lit(model_version)).alias("model_version"),
        short(F.lit(model_name)).alias("model_name"),
        (created if created is not None else F.current_timestamp()).alias("created"), short(F.lit("SUCCESS")).alias("status"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append prediction rows to the log."""
    rows.write.mode("append").parquet(path)


def stream_scores(stream: DataFrame, score: Callable[[DataFrame], DataFrame], log_path: str, reject_path: str, checkpoint: str,
                  rating: str = "product_rating", trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Score a stream of reviews into the log and route invalid ones to the reject table.

    Every micro-batch overwrites its own ``batch`` folder, so a batch that is run again after a
    lost executor or restart leaves the log as if it had run once. ``trigger`` holds the arguments
    of the stream's trigger, such as ``{"processingTime": "1 minute"}``; without it all that is there is scored once.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid, invalid = split_valid(batch, rating)
            score(valid).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
            invalid.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def history(spark: SparkSession, log_path: str) -> DataFrame:
    """Prediction log, newest first."""
    return newest_first(spark.read.parquet(log_path))


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("created").desc(), F.col("id").desc())


# -- compacted log -------------------------------------------------------------------------------

def compact_log(spark: SparkSession, log_path: str, whole: bool = False, created: str = "created") -> int:
    """Move the rows of finished batches into day partitions; returns the number of batches taken.

    The batches not yet taken, up to the last but one (the last may still be written again; ``whole`` takes it
    too, when the stream has stopped), form a span named by its first batch. Its rows go to
    ``<log>-days/span=../day=..``, then its days and their rows to ``<log>-spans/span=..``; only the latter counts as taken. So
    a compaction that is cut off and runs again overwrites what it left, and a taken batch that the stream writes
    again changes nothing. Rows without a time have day null. One compaction may run at a time.
    """
    log = spark.read.parquet(log_path)
    taken = _spans(spark, log_path).agg(F.max("last")).scalar()
    waiting = log.where(F.col("batch") > F.coalesce(taken, F.lit(-1)))
    ends = waiting.agg(F.min("batch").alias("first"), F.max("batch").alias("last"), F.count_distinct("batch").alias("n")).first()  # three numbers
    if ends["n"] < (1 if whole else 2):
        return 0
    limit = ends["last"] if whole else ends["last"] - 1
    rows = waiting.where(F.col("batch") <= limit).withColumn("day", F.to_date(created)).drop("batch")
    # large days are split, small ones merged
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{log_path}-days/span={ends['first']}")
    days = rows.groupBy("day").agg(F.count("*").alias("n")).withColumn("last", F.lit(limit).cast("long"))
    days.coalesce(1).write.mode("overwrite").parquet(f"{log_path}-spans/span={ends['first']}")
    return ends["n"] - (0 if whole else 1)


def _spans(spark: SparkSession, log_path: str) -> DataFrame:
    """Days and numbers of rows of every span that counts as taken."""
    schema = "day date, n long, last long, span long"
    try:
        return spark.read.schema(schema).parquet(f"{log_path}-spans")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def compacted_log(spark: SparkSession, log_path: str, since: date | None = None) -> DataFrame:
    """All rows of a log: day partitions of the spans taken, and the batches not taken yet.

    ``since`` leaves out the partitions of earlier days (and of rows without a time); rows of waiting batches all stay.
    """
    log = spark.read.parquet(log_path)
    spans = _spans(spark, log_path).groupBy("span").agg(F.max("last").alias("last")).collect()  # one row a compaction
    if not spans:
        return log.drop("batch")
    days = spark.read.schema(StructType([f for f in log.schema if f.name != "batch"]).add("span", "long").add("day", "date")).parquet(f"{log_path}-days")
    days = days.where(F.col("span").isin([s["span"] for s in spans]))
    if since is not None:
        days = days.where(F.col("day") >= F.lit(since))
    waiting = log.where(F.col("batch") > max(s["last"] for s in spans))
    return days.drop("span", "day").unionByName(waiting.drop("batch"))


def latest(spark: SparkSession, log_path: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a log, newest first; opens no partition older than the day that completes them."""
    since, found = None, 0
    counts = _spans(spark, log_path).where("day IS NOT NULL").groupBy("day").agg(F.sum("n").alias("n"))
    for day in counts.orderBy(F.col("day").desc()).toLocalIterator():  # one row a day
        found += day["n"]
        if found >= n:
            since = day["day"]
            break
    return newest_first(compacted_log(spark, log_path, since)).limit(n)
