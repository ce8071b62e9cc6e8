"""Review-shaped views over the given tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.catalog.registry import table

# Five event types stand for the five star ratings.
RATING_SQL = """CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
                WHEN 'signup' THEN 4 ELSE 5 END"""


def rating():
    return (F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2)
            .when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 4).otherwise(5))


def rated_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "user_id", "value", "ts", "event_type", rating().alias("truth"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Truth and a prediction that is wrong on a known share; class 2 is never predicted for some users."""
    shift = F.when(F.col("event_id") % 7 < 2, F.col("event_id") % 4).otherwise(F.lit(0))
    return rated_events(spark, folder).select(
        "event_id", "user_id", "value", "truth",
        ((F.col("truth") - 1 + shift) % 5 + 1).cast("int").alias("prediction"))


PREDICTIONS_SQL = f"""SELECT event_id, user_id, value, truth,
  CAST((truth - 1 + CASE WHEN event_id % 7 < 2 THEN event_id % 4 ELSE 0 END) % 5 + 1 AS INTEGER) AS prediction
  FROM (SELECT *, {RATING_SQL} AS truth FROM events)"""


def rated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a skewed rating: a third of the rows are five-star."""
    d = table(spark, folder, "documents")
    return d.withColumn("star_rating", F.when(F.col("doc_id") % 3 == 0, 5).otherwise(F.col("doc_id") % 5 + 1).cast("int"))


RATED_DOCUMENTS_SQL = """SELECT *, CAST(CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id % 5 + 1 END AS INTEGER) AS star_rating
  FROM documents"""


def tokens_sql(text: str = "text") -> str:
    """Bag-of-words tokens as a DuckDB list expression."""
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def clean_expr(text: str = "text") -> str:
    """Latin accents folded, non-ASCII dropped (DuckDB)."""
    return f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Model runs: one per event type (model) and user group (training size)."""
    return (table(spark, folder, "events")
            .groupBy(F.col("event_type").alias("model_name"), ((F.col("user_id") % 8 + 1) * 1000).alias("train_examples"))
            .agg((F.sum(F.round(F.col("value") * 100).cast("long")) / (F.count("*") * 100.0)).alias("eval_metric"),
                 (F.count("*") / 100.0).alias("train_time_min"), F.max("event_id").alias("run_id")))


RUNS_SQL = """SELECT event_type AS model_name, (user_id % 8 + 1) * 1000 AS train_examples,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS eval_metric,
  count(*) / CAST(100 AS DOUBLE) AS train_time_min, max(event_id) AS run_id FROM events GROUP BY 1, 2"""
