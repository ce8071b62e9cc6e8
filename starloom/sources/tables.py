"""Readers and writers: delimited reviews, JSON lines, embeddings, reports, feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.plans.ranking import first_rows, number_rows
from starloom.sources.ranges import read_quoted_csv, sample_file_rows

RAW_REVIEW_SCHEMA = T.StructType([
    T.StructField("marketplace", T.StringType()), T.StructField("customer_id", T.LongType()),
    T.StructField("review_id", T.StringType()), T.StructField("product_id", T.StringType()),
    T.StructField("product_parent", T.LongType()), T.StructField("product_title", T.StringType()),
    T.StructField("product_category", T.StringType()), T.StructField("star_rating", T.IntegerType()),
    T.StructField("helpful_votes", T.IntegerType()), T.StructField("total_votes", T.IntegerType()),
    T.StructField("vine", T.StringType()), T.StructField("verified_purchase", T.StringType()),
    T.StructField("review_headline", T.StringType()), T.StructField("review_body", T.StringType()),
    T.StructField("review_date", T.DateType()),
])

CLEAN_REVIEW_SCHEMA = T.StructType([f for f in RAW_REVIEW_SCHEMA if f.name in (
    "star_rating", "helpful_votes", "total_votes", "review_headline", "review_body", "review_date")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEW_SCHEMA, header: bool = True) -> DataFrame:
    """Tab-separated records without quoting or escaping, one per line."""
    return (spark.read.schema(schema).option("header", header).option("sep", "\t").option("quote", "")
            .option("escape", "").option("dateFormat", "yyyy-MM-dd").csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CLEAN_REVIEW_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Comma-separated records with doubled quotes; fields may hold line breaks.

    Files are split all the same: see ``read_quoted_csv``. ``multi_line=False`` spares the second scan of files that have none.
    """
    if multi_line:
        return read_quoted_csv(spark, path, schema)
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("dateFormat", "yyyy-MM-dd").csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma-separated sink with doubled quotes; blanks around a value are part of it."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def sample_rule(index: Column, rate: int) -> Column:
    """Systematic sampling rule on a 1-based row index (the header holds index 0); rate 0 keeps all."""
    return F.lit(True) if rate == 0 else F.pmod(index, F.lit(rate)) == 0


def convert_tsv(spark: SparkSession, source: str, target: str, schema: T.StructType = RAW_REVIEW_SCHEMA, rate: int = 0,
                order: list[str] | None = None, fmt: str = "parquet", across: bool = False) -> DataFrame:
    """Convert tab-separated reviews to Parquet or CSV, optionally keeping the data lines rate, 2 rate, ... of each file.

    ``across`` counts on over all files, by path; ``order`` counts along columns instead of lines.
    """
    rows = read_tsv(spark, source, schema)
    if rate and order:
        rows = number_rows(rows, order, "__index").where(sample_rule(F.col("__index"), rate)).drop("__index")
    elif rate:
        rows = sample_file_rows(rows, rate, across)
    if fmt == "csv":
        write_csv(rows, target)
        return read_csv(spark, target, schema)
    rows.write.parquet(target)
    return spark.read.schema(schema).parquet(target)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Well-formed rows and, separately, the lines whose field count or types do not fit.

    Lines are split as plain text, so a malformed line can be listed, counted and repaired.
    """
    width = len(schema)
    line = F.col("value")
    parts = F.split(line, sep)
    typed = [F.get(F.col("__parts"), F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    unfit = [F.get(F.col("__parts"), F.lit(i)).isNotNull() & (F.get(F.col("__parts"), F.lit(i)) != "")
             & F.get(F.col("__parts"), F.lit(i)).try_cast(f.dataType).isNull() for i, f in enumerate(schema)]
    lines = spark.read.text(path).select(line.alias("line"), parts.alias("__parts"))
    bad = F.size("__parts") != width
    for u in unfit:
        bad = bad | u
    checked = lines.withColumn("__bad", bad)
    return (checked.where(~F.col("__bad")).select(*typed),
            checked.where("__bad").select("line", F.size("__parts").alias("fields")))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON-lines scan with a declared, possibly nested schema."""
    return spark.read.schema(schema).json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embedding file: first token is the word, the rest are its float components."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.get(parts, F.lit(0)).alias("word"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float")).alias("vec"))


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Legacy run report: CSV quoted with apostrophes so that its JSON cells stay intact."""
    return spark.read.option("header", True).option("quote", "'").option("escape", "'").csv(path)


def append_report(report: DataFrame, path: str) -> None:
    """Append run rows to the Parquet report table."""
    report.write.mode("append").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report table whose runs may carry different columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def feature_set_name(column: str, encoder: str, rows: int, features: int, lda_topics: int | None = None) -> str:
    """Name of a materialised feature set."""
    return f"{column}-{encoder}-{rows}-{features}-" + (f"lda{lda_topics}" if lda_topics else "nolda")


def write_features(features: DataFrame, folder: str, name: str, rating: str = "star_rating") -> str:
    """Materialise key, vector and labels, with the derived helpful_product flag."""
    path = f"{folder.rstrip('/')}/{name}"
    features.withColumn("helpful_product", F.when(F.col(rating) >= 3, 1).otherwise(0)).write.parquet(path)
    return path


def line_range(df: DataFrame, order: list[str], first: int, last: int, name: str = "line_no") -> DataFrame:
    """Rows ``first`` to ``last`` (1-based, inclusive) along ``order``; only the first ``last`` rows are brought into order."""
    return number_rows(first_rows(df, order, last), order, name).where(F.col(name).between(first, last))
