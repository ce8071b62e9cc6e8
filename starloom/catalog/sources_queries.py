"""Scans and sinks: data is written from the given tables and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.catalog.registry import query, table
from starloom.catalog.views import rated_documents
from starloom.plans.session import fresh_path
from starloom.sources import ranges
from starloom.sources import tables as src
from starloom.sources.repair import repair_lines

_LINE_SCHEMA = T.StructType([
    T.StructField("order_key", T.LongType()), T.StructField("line_no", T.IntegerType()),
    T.StructField("flag", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("ship_date", T.DateType())])


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.concat(F.lit('"'), "l_returnflag", F.lit("'")).alias("flag"),
        F.col("l_quantity").cast("int").alias("quantity"), F.to_date("l_shipdate").alias("ship_date"))


@query("s1_tsv_convert", """
    SELECT '"' || l_returnflag || '''' AS flag, CAST(l_shipdate AS DATE) AS ship_date, count(*) AS n,
           CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity
    FROM lineitem GROUP BY ALL""")
def tsv_convert(spark, folder):
    source, target = fresh_path(spark, "tsv"), fresh_path(spark, "converted")
    _lines(spark, folder).write.option("sep", "\t").option("quote", "").option("header", True).csv(source)
    rows = src.convert_tsv(spark, source, target, _LINE_SCHEMA)
    return rows.groupBy("flag", "ship_date").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                            T.StructField("seen", T.DateType())])


@query("s2_csv_scan", """
    SELECT doc_id, md5(text || '"q",' || chr(10)) AS text_md5, CAST(length(text) + 5 AS INTEGER) AS chars,
           DATE '2015-01-01' + CAST(doc_id % 200 AS INTEGER) AS seen
    FROM documents""")
def csv_scan(spark, folder):
    path = fresh_path(spark, "csv")
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat("text", F.lit('"q",\n')).alias("text"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("seen"))
    src.write_csv(docs, path)
    return src.read_csv(spark, path, _DOC_SCHEMA).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "seen")


@query("s3_tolerant_scan", """
    SELECT status, fields, count(*) AS n, CAST(sum(key) AS BIGINT) AS key_sum FROM (
      SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'bad' ELSE 'good' END AS status,
             CAST(CASE WHEN event_id % 11 = 0 THEN 3 ELSE 2 END AS INTEGER) AS fields, event_id AS key FROM events)
    GROUP BY ALL""")
def tolerant_scan(spark, folder):
    path = fresh_path(spark, "lines")
    key, event = F.col("event_id"), F.col("event_type")
    line = (F.when(key % 11 == 0, F.concat_ws("\t", key, event, F.lit("extra")))
            .when(key % 13 == 0, F.concat_ws("\t", F.concat(F.lit("x"), key), event))
            .otherwise(F.concat_ws("\t", key, event)))
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    good, bad = src.read_tolerant(spark, path, T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]))
    listed = good.select(F.lit("good").alias("status"), F.lit(2).alias("fields"), F.col("event_id").alias("key")).unionByName(
        bad.select(F.lit("bad").alias("status"), "fields",
                   F.regexp_extract("line", r"^x?(\d+)", 1).cast("long").alias("key")))
    return listed.groupBy("status", "fields").agg(F.count("*").alias("n"), F.sum("key").alias("key_sum"))


@query("s3_repaired_lines", """
    WITH e AS (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
                      CASE WHEN event_id % 11 = 0 THEN 'stray' WHEN event_id % 13 = 0 THEN 'lost' WHEN event_id % 17 = 0 THEN 'no alignment' ELSE 'good' END AS status FROM events)
    SELECT status, CASE WHEN status = 'stray' THEN event_type || chr(9) || 'x' WHEN status IN ('good') THEN event_type END AS event_type, count(*) AS n,
           CAST(CASE WHEN status <> 'no alignment' THEN sum(event_id) END AS BIGINT) AS ids, CAST(CASE WHEN status <> 'no alignment' THEN sum(cents) END AS BIGINT) AS cents
    FROM e GROUP BY status, CASE WHEN status = 'stray' THEN event_type || chr(9) || 'x' WHEN status IN ('good') THEN event_type END""")
def repaired_lines(spark, folder):
    """Lines with a stray separator in the text, a lost text, or a broken key, next to whole ones."""
    path = fresh_path(spark, "lines")
    key, event, value = (F.col(c).cast("string") for c in ("event_id", "event_type", "value"))
    number = F.col("event_id")
    line = (F.when(number % 11 == 0, F.concat_ws("\t", key, event, F.lit("x"), value)).when(number % 13 == 0, F.concat_ws("\t", key, value))
            .when(number % 17 == 0, F.concat_ws("\t", F.concat(F.lit("#"), key), event, value)).otherwise(F.concat_ws("\t", key, event, value)))
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    good, bad = src.read_tolerant(spark, path, schema)
    fixed, rest = repair_lines(bad, schema, patterns={"event_type": "[a-z_]+"})
    rows = good.withColumn("status", F.lit("good")).unionByName(
        fixed.withColumn("status", F.when(F.col("event_type").isNull(), "lost").otherwise("stray")).drop("edits")).unionByName(
        rest.select(F.col("reason").alias("status")), allowMissingColumns=True)
    return rows.groupBy("status", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("s4_json_lines", """
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM events GROUP BY ALL""")
def json_lines(spark, folder):
    path = fresh_path(spark, "jsonl")
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "value", F.from_json("props", "k bigint").alias("attributes"))
    events.write.json(path)
    rows = src.read_json_lines(spark, path, "event_id bigint, event_type string, value double, attributes struct<k:bigint>")
    return rows.groupBy("event_type", F.col("attributes.k").alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("s5_csv_sink", """
    SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(distinct text) AS texts
    FROM documents GROUP BY lang""")
def csv_sink(spark, folder):
    path = fresh_path(spark, "csv")
    src.write_csv(table(spark, folder, "documents").select("doc_id", "lang", "text"), path)
    rows = src.read_csv(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                                                   T.StructField("text", T.StringType())]))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
                                    F.countDistinct("text").alias("texts"))


@query("s6_report_append", """
    SELECT model_name, CAST(train_examples AS VARCHAR) AS train_examples, confusion_matrix, batch FROM (
      SELECT 'm' || user_id % 5 AS model_name, count(*) AS train_examples,
             '{"1": "' || CAST(max(event_id) AS VARCHAR) || '"}' AS confusion_matrix FROM events GROUP BY user_id % 5),
      (VALUES ('first'), (NULL)) b(batch)""")
def report_append(spark, folder):
    legacy, report = fresh_path(spark, "legacy"), fresh_path(spark, "report")
    runs = table(spark, folder, "events").groupBy(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_name")).agg(
        F.count("*").cast("string").alias("train_examples"),
        F.concat(F.lit('{"1": "'), F.max("event_id"), F.lit('"}')).alias("confusion_matrix"))
    runs.write.option("header", True).option("quote", "'").option("escape", "'").csv(legacy)
    imported = src.read_report_csv(spark, legacy)
    src.append_report(imported.withColumn("batch", F.lit("first")), report)
    src.append_report(imported, report)
    return src.read_report(spark, report)


@query("s7_embedding_file", """
    SELECT 'w' || vec_id AS word, i AS position, round(CAST(embedding[i] AS DOUBLE), 6) AS component
    FROM embeddings, unnest(generate_series(1, 64)) t(i)""")
def embedding_file(spark, folder):
    path = fresh_path(spark, "vectors")
    table(spark, folder, "embeddings").select(
        F.concat(F.lit("w"), "vec_id", F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
        .alias("value")).write.text(path)
    return src.read_embeddings(spark, path).select("word", F.posexplode("vec").alias("p", "c")).select(
        "word", (F.col("p") + 1).cast("long").alias("position"), F.round(F.col("c").cast("double"), 6).alias("component"))


@query("s8_feature_set", """
    SELECT star_rating, CAST(CASE WHEN star_rating >= 3 THEN 1 ELSE 0 END AS INTEGER) AS helpful_product, count(*) AS n,
           CAST(sum(n_chars) AS BIGINT) AS chars
    FROM (SELECT *, CAST(CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id % 5 + 1 END AS INTEGER) AS star_rating FROM documents)
    GROUP BY star_rating""")
def feature_set(spark, folder):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    docs = VectorAssembler(inputCols=["n_chars", "doc_id"], outputCol="features").transform(rated_documents(spark, folder))
    name = src.feature_set_name("text", "counts", 0, 2)
    path = src.write_features(docs.select("doc_id", "features", "star_rating"), fresh_path(spark, "features"), name)
    back = spark.read.parquet(path).withColumn("x", vector_to_array("features"))
    return back.groupBy("star_rating", "helpful_product").agg(
        F.count("*").alias("n"), F.sum(F.get("x", F.lit(0)).cast("long")).alias("chars"))


@query("s9_line_range", """
    SELECT event_id, event_type, line_no FROM (
      SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS line_no FROM events)
    WHERE line_no BETWEEN 100 AND 1100""")
def line_range(spark, folder):
    return src.line_range(table(spark, folder, "events").select("event_id", "event_type", "ts"),
                          ["ts", "event_id"], 100, 1100).drop("ts")


_EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])


def _event_file(spark, folder):
    """Events as tab-separated files in the order of time, with a header each."""
    path = fresh_path(spark, "event-lines")
    ordered = table(spark, folder, "events").select("ts", "event_id", "event_type").repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id")
    ordered.drop("ts").write.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    return path


@query("s1_sampled_lines", """
    SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS i FROM events) WHERE i % 90 = 0""")
def sampled_lines(spark, folder):
    return src.convert_tsv(spark, _event_file(spark, folder), fresh_path(spark, "sampled"), _EVENT_SCHEMA, rate=90, across=True)


@query("s9_file_lines", """
    SELECT event_id, event_type, line_no FROM (
      SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS line_no FROM events)
    WHERE line_no BETWEEN 100 AND 1100""")
def file_lines(spark, folder):
    return ranges.file_line_range(src.read_tsv(spark, _event_file(spark, folder), _EVENT_SCHEMA), 100, 1100, across=True)
