"""Projection, filtering and relabelling over events, line items and small report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table, texts
from starloom.catalog.views import PREDICTIONS_SQL, RATED_DOCUMENTS_SQL, RATING_SQL, predictions, rated_documents, rated_events
from starloom.operators import relational as rel


@query("p1_drop_columns", "SELECT event_id, user_id, event_type FROM events")
def drop(spark, folder):
    return rel.drop_columns(table(spark, folder, "events"), ["ts", "value", "props"])


@query("p2_duplicate_columns", """
    SELECT doc_id, lang AS lang_orig, lower(lang) AS lang, source AS source_orig, upper(source) AS source FROM documents""")
def duplicate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", F.col("lang").alias("old_orig"))
    return rel.duplicate_columns(docs, ["lang", "source"]).withColumns({"lang": F.lower("lang"), "source": F.upper("source")})


# A share of the texts is blanked so that both kinds of emptiness occur.
@query("p3_drop_empty", """
    SELECT conv_id, turn, length(text) AS chars, role FROM (
      SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN NULL WHEN turn % 5 = 2 THEN '' ELSE text END AS text,
             CASE WHEN conv_id % 7 = 0 THEN '' ELSE role END AS role FROM conversations)
    WHERE text IS NOT NULL AND length(text) > 0 AND length(role) > 0""")
def empty_texts(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 5 == 2, "").when(F.col("turn") % 5 != 1, F.col("text")).alias("text"),
        F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.col("role")).alias("role"))
    return rel.drop_empty(turns, ["text", "role"]).select("conv_id", "turn", F.length("text").cast("long").alias("chars"), "role")


@query("p4_drop_nulls", """
    SELECT 'any' AS mode, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys FROM events WHERE event_id % 3 <> 0 AND user_id % 4 <> 0
    UNION ALL SELECT 'subset', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE user_id % 4 <> 0""")
def nulls(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"))

    def summary(mode, df):
        return df.agg(F.count("*").alias("n"), F.sum("event_id").alias("keys")).select(F.lit(mode).alias("mode"), "n", "keys")

    return summary("any", rel.drop_nulls(events)).unionByName(summary("subset", rel.drop_nulls(events, ["user_id"])))


@query("p5_cast_features", """
    SELECT CAST(CAST(l_orderkey AS FLOAT) AS BIGINT) AS l_orderkey, CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_discount AS FLOAT) AS l_discount,
           CAST(l_linenumber AS TINYINT) AS l_linenumber FROM lineitem""")
def casts(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_linenumber")
    return rel.cast_column(rel.cast_features(items, "l_linenumber", "float32"), "l_orderkey", "int64")


@query("p6_row_predicates", """
    SELECT doc_id, lang, source FROM documents
    WHERE lang IN ('en', 'de') AND source LIKE 'src1%' AND contains(text, 'and') AND lang IS NOT NULL AND n_chars <> 416""")
def predicates(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(F.col("lang").isin("en", "de") & F.col("source").startswith("src1") & F.col("text").contains("and")
                      & F.col("lang").isNotNull() & (F.col("n_chars") != 416)).select("doc_id", "lang", "source")


@query("p7_class_subset", f"""
    SELECT event_id, star, class_code, restored, classes FROM (
      SELECT event_id, {RATING_SQL} AS star FROM events) e,
      (VALUES ('1,5', 1, 1), ('1,5', 5, 2), ('1,4,5', 1, 1), ('1,4,5', 4, 2), ('1,4,5', 5, 3),
              ('1,3,4,5', 1, 1), ('1,3,4,5', 3, 2), ('1,3,4,5', 4, 3), ('1,3,4,5', 5, 4)) m(classes, original, class_code),
      (SELECT 0) z, LATERAL (SELECT original AS restored) r WHERE star = original""")
def subsets(spark, folder):
    events = rated_events(spark, folder).select("event_id", F.col("truth").alias("star"))
    out = None
    for classes in ([1, 5], [1, 4, 5], [1, 3, 4, 5]):
        part = rel.class_subset(events, "star", classes).withColumn("restored", rel.restore_label("class_code", classes))
        part = part.withColumn("classes", F.lit(",".join(map(str, classes))))
        out = part if out is None else out.unionByName(part)
    return out


@query("p8_helpful_product", f"""
    SELECT doc_id, star_rating, CAST(CASE WHEN star_rating >= 3 THEN 1 ELSE 0 END AS INTEGER) AS helpful_product
    FROM ({RATED_DOCUMENTS_SQL})""")
def helpful(spark, folder):
    return rated_documents(spark, folder).select("doc_id", "star_rating", rel.helpful_product("star_rating").alias("helpful_product"))


@query("p9_vote_features", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, total > 1 AS has_votes,
           round(CASE WHEN total > 1 THEN l_linenumber / total END, 6) AS helpful_percentage,
           coalesce(CASE WHEN total > 1 THEN l_linenumber / total END > 0.5, false) AS helpful_review
    FROM (SELECT *, CAST(l_quantity AS BIGINT) % 12 AS total FROM lineitem)""")
def votes(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", (F.col("l_quantity").cast("long") % 12).alias("total"))
    return rel.vote_features(items, "l_linenumber", "total").withColumn(
        "helpful_percentage", F.round("helpful_percentage", 6)).drop("total")


@query("p10_attach_class", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def attach(spark, folder):
    return rel.attach_class(table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels"),
                            "doc_id", "quality")


_DESCRIPTION = ("'review_body-' || event_type || '-' || CASE WHEN user_id % 2 = 0 THEN 'df_none' ELSE 'df5' END || '-' || "
                "CASE WHEN user_id % 3 = 0 THEN 'ngram_none' ELSE 'ngram13' END || '-' || event_id || '-4000-' || "
                "CASE WHEN user_id % 4 = 0 THEN 'lda20' ELSE 'nolda' END || '-' || "
                "CASE WHEN user_id % 5 = 0 THEN 'smote' ELSE 'sampling_none' END || '-x-star_rating'")


@query("p11_parse_description", f"""
    SELECT *, concat_ws('-', feature_engineering, coalesce(config_ngram, 'nan'), feature_size) AS feature_summary,
           concat_ws('-', feature_engineering, coalesce(config_ngram, 'nan'), sampling_type) AS feature_summary_sampling FROM (
      SELECT d AS description, p[1] AS feature_column, p[2] AS feature_engineering, nullif(p[3], 'df_none') AS config_df,
             nullif(p[4], 'ngram_none') AS config_ngram, p[5] AS sample_size, p[6] AS feature_size, p[7] <> 'nolda' AS has_lda,
             p[7] AS lda_str, p[8] <> 'sampling_none' AS has_sampling, p[8] AS sampling_type, p[10] AS label_column
      FROM (SELECT d, string_split(d, '-') AS p FROM (SELECT {_DESCRIPTION} AS d FROM events)))""")
def description(spark, folder):
    u = F.col("user_id")
    text = F.concat_ws("-", F.lit("review_body"), "event_type", F.when(u % 2 == 0, "df_none").otherwise("df5"),
                       F.when(u % 3 == 0, "ngram_none").otherwise("ngram13"), F.col("event_id").cast("string"), F.lit("4000"),
                       F.when(u % 4 == 0, "lda20").otherwise("nolda"),
                       F.when(u % 5 == 0, "smote").otherwise("sampling_none"), F.lit("x"), F.lit("star_rating"))
    return rel.parse_description(table(spark, folder, "events").select(text.alias("description")))


@query("p12_replace_literals", """
    SELECT p_partkey, replace(replace(replace(p_name, 'red', 'R'), 'widget', 'W-dnn'), '-dnn', '') AS label FROM part""")
def display_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", rel.replace_literals(
        F.col("p_name"), [("red", "R"), ("widget", "W-dnn"), ("-dnn", "")]).alias("label"))


@query("p13_coalesce_history", """
    SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN props END, event_type) AS network_history FROM events""")
def history(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("history"), F.col("event_type").alias("network_history"))
    return events.select("event_id", F.coalesce("history", "network_history").alias("network_history"))


@query("p14_correct_cells", f"""
    SELECT event_id, CAST(CASE WHEN truth = 2 AND value > 50 THEN 3 ELSE prediction END AS INTEGER) AS prediction, truth
    FROM ({PREDICTIONS_SQL}) WHERE NOT (truth = 4 AND value < 10)""")
def corrections(spark, folder):
    rows = predictions(spark, folder)
    rows = rel.correct_cells(rows, (F.col("truth") == 2) & (F.col("value") > 50), {"prediction": 3})
    return rel.remove_rows(rows, (F.col("truth") == 4) & (F.col("value") < 10)).select("event_id", "prediction", "truth")
