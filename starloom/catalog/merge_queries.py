"""Joins, windows and unions over events, documents and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table, texts
from starloom.catalog.views import PREDICTIONS_SQL, RATED_DOCUMENTS_SQL, RUNS_SQL, predictions, rated_documents, runs
from starloom.functions import text as tx
from starloom.operators import joins, stats, windows
from starloom.plans.ranking import number_rows
from starloom.plans.session import cut_lineage
from starloom.plans.sizing import lookup_join

_TOKENS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"

_VOCABULARY_SQL = f"""SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS term_id FROM (
    SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS_SQL}) AS word FROM documents) GROUP BY word)"""


def _vocabulary(spark, folder):
    counts = stats.term_counts(texts(spark, folder, "documents", "doc_id"), tx.count_tokens("text"), "word", "n")
    return number_rows(counts, [F.desc("n"), "word"], "term_id", start=0)


def _word_vectors(spark, folder):
    """Embedding table keyed by word: every second rank has a vector, some of the wrong length."""
    vectors = table(spark, folder, "embeddings").select(
        (F.col("vec_id") * 2).alias("term_id"),
        F.when(F.col("vec_id") % 10 == 7, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("vec"))
    return lookup_join(_vocabulary(spark, folder), vectors, ["term_id"]).select("word", "vec")


_WORD_VECTORS_SQL = f"""SELECT word, CASE WHEN vec_id % 10 = 7 THEN embedding[1:10] ELSE embedding END AS vec
    FROM ({_VOCABULARY_SQL}) v JOIN embeddings e ON v.term_id = e.vec_id * 2"""


@query("j1_merge_predictions", f"""
    WITH p AS ({PREDICTIONS_SQL}), body AS (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN event_type END AS review_body FROM events)
    SELECT event_id, a.prediction AS predict_15, b.prediction AS predict_145, c.prediction AS predict_1345, d.prediction AS predict_all,
           d.truth AS true_all, review_body FROM
      (SELECT event_id, prediction FROM p WHERE truth IN (1, 5) AND event_id % 2 = 0) a
      FULL JOIN (SELECT event_id, prediction FROM p WHERE truth IN (1, 4, 5) AND event_id % 3 = 0) b USING (event_id)
      FULL JOIN (SELECT event_id, prediction FROM p WHERE truth IN (1, 3, 4, 5)) c USING (event_id)
      FULL JOIN (SELECT p.event_id, prediction, truth, review_body FROM p JOIN body USING (event_id) WHERE p.event_id % 5 <> 0) d USING (event_id)
    WHERE review_body IS NOT NULL""")
def merge_predictions(spark, folder):
    p = predictions(spark, folder)
    body = F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("review_body")
    full = p.join(table(spark, folder, "events").select("event_id", body), "event_id")

    def part(classes, name, keep=None):
        rows = p.where(F.col("truth").isin(classes))
        return (rows.where(keep) if keep is not None else rows).select("event_id", F.col("prediction").alias(name))

    return joins.merge_predictions({
        "15": part([1, 5], "predict_15", F.col("event_id") % 2 == 0),
        "145": part([1, 4, 5], "predict_145", F.col("event_id") % 3 == 0),
        "1345": part([1, 3, 4, 5], "predict_1345"),
        "all": full.where(F.col("event_id") % 5 != 0).select(
            "event_id", F.col("prediction").alias("predict_all"), F.col("truth").alias("true_all"), "review_body"),
    }, "event_id", "review_body")


@query("j2_merge_series", f"""
    WITH r AS ({RUNS_SQL}) SELECT train_examples, round(a.eval_metric, 6) AS click, round(b.eval_metric, 6) AS error,
      round(c.eval_metric, 6) AS view FROM (SELECT * FROM r WHERE model_name = 'click' AND train_examples < 6000) a
      FULL JOIN (SELECT * FROM r WHERE model_name = 'error' AND train_examples > 2000) b USING (train_examples)
      FULL JOIN (SELECT * FROM r WHERE model_name = 'view') c USING (train_examples)""")
def merge_series(spark, folder):
    r = runs(spark, folder)
    merged = joins.merge_series({"click": r.where("model_name = 'click' AND train_examples < 6000"),
                                 "error": r.where("model_name = 'error' AND train_examples > 2000"),
                                 "view": r.where("model_name = 'view'")}, "train_examples", "eval_metric")
    return merged.select("train_examples", *[F.round(c, 6).alias(c) for c in ("click", "error", "view")])


@query("j3_wrong_with_text", f"""
    SELECT event_id, truth, prediction, props FROM ({PREDICTIONS_SQL}) JOIN (SELECT event_id, props FROM events) USING (event_id)
    WHERE truth <> prediction""")
def wrong_with_text(spark, folder):
    wrong = predictions(spark, folder).where("truth <> prediction").select("event_id", "truth", "prediction")
    return joins.attach_text(wrong, table(spark, folder, "events").select("event_id", "props"), "event_id")


@query("j4_left_join_labels", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_labels(spark, folder):
    return joins.attach_text(table(spark, folder, "documents").select("doc_id", "lang"), table(spark, folder, "labels"), "doc_id", "left")


@query("j5_vocabulary_vectors", f"""
    WITH v AS ({_VOCABULARY_SQL}), e AS (SELECT word, vec FROM ({_WORD_VECTORS_SQL}) WHERE len(vec) = 64)
    SELECT word, term_id, e.vec IS NOT NULL AS found, CAST(64 AS INTEGER) AS dim, round(coalesce(CAST(e.vec[1] AS DOUBLE), 0.0), 6) AS first,
           round(coalesce(CAST(e.vec[64] AS DOUBLE), 0.0), 6) AS last FROM v LEFT JOIN e USING (word)""")
def vocabulary_vectors(spark, folder):
    vocabulary = _vocabulary(spark, folder).select("word", "term_id")
    out = joins.vocabulary_vectors(vocabulary, _word_vectors(spark, folder), 64)
    return out.select("word", "term_id", "found", F.size("vec").alias("dim"), F.round(F.get("vec", F.lit(0)).cast("double"), 6).alias("first"),
                      F.round(F.get("vec", F.lit(63)).cast("double"), 6).alias("last"))


@query("j6_missing_words", f"SELECT word FROM ({_VOCABULARY_SQL}) WHERE word NOT IN (SELECT word FROM ({_WORD_VECTORS_SQL}))")
def missing_words(spark, folder):
    return joins.missing_words(_vocabulary(spark, folder).select("word"), _word_vectors(spark, folder))


# Known words: those that occur at least 20 times.
@query("j7_split_known_words", """
    WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
                 SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS w FROM documents)),
      known AS (SELECT word FROM t GROUP BY word HAVING count(*) >= 20),
      m AS (SELECT t.*, k.word IS NOT NULL AS known FROM t LEFT JOIN known k USING (word)),
      g AS (SELECT doc_id, list(word ORDER BY pos) AS w, coalesce(list(word ORDER BY pos) FILTER (known), []) AS k,
                   list_sort(list_distinct(coalesce(list(word) FILTER (NOT known), []))) AS u FROM m GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(u) > 0 THEN array_to_string(u, ' ') END AS out_of_vocab,
           CASE WHEN len(u) > 0 THEN array_to_string(k[1:len(w) - len(u)], ' ') ELSE array_to_string(w[1:100], ' ') END AS text_train FROM g""")
def split_known(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", F.lower("text").alias("text"))
    known = stats.term_counts(docs, tx.blank_tokens("text"), "word", "n").where("n >= 20")
    return joins.split_known_words(docs, "doc_id", "text", known)


@query("j8_align_series", """
    SELECT event_type, user_id, epoch, losses[epoch] AS loss, accs[epoch] AS acc FROM (
      SELECT event_type, user_id, list(event_id ORDER BY event_id) AS losses,
             list(event_id * 2 ORDER BY event_id) FILTER (event_id % 2 = 0) AS accs
      FROM events GROUP BY event_type, user_id), LATERAL (SELECT unnest(range(1, len(losses) + 1)) AS epoch) e""")
def align(spark, folder):
    events = table(spark, folder, "events").select("event_type", "user_id", "event_id", F.struct("event_type", "user_id").alias("run"))
    return joins.align_long_series(
        [(events.withColumnRenamed("event_id", "loss"), "loss"), (events.where("event_id % 2 = 0").withColumn("acc", F.col("event_id") * 2), "acc")],
        "run").select("run.event_type", "run.user_id", "epoch", "loss", "acc")


@query("j10_keep_top_groups", """
    SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)""")
def keep_top(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id")
    top = stats.group_sizes(events, "user_id").orderBy(F.desc("n"), "user_id").limit(10)
    return joins.keep_keys(events, top, ["user_id"])


@query("w1_improvement", f"""
    SELECT model_name, train_examples, round(coalesce(eval_metric - p, 0), 6) AS eval_metric_diff,
           round(coalesce(train_time_min - q, 0), 6) AS train_time_min_diff,
           round((eval_metric - p) / nullif(train_time_min - q, 0), 6) AS improvement_ratio FROM (
      SELECT *, lag(eval_metric) OVER w AS p, lag(train_time_min) OVER w AS q FROM ({RUNS_SQL})
      WINDOW w AS (PARTITION BY model_name ORDER BY train_examples))""")
def improvement(spark, folder):
    out = windows.improvement(runs(spark, folder), ["model_name"], "train_examples", "eval_metric", "train_time_min")
    return out.select("model_name", "train_examples", *[F.round(c, 6).alias(c) for c in (
        "eval_metric_diff", "train_time_min_diff", "improvement_ratio")])


@query("w2_best_run", f"""
    SELECT 'all' AS scope, model_name, train_examples, round(eval_metric, 6) AS eval_metric FROM (
      SELECT * FROM ({RUNS_SQL}) ORDER BY eval_metric DESC, run_id LIMIT 1)
    UNION ALL SELECT 'model', model_name, train_examples, round(eval_metric, 6) FROM (
      SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY eval_metric DESC, run_id) AS r FROM ({RUNS_SQL})) WHERE r = 1""")
def best_run(spark, folder):
    r = runs(spark, folder)
    best = [windows.best_run(r, "eval_metric", F.col("run_id")).withColumn("scope", F.lit("all")),
            windows.best_run(r, "eval_metric", F.col("run_id"), ["model_name"]).withColumn("scope", F.lit("model"))]
    return best[0].unionByName(best[1]).select("scope", "model_name", "train_examples", F.round("eval_metric", 6).alias("eval_metric"))


@query("w3_largest", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity FROM lineitem
    ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey LIMIT 50""")
def largest(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    return windows.largest(items, ["l_quantity", "l_extendedprice"], 50, ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("w4_multi_key_sort", "SELECT user_id, event_type, event_id FROM events ORDER BY user_id, event_type DESC, event_id")
def multi_sort(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_type", "event_id").orderBy("user_id", F.desc("event_type"), "event_id")


@query("w5_distinct", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark, folder):
    return table(spark, folder, "documents").select("lang", "source").dropDuplicates()


@query("w6_append_reports", f"""
    SELECT model_name, train_examples, round(eval_metric, 6) AS eval_metric, NULL::BIGINT AS run_id FROM ({RUNS_SQL}) WHERE model_name < 'p'
    UNION ALL SELECT model_name, train_examples, NULL, run_id FROM ({RUNS_SQL}) WHERE model_name >= 'p'""")
def append(spark, folder):
    r = runs(spark, folder)
    return windows.append_reports(
        r.where("model_name < 'p'").select("model_name", "train_examples", F.round("eval_metric", 6).alias("eval_metric")),
        r.where("model_name >= 'p'").select("run_id", "model_name", "train_examples"))


@query("w7_columns_beside", f"""
    SELECT rank, a.word AS word_en, a.n AS n_en, b.word AS word_de, b.n AS n_de FROM
      (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (
         SELECT unnest({_TOKENS_SQL}) AS word FROM documents WHERE lang = 'en') GROUP BY word)) a
      JOIN (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (
         SELECT unnest({_TOKENS_SQL}) AS word FROM documents WHERE lang = 'de') GROUP BY word)) b USING (rank)""")
def beside(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id")

    def ranked(lang):
        counts = stats.term_counts(docs.where(F.col("lang") == lang), tx.count_tokens("text"), "word", "n")
        return number_rows(counts, [F.desc("n"), "word"], "rank").select("rank", F.col("word").alias(f"word_{lang}"), F.col("n").alias(f"n_{lang}"))

    return windows.beside(ranked("en"), ranked("de"), "rank")


@query("w8_preview", "SELECT true AS at_most_ten, true AS all_from_the_table, CAST(2 AS BIGINT) AS columns")
def preview(spark, folder):
    docs = table(spark, folder, "documents")
    shown = cut_lineage(windows.preview(docs, ["doc_id", "lang"], 10, sample=True))
    known = shown.exceptAll(docs.select("doc_id", "lang")).agg(F.count("*")).scalar()
    return shown.agg(F.count("*").alias("n")).select((F.col("n") <= 10).alias("at_most_ten"), (known == 0).alias("all_from_the_table"),
                                                     F.lit(len(shown.columns)).cast("long").alias("columns"))
