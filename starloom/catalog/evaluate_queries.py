"""Evaluation of predictions and analysis of stored run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table, texts
from starloom.catalog.views import PREDICTIONS_SQL, RUNS_SQL, predictions, runs
from starloom.functions import text as tx
from starloom.operators import evaluate as ev
from starloom.operators import roc, stats
from starloom.operators.curve_intervals import auc_intervals
from starloom.plans.ranking import top_rows


def _r6(df, *columns):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in columns})


def _class_sql(source, key):
    """Per-class metrics per key as independent SQL."""
    k = f"{key}, " if key else ""
    on = f"USING ({key}, label)" if key else "USING (label)"
    return f"""(SELECT {k}label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits,
        coalesce(hits / predicted, 0) AS precision, coalesce(hits / support, 0) AS recall,
        CASE WHEN coalesce(hits, 0) > 0 THEN CAST(2 AS DOUBLE) * hits / (support + predicted) ELSE 0 END AS f1
      FROM (SELECT {k}truth AS label, count(*) AS support, count(*) FILTER (truth = prediction) AS hits FROM ({source}) GROUP BY ALL)
      FULL JOIN (SELECT {k}prediction AS label, count(*) AS predicted FROM ({source}) GROUP BY ALL) {on})"""


_CLASSES = _class_sql(PREDICTIONS_SQL, "")
_USER_CLASSES = _class_sql(PREDICTIONS_SQL, "user_id")


def _user_report(spark, folder):
    return ev.classification_report(predictions(spark, folder), "truth", "prediction", ["user_id"])


def _stored(spark, folder):
    """Stored run reports: one run per user with JSON cells."""
    rows = ev.report_json(_user_report(spark, folder), ["user_id"])
    counts = predictions(spark, folder).groupBy("user_id").agg(F.count("*").alias("test_examples"))
    return rows.join(counts, "user_id").select(
        "user_id", "test_examples", (F.col("test_examples") * 3).alias("train_examples"),
        F.concat(F.lit("m"), (F.col("user_id") % 3)).alias("model_name"), F.lit("1x128").alias("architecture"), "classification_report",
        F.when(F.col("user_id") % 2 == 0, F.col("classification_report")).alias("classification_report_train"))


@query("e1_confusion_matrix", f"""
    SELECT CAST(t AS INTEGER) AS truth, CAST(p AS INTEGER) AS prediction, count(truth) AS n FROM range(1, 6) a(t), range(1, 6) b(p)
    LEFT JOIN ({PREDICTIONS_SQL}) ON truth = t AND prediction = p GROUP BY t, p""".replace(
        "FROM range(1, 6) a(t), range(1, 6) b(p)", "FROM (SELECT t, p FROM range(1, 6) a(t), range(1, 6) b(p))"))
def confusion(spark, folder):
    return ev.confusion_matrix(predictions(spark, folder), "truth", "prediction", 5)


@query("e1_confusion_json", f"""
    SELECT '[' || string_agg('[' || a || ',' || b || ',' || c || ',' || d || ',' || e || ']', ',' ORDER BY truth) || ']' AS confusion_matrix
    FROM (SELECT truth, count(*) FILTER (prediction = 1) AS a, count(*) FILTER (prediction = 2) AS b, count(*) FILTER (prediction = 3) AS c,
          count(*) FILTER (prediction = 4) AS d, count(*) FILTER (prediction = 5) AS e FROM ({PREDICTIONS_SQL}) GROUP BY truth)""")
def confusion_json(spark, folder):
    return ev.confusion_json(predictions(spark, folder), "truth", "prediction", 5)


@query("e2_classification_report", f"""
    SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {_CLASSES}
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_CLASSES}
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM {_CLASSES}
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {_CLASSES}""")
def report(spark, folder):
    return _r6(ev.classification_report(predictions(spark, folder), "truth", "prediction"), "precision", "recall", "f1")


def _score_sql(terms, classes, key):
    values = [f"coalesce(max({m}) FILTER (label = {c}), 0)" for c, m in terms]
    k = f"{key}, " if key else ""
    zero = " OR ".join(f"{v} = 0" for v in values)
    total = " + ".join(f"1 / {v}" for v in values)
    return (f"SELECT {k}round(CASE WHEN {zero} THEN 0 ELSE {len(terms)} / ({total}) END, 6) AS eval_metric FROM {classes} "
            + (f"GROUP BY {key}" if key else ""))


@query("e3_overall_score", _score_sql(ev.SCORE_TERMS, _USER_CLASSES, "user_id"))
def score(spark, folder):
    return _r6(ev.overall_score(_user_report(spark, folder), ["user_id"]), "eval_metric")


@query("e4_reduced_scores", " UNION ALL ".join(
    f"SELECT '{name}' AS variant, * FROM ({_score_sql(terms, _USER_CLASSES, 'user_id')})" for name, terms in (
        ("coded_15", ev.SCORE_TERMS_15), ("15", ev.SCORE_TERMS_15_PRECISION), ("145", ev.SCORE_TERMS_145), ("1345", ev.SCORE_TERMS_1345))))
def reduced(spark, folder):
    base = _user_report(spark, folder)
    out = None
    for name, terms in (("coded_15", ev.SCORE_TERMS_15), ("15", ev.SCORE_TERMS_15_PRECISION), ("145", ev.SCORE_TERMS_145),
                        ("1345", ev.SCORE_TERMS_1345)):
        part = ev.overall_score(base, ["user_id"], terms).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return _r6(out, "eval_metric")


def _scored(spark, folder):
    scores = [((F.col("event_id") * (7 + 2 * c) + c * 13) % 400 + F.when(F.col("truth") == c, 150).otherwise(0)) / 550.0 for c in range(1, 6)]
    return predictions(spark, folder), scores


_SCORED_SQL = " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS curve, ((event_id * {7 + 2 * c} + {c * 13}) % 400 + CASE WHEN truth = {c} THEN 150 ELSE 0 END) / CAST(550 AS DOUBLE) AS score, "
    f"CAST(truth = {c} AS INTEGER) AS hit FROM ({PREDICTIONS_SQL})" for c in range(1, 6))

# Curves built with windows and the macro mean by explicit interpolation on the union grid.
_CURVES_SQL = f"""
    s AS ({_SCORED_SQL}), u AS (SELECT curve, score, hit FROM s UNION ALL SELECT 'micro', score, hit FROM s),
    g AS (SELECT curve, score, sum(hit) AS pos, count(*) - sum(hit) AS neg FROM u GROUP BY ALL),
    c AS (SELECT curve, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS p, sum(neg) OVER t AS n,
            lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS i FROM g
          WINDOW w AS (PARTITION BY curve ORDER BY score DESC), t AS (PARTITION BY curve)),
    k AS (SELECT curve, i, fp / CAST(n AS DOUBLE) AS fpr, tp / CAST(p AS DOUBLE) AS tpr FROM c
            WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
          UNION ALL SELECT DISTINCT curve, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM c)"""


@query("e5_roc_auc", f"""
    WITH {_CURVES_SQL},
    a AS (SELECT curve, sum((fpr - pf) * (tpr + pt) / 2) AS auc FROM (
            SELECT curve, fpr, tpr, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM k WINDOW w AS (PARTITION BY curve ORDER BY i)) GROUP BY curve),
    v AS (SELECT curve, fpr, max(tpr) AS hi, min(tpr) AS lo FROM k WHERE curve <> 'micro' GROUP BY ALL),
    seg AS (SELECT curve, fpr, hi, lead(fpr) OVER w AS nf, lead(lo) OVER w AS nlo FROM v WINDOW w AS (PARTITION BY curve ORDER BY fpr)),
    grid AS (SELECT DISTINCT fpr AS x FROM v),
    m AS (SELECT x, avg(CASE WHEN nf IS NULL OR x = fpr THEN hi ELSE hi + (nlo - hi) * (x - fpr) / (nf - fpr) END) AS y
          FROM grid JOIN seg ON x >= fpr AND (nf IS NULL OR x < nf) GROUP BY x),
    macro AS (SELECT sum((x - px) * (y + py) / 2) AS auc FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM m))
    SELECT curve, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(auc, 6) FROM macro""")
def auc(spark, folder):
    rows, scores = _scored(spark, folder)
    return _r6(roc.roc_auc(rows, "truth", scores), "auc")


@query("e5_auc_interval", f"""
    WITH {_CURVES_SQL}
    SELECT curve, round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc, true AS inside, true AS spread, 400 AS replicates FROM (
      SELECT curve, fpr, tpr, lag(fpr) OVER w AS pf, lag(tpr) OVER w AS pt FROM k WINDOW w AS (PARTITION BY curve ORDER BY i)) GROUP BY curve""")
def auc_interval(spark, folder):
    rows, scores = _scored(spark, folder)
    out = auc_intervals(rows, "event_id", "truth", scores, replicates=400)
    return out.select("curve", F.round("auc", 6).alias("auc"), F.col("auc").between(F.col("low"), F.col("high")).alias("inside"),
                      ((F.col("high") > F.col("low")) & (F.col("high") - F.col("low") < 0.2)).alias("spread"), F.col("replicates").cast("int").alias("replicates"))


@query("e5_roc_curves", f"WITH {_CURVES_SQL} SELECT curve, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM k")
def curves(spark, folder):
    rows, scores = _scored(spark, folder)
    return roc.roc_curves(rows, "truth", scores).select("curve", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_FLAT_SQL = " UNION ALL ".join(
    [f"SELECT user_id, label || '_{name}' AS name, CAST({m} AS DOUBLE) AS value FROM {_USER_CLASSES}" for m, name in (
        ("precision", "precision"), ("recall", "recall"), ("f1", "f1-score"), ("support", "support"))]
    + [f"SELECT user_id, 'accuracy', sum(hits) / sum(support) FROM {_USER_CLASSES} GROUP BY user_id"]
    + [f"SELECT user_id, 'macro avg_{name}', {e} FROM {_USER_CLASSES} GROUP BY user_id" for name, e in (
        ("precision", "avg(precision)"), ("recall", "avg(recall)"), ("f1-score", "avg(f1)"), ("support", "sum(support)"))]
    + [f"SELECT user_id, 'weighted avg_{name}', {e} FROM {_USER_CLASSES} GROUP BY user_id" for name, e in (
        ("precision", "sum(precision * support) / sum(support)"), ("recall", "sum(recall * support) / sum(support)"),
        ("f1-score", "sum(f1 * support) / sum(support)"), ("support", "sum(support)"))])


@query("e6_flatten_reports", f"SELECT user_id, 'train_' || name AS name, round(value, 6) AS value FROM ({_FLAT_SQL})")
def flatten(spark, folder):
    return _r6(ev.flatten_reports(_stored(spark, folder), ["user_id"], "classification_report", "train_"), "value")


@query("e6_wide_reports", f"""
    SELECT user_id, round(max(value) FILTER (name = '1_recall'), 6) AS "1_recall", round(max(value) FILTER (name = '5_f1-score'), 6) AS "5_f1-score",
           round(max(value) FILTER (name = 'macro avg_recall'), 6) AS "macro avg_recall" FROM ({_FLAT_SQL}) GROUP BY user_id""")
def wide(spark, folder):
    flat = ev.flatten_reports(_stored(spark, folder), ["user_id"], "classification_report")
    names = ["1_recall", "5_f1-score", "macro avg_recall"]
    return _r6(ev.widen_flat(flat, ["user_id"], names), *names)


@query("e7_remap_classes", f"""
    SELECT user_id, CASE label WHEN 2 THEN '3' WHEN 3 THEN '4' WHEN 4 THEN '5' WHEN 5 THEN '6' ELSE CAST(label AS VARCHAR) END AS label,
           round(recall, 6) AS recall FROM {_USER_CLASSES}""")
def remap(spark, folder):
    remapped = ev.remap_classes("classification_report", {"5": "6", "4": "5", "3": "4", "2": "3"})
    rows = _stored(spark, folder).select("user_id", F.explode(remapped).alias("label", "raw")).where(F.col("label").rlike("^[0-9]+$"))
    return rows.select("user_id", "label", F.round(F.from_json("raw", "map<string,double>")["recall"], 6).alias("recall"))


@query("e8_enrich_reports", f"""
    SELECT user_id, n * 4 AS sample_size, 'm' || user_id % 3 || ' (1x128)' AS display_name, eval_metric,
           CASE WHEN user_id % 2 = 0 THEN eval_metric END AS eval_metric_train
    FROM ({_score_sql(ev.SCORE_TERMS, _USER_CLASSES, "user_id")}) JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)""")
def enrich(spark, folder):
    rows = ev.enrich_reports(_stored(spark, folder)).select("user_id", "sample_size", "display_name", "eval_metric", "eval_metric_train")
    complete = rows.withColumns({c: F.when(F.col("user_id") % 2 == 0, F.coalesce(c, F.lit(0.0))) if c.endswith("train")
                                 else F.coalesce(c, F.lit(0.0)) for c in ("eval_metric", "eval_metric_train")})
    return _r6(complete, "eval_metric", "eval_metric_train")


@query("e9_minority_averages", f"""
    SELECT user_id, round(sum(recall) FILTER (label < 5) / 4, 6) AS minority_recall, round(sum(precision) FILTER (label < 5) / 4, 6) AS minority_precision,
           CAST(user_id * 0.25 + 1.5 AS DOUBLE) AS total_time_min FROM {_USER_CLASSES} GROUP BY user_id""")
def minority(spark, folder):
    wide_rows = ev.wide_metrics(_user_report(spark, folder), ["user_id"], ["1", "2", "3", "4", "5"]).na.fill(0.0).withColumns(
        {"train_time_min": F.col("user_id") * 0.25, "predict_time_min": F.lit(1.5)})
    out = ev.minority_averages(wide_rows).select("user_id", "minority_recall", "minority_precision", "total_time_min")
    return _r6(out, "minority_recall", "minority_precision")


@query("e10_misclassified", f"""
    SELECT event_id, truth, prediction, props, truth = prediction AS correct FROM ({PREDICTIONS_SQL}) JOIN (SELECT event_id, props FROM events) USING (event_id)
    WHERE (truth = 5 AND prediction = 1) OR (truth = 4 AND prediction = 5) OR (truth = 2 AND prediction = 3)""")
def misclassified(spark, folder):
    wrong = ev.misclassified(predictions(spark, folder), "truth", "prediction", [(5, 1), (4, 5), (2, 3)])
    return wrong.select("event_id", "truth", "prediction", (F.col("truth") == F.col("prediction")).alias("correct")).join(
        table(spark, folder, "events").select("event_id", "props"), "event_id")


@query("e10_commonly_evaluated", f"""
    SELECT truth, count(*) AS n FROM (SELECT truth, CASE WHEN event_id % 2 = 0 THEN prediction END AS a, CASE WHEN event_id % 3 = 0 THEN prediction END AS b
      FROM ({PREDICTIONS_SQL})) WHERE (truth = 5 AND a IS NOT NULL AND b IS NOT NULL) OR (truth = 4 AND b IS NOT NULL) OR truth = 2 GROUP BY truth""")
def common(spark, folder):
    rows = predictions(spark, folder).select("truth", F.when(F.col("event_id") % 2 == 0, F.col("prediction")).alias("a"),
                                             F.when(F.col("event_id") % 3 == 0, F.col("prediction")).alias("b"))
    return ev.commonly_evaluated(rows, "truth", {5: ["a", "b"], 4: ["b"], 2: []}).groupBy("truth").agg(F.count("*").alias("n"))


@query("e11_category_shares", f"""
    SELECT category, prediction, total, round(total / sum(total) OVER (PARTITION BY category), 6) AS percentage FROM (
      SELECT CASE user_id % 3 WHEN 0 THEN 'negative_only' WHEN 1 THEN 'has_positive' ELSE 'neutral' END AS category, prediction, count(*) AS total
      FROM ({PREDICTIONS_SQL}) WHERE truth <> prediction GROUP BY ALL)""")
def categories(spark, folder):
    kind = F.when(F.col("user_id") % 3 == 0, "negative_only").when(F.col("user_id") % 3 == 1, "has_positive").otherwise("neutral")
    wrong = ev.misclassified(predictions(spark, folder), "truth", "prediction").withColumn("category", kind)
    return _r6(ev.category_shares(wrong, "category", "prediction"), "percentage")


_TOP_TERMS = """(SELECT word, row_number() OVER (ORDER BY n DESC, word) AS feature FROM (SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 200)"""


@query("e12_contributions", f"""
    SELECT doc_id, CAST(label AS INTEGER) AS label, CAST(coalesce(sum(value * ((feature * 31 + label * 17) % 21 - 10)), 0) + label * 100 AS BIGINT) AS final_value
    FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, feature, count(*) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents)
          JOIN {_TOP_TERMS} USING (word) GROUP BY ALL) USING (doc_id), range(1, 6) l(label) GROUP BY doc_id, label""")
def explain(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id")
    vocabulary = top_rows(stats.term_counts(docs, tx.count_tokens("text"), "word", "n"), [F.desc("n"), "word"], 200, "feature")
    features = (docs.select("doc_id", F.explode(tx.count_tokens("text")).alias("word")).join(F.broadcast(vocabulary), "word")
                .groupBy("doc_id", "feature").agg(F.count("*").alias("value")))
    labels = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("label")
    coefficients = vocabulary.select("feature", labels).withColumn(
        "coefficient", (F.col("feature") * 31 + F.col("label") * 17) % 21 - 10)
    intercepts = spark.range(1).select(labels).withColumn("intercept", F.col("label") * 100)
    totals = ev.contribution_totals(ev.contributions(features, coefficients, "doc_id"), intercepts, "doc_id", docs)
    return totals.withColumn("final_value", F.col("final_value").cast("long"))


@query("e13_melt_metrics", f"""
    SELECT user_id, label || '_recall' AS name, round(recall, 6) AS value FROM {_USER_CLASSES}
    UNION ALL SELECT user_id, l || '_recall', NULL FROM (SELECT DISTINCT user_id FROM events), range(1, 6) t(l)
    WHERE (user_id, l) NOT IN (SELECT (user_id, label) FROM {_USER_CLASSES})""")
def melt(spark, folder):
    wide_rows = ev.wide_metrics(_user_report(spark, folder), ["user_id"], ["1", "2", "3", "4", "5"])
    return _r6(ev.melt_metrics(wide_rows, "user_id", "recall"), "value")


@query("e14_training_history", f"""
    SELECT model_name, row_number() OVER (PARTITION BY model_name ORDER BY train_examples) AS epoch, round(eval_metric, 6) AS loss, train_time_min AS acc
    FROM ({RUNS_SQL})""")
def history(spark, folder):
    step = F.array_sort(F.collect_list(F.struct("train_examples", "eval_metric", "train_time_min")))
    stored = runs(spark, folder).groupBy("model_name").agg(F.to_json(F.struct(
        F.transform(step, lambda s: s["eval_metric"]).alias("loss"),
        F.transform(step, lambda s: s["train_time_min"]).alias("categorical_accuracy"))).alias("network_history"))
    return _r6(ev.training_history(stored, ["model_name"], "network_history", {"loss": "loss", "categorical_accuracy": "acc"}), "loss")


@query("e15_repair_matrix", f"""
    SELECT user_id, '[[' || a || ',' || b || '],[' || c || ',' || d || ']]' AS confusion_matrix FROM (
      SELECT user_id, count(*) FILTER (truth = 1 AND prediction = 1) AS a, count(*) FILTER (truth = 1 AND prediction <> 1) AS b,
             count(*) FILTER (truth <> 1 AND prediction = 1) AS c, count(*) FILTER (truth <> 1 AND prediction <> 1) AS d
      FROM ({PREDICTIONS_SQL}) GROUP BY user_id)""")
def repair(spark, folder):
    t, p = F.col("truth") == 1, F.col("prediction") == 1
    cells = predictions(spark, folder).groupBy("user_id").agg(F.count_if(t & p).alias("a"), F.count_if(t & ~p).alias("b"),
                                                              F.count_if(~t & p).alias("c"), F.count_if(~t & ~p).alias("d"))
    printed = F.concat(F.lit("[[ "), "a", F.lit("   "), "b", F.lit("]\n [ "), "c", F.lit(" "), "d", F.lit(" ]]"))
    return cells.select("user_id", F.to_json(F.from_json(ev.repair_matrix_text(printed), "array<array<bigint>>")).alias("confusion_matrix"))


@query("e16_failures", f"""
    SELECT model_name, 'failed' AS status, 'run ' || run_id AS message FROM ({RUNS_SQL}) WHERE run_id % 3 = 0""")
def failed(spark, folder):
    rows = runs(spark, folder).select("model_name", F.when(F.col("run_id") % 3 == 0, "failed").otherwise("success").alias("status"),
                                      F.concat(F.lit("run "), "run_id").alias("message"))
    return ev.failures(rows)


def _eight(metric_sql):
    return [f"coalesce(max({m}) FILTER (label = {c}), 0)" for c, m in ev.EXPERIMENTAL_TERMS]


@query("e17_experimental_scores", f"""
    SELECT user_id, round(CASE WHEN {" OR ".join(v + " = 0" for v in _eight(0))} THEN 0 ELSE 8 / ({" + ".join("1 / " + v for v in _eight(0))}) END, 6) AS harmonic,
           round(({" + ".join(_eight(0))}) / 8, 6) AS arithmetic, round(pow({" * ".join(_eight(0))}, CAST(1 AS DOUBLE) / 8), 6) AS geometric
    FROM {_USER_CLASSES} GROUP BY user_id""")
def experimental(spark, folder):
    wide_rows = ev.wide_metrics(_user_report(spark, folder), ["user_id"], ["1", "2", "3", "4", "5"]).na.fill(0.0)
    terms = ev.score_columns(ev.EXPERIMENTAL_TERMS)
    return wide_rows.select("user_id", F.round(ev.harmonic_mean(terms), 6).alias("harmonic"),
                            F.round(ev.arithmetic_mean(terms), 6).alias("arithmetic"), F.round(ev.geometric_mean(terms), 6).alias("geometric"))


@query("e18_stored_matrix", f"""
    SELECT CAST([1, 3, 4, 5, 6][t] AS INTEGER) AS truth, CAST([1, 3, 4, 5, 6][p] AS INTEGER) AS prediction, count(truth) AS n
    FROM (SELECT t, p FROM range(1, 6) a(t), range(1, 6) b(p)) LEFT JOIN ({PREDICTIONS_SQL}) ON truth = t AND prediction = p GROUP BY t, p""")
def stored_matrix(spark, folder):
    stored = ev.confusion_json(predictions(spark, folder), "truth", "prediction", 5)
    return ev.matrix_rows(stored, [], "confusion_matrix", [1, 3, 4, 5, 6])
