"""Distributions, quantiles, bins and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table, texts
from starloom.catalog.views import PREDICTIONS_SQL, RATED_DOCUMENTS_SQL, RATING_SQL, RUNS_SQL, predictions, rated_documents, rated_events, runs
from starloom.functions import text as tx
from starloom.functions.hashing import key_hash
from starloom.operators import evaluate, inference, stats
from starloom.plans.session import cut_lineage
from starloom.operators import relational as rel

_DECILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def _r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _words(spark, folder):
    return texts(spark, folder, "documents", "doc_id").select("doc_id", "lang", tx.word_count("text").alias("words"))


_WORDS_SQL = "(SELECT doc_id, lang, len(regexp_extract_all(text, '\\S+')) AS words FROM documents)"


@query("a1_group_share", f"""
    SELECT truth, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent
    FROM (SELECT *, {RATING_SQL} AS truth FROM events) GROUP BY truth""")
def group_share(spark, folder):
    return _r6(stats.group_share(rated_events(spark, folder), ["truth"]), "percent")


@query("a2_distinct_ratio", """
    SELECT count(DISTINCT l_partkey) AS distinct_values, count(*) AS total_rows,
           round(count(DISTINCT l_partkey) * 100.0 / count(*)) AS percent FROM lineitem""")
def distinct_ratio(spark, folder):
    return stats.distinct_ratio(table(spark, folder, "lineitem"), "l_partkey")


@query("a3_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_groups(spark, folder):
    return stats.group_sizes(table(spark, folder, "events"), "user_id").orderBy(F.desc("n"), "user_id").limit(20)


@query("a4_size_quantiles", """
    SELECT CAST(d.p AS DOUBLE) AS probability, q[d.i] AS quantile FROM
      (SELECT quantile_cont(n, [0.0, 0.25, 0.75, 1.0]) AS q FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)),
      (SELECT unnest([0.0, 0.25, 0.75, 1.0]) AS p, unnest(range(1, 5)) AS i) d""")
def size_quantiles(spark, folder):
    return stats.exact_quantiles(stats.group_sizes(table(spark, folder, "lineitem"), "l_partkey"), "n", [0.0, 0.25, 0.75, 1.0])


@query("a4_word_count_deciles", f"""
    SELECT round(CAST(d.p AS DOUBLE), 6) AS probability, round(q[d.i], 6) AS quantile FROM
      (SELECT quantile_cont(words, {_DECILES + [0.95, 0.99]}) AS q FROM {_WORDS_SQL}),
      (SELECT unnest({_DECILES + [0.95, 0.99]}) AS p, unnest(range(1, 14)) AS i) d""")
def word_deciles(spark, folder):
    return _r6(stats.exact_quantiles(_words(spark, folder), "words", _DECILES + [0.95, 0.99]), "probability", "quantile")


@query("a4_value_quantiles", """
    SELECT CAST(d.p AS DOUBLE) AS probability, l_returnflag, round(q[d.i], 6) AS quantile FROM
      (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.01, 0.5, 0.999, 1.0]) AS q FROM lineitem GROUP BY l_returnflag),
      (VALUES (1, 0.0), (2, 0.01), (3, 0.5), (4, 0.999), (5, 1.0)) d(i, p)""")
def value_quantiles(spark, folder):
    found = stats.exact_quantiles(table(spark, folder, "lineitem"), "l_extendedprice", [0.0, 0.01, 0.5, 0.999, 1.0], ["l_returnflag"])
    return _r6(found, "quantile")


@query("a7_describe_values", """
    SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
           round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM events GROUP BY event_type""")
def describe_values(spark, folder):
    return _r6(stats.describe(table(spark, folder, "events"), "value", ["event_type"]), "mean", "std", "min", "q25", "q50", "q75", "max")


@query("a4_approximate_quantiles", """
    SELECT CAST(p AS DOUBLE) AS probability, count(*) AS n, true AS a_value_of_the_table, true AS rank_within_error
    FROM lineitem, (SELECT unnest([0.25, 0.5, 0.75]) AS p) GROUP BY p""")
def approximate(spark, folder):
    items = table(spark, folder, "lineitem").select("l_extendedprice")
    found = cut_lineage(stats.approximate_quantiles(items, "l_extendedprice", [0.25, 0.5, 0.75]))
    asked = found.agg(F.collect_list(F.struct("probability", "quantile"))).scalar()  # one entry per probability
    ranked = items.withColumn("q", F.explode(asked)).groupBy("q.probability").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_extendedprice") < F.col("q.quantile")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("q.quantile")).alias("upto"))
    place, slack = F.col("probability") * F.col("n"), F.col("n") / 10000 + 1
    return ranked.select("probability", "n", (F.col("upto") > F.col("below")).alias("a_value_of_the_table"),
                         ((F.col("below") <= place + slack) & (F.col("upto") >= place - slack)).alias("rank_within_error"))


@query("a5_cut_bins", """
    SELECT bin, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 6) AS percent FROM (
      SELECT CASE WHEN l_quantity > 1 AND l_quantity <= 10 THEN '(1, 10]' WHEN l_quantity > 10 AND l_quantity <= 20 THEN '(10, 20]'
                  WHEN l_quantity > 20 AND l_quantity <= 49 THEN '(20, 49]' END AS bin FROM lineitem) GROUP BY bin""")
def cut_bins(spark, folder):
    items = table(spark, folder, "lineitem").select(stats.cut("l_quantity", [1, 10, 20, 49]).alias("bin"))
    return _r6(stats.group_share(items, ["bin"]), "percent")


@query("a5_labelled_bins", """
    SELECT bin, count(*) AS n FROM (
      SELECT CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 100 THEN 'mid'
                  WHEN value > 100 AND value <= 1000 THEN 'high' END AS bin FROM events) GROUP BY bin""")
def labelled_bins(spark, folder):
    return table(spark, folder, "events").groupBy(stats.cut("value", [0, 10, 100, 1000], ["low", "mid", "high"]).alias("bin")).agg(
        F.count("*").alias("n"))


@query("a6_quantile_bins", f"""
    SELECT bin, count(*) AS n, min(words) AS low, max(words) AS high FROM (
      SELECT words, CASE WHEN words > q[1] THEN
          1 + CAST(words > q[2] AS BIGINT) + CAST(words > q[3] AS BIGINT) + CAST(words > q[4] AS BIGINT) END AS bin
      FROM {_WORDS_SQL}, (SELECT quantile_cont(words, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM {_WORDS_SQL})) GROUP BY bin""")
def quantile_bins(spark, folder):
    binned = stats.quantile_bins(_words(spark, folder), "words", [0.0, 0.25, 0.5, 0.75, 1.0])
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("words").alias("low"), F.max("words").alias("high"))


@query("a6_fixed_width_bins", f"SELECT CAST(ceil(words / 100.0) AS BIGINT) AS bin, count(*) AS n FROM {_WORDS_SQL} GROUP BY bin")
def fixed_bins(spark, folder):
    return _words(spark, folder).groupBy(stats.fixed_width_bin("words", 100.0).alias("bin")).agg(F.count("*").alias("n"))


@query("a7_describe", f"""
    SELECT lang, CAST(count(words) AS BIGINT) AS count, round(avg(words), 6) AS mean, round(stddev_samp(words), 6) AS std,
           CAST(min(words) AS DOUBLE) AS min, round(quantile_cont(words, 0.25), 6) AS q25, round(quantile_cont(words, 0.5), 6) AS q50,
           round(quantile_cont(words, 0.75), 6) AS q75, CAST(max(words) AS DOUBLE) AS max FROM {_WORDS_SQL} GROUP BY lang""")
def describe(spark, folder):
    return _r6(stats.describe(_words(spark, folder), "words", ["lang"]), "mean", "std", "q25", "q50", "q75")


@query("a8_date_parts", """
    SELECT 'month' AS part, CAST(month(l_shipdate) AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'weekday', CAST(isodow(l_shipdate) - 1 AS BIGINT), count(*) FROM lineitem GROUP BY 2""")
def date_parts(spark, folder):
    return stats.date_part_counts(table(spark, folder, "lineitem"), "l_shipdate")


@query("a9_vote_shares", """
    SELECT count(*) AS total_rows, count(*) FILTER (total > 0) AS with_votes, count(*) FILTER (helpful > 0) AS with_helpful,
           round(count(*) FILTER (total > 0) / count(*), 2) * 100 AS votes_percent,
           round(count(*) FILTER (helpful > 0) / count(*), 2) * 100 AS helpful_percent,
           round(count(*) FILTER (helpful > 0) / count(*) FILTER (total > 0), 2) * 100 AS helpful_of_voted_percent
    FROM (SELECT CAST(l_quantity AS BIGINT) % 4 AS total, l_linenumber % 3 AS helpful FROM lineitem)""")
def vote_shares(spark, folder):
    items = table(spark, folder, "lineitem").select((F.col("l_quantity").cast("long") % 4).alias("total"),
                                                    (F.col("l_linenumber") % 3).alias("helpful"))
    return stats.vote_shares(items, "helpful", "total")


@query("a10_compare_distributions", f"""
    WITH d AS (SELECT 'full' AS dataset, truth FROM (SELECT *, {RATING_SQL} AS truth FROM events)
      UNION ALL SELECT 'half', truth FROM (SELECT *, {RATING_SQL} AS truth FROM events)
        WHERE (event_id * 1103515245 + 12345) % 2147483648 < 1073741824)
    SELECT dataset, truth, count(*) AS n, round(count(*) * 100.0 / any_value(t), 6) AS percent FROM d
    JOIN (SELECT dataset, count(*) AS t FROM d GROUP BY dataset) USING (dataset) GROUP BY dataset, truth""")
def compare(spark, folder):
    events = rated_events(spark, folder)
    half = events.where(key_hash("event_id") < 1073741824)
    return _r6(stats.compare_distributions({"full": events, "half": half}, ["truth"]), "percent")


@query("a11_extreme_rows", f"""
    SELECT 'longest' AS which, doc_id, lang, words AS measure FROM (SELECT * FROM {_WORDS_SQL} ORDER BY words DESC, doc_id LIMIT 1)
    UNION ALL SELECT 'shortest', doc_id, lang, words FROM (SELECT * FROM {_WORDS_SQL} ORDER BY words, doc_id LIMIT 1)""")
def extremes(spark, folder):
    return stats.extreme_rows(_words(spark, folder), F.col("words"), "doc_id", ["lang"])


_TOKENS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query("a12_word_counts", f"""
    SELECT word, count(*) AS occurrence FROM (SELECT unnest({_TOKENS_SQL}) AS word FROM documents) GROUP BY word""")
def word_counts(spark, folder):
    counts = stats.term_counts(texts(spark, folder, "documents", "doc_id"), tx.count_tokens("text"))
    return counts.orderBy(F.desc("occurrence"), "word")


_PLANTED = "replace(replace(text, ' the ', ' can''t '), ' de ', ' She''d ')"


@query("a13_contraction_counts", f"""
    SELECT contraction, count(*) AS occurrence FROM (SELECT unnest(
        regexp_extract_all(flat, '\\s+([a-z]+''[a-z]{{1,2}})\\s+', 1) || regexp_extract_all(flat, '\\s+([a-z]+''[a-z]{{1,2}})$', 1))
        AS contraction FROM (SELECT lower(regexp_replace({_PLANTED}, '[\\n\\r\\t]', ' ', 'g')) AS flat FROM documents))
    GROUP BY contraction""")
def contraction_counts(spark, folder):
    planted = F.replace(F.replace("text", F.lit(" the "), F.lit(" can't ")), F.lit(" de "), F.lit(" She'd "))
    return stats.term_counts(texts(spark, folder, "documents", "doc_id"), tx.get_contractions(planted), "contraction")


@query("a14_family_scores", f"""
    SELECT model_name, round(avg(eval_metric), 6) AS eval_metric_mean, round(stddev_samp(eval_metric), 6) AS eval_metric_std,
           round(avg(train_time_min), 6) AS train_time_min_mean, round(stddev_samp(train_time_min), 6) AS train_time_min_std
    FROM ({RUNS_SQL}) GROUP BY model_name""")
def family_scores(spark, folder):
    out = stats.mean_and_std(runs(spark, folder), ["model_name"], ["eval_metric", "train_time_min"])
    return _r6(out, *[c for c in out.columns if c != "model_name"])


_COMPONENTS_SQL = """(SELECT vec_id, CAST(i - 1 AS INTEGER) AS feature, CAST(embedding[i] AS DOUBLE) AS x
    FROM embeddings, unnest(generate_series(1, 64)) t(i))"""


@query("a15_feature_std", f"SELECT feature, round(stddev_samp(x), 6) AS std FROM {_COMPONENTS_SQL} GROUP BY feature")
def feature_std(spark, folder):
    return _r6(stats.feature_std(table(spark, folder, "embeddings"), "embedding"), "std")


@query("a15_extreme_features", f"""
    WITH s AS (SELECT feature, round(stddev_samp(x), 9) AS std FROM {_COMPONENTS_SQL} GROUP BY feature)
    SELECT 'min' AS which, round(std, 6) AS std, feature FROM s WHERE std = (SELECT min(std) FROM s)
    UNION ALL SELECT 'max', round(std, 6), feature FROM s WHERE std = (SELECT max(std) FROM s)""")
def extreme_features(spark, folder):
    return _r6(stats.extreme_features(stats.feature_std(table(spark, folder, "embeddings"), "embedding"), "feature"), "std")


@query("a16_correlations", f"""
    SELECT p.feature AS a, q.feature AS b, round(corr(p.x, q.x), 6) AS r FROM {_COMPONENTS_SQL} p JOIN {_COMPONENTS_SQL} q
    ON p.vec_id = q.vec_id AND p.feature < q.feature GROUP BY ALL""")
def correlations(spark, folder):
    return _r6(stats.correlations(table(spark, folder, "embeddings"), "embedding", 64), "r")


@query("a17_t_test", """
    SELECT n_a, n_b, round((mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
           * (CAST(1 AS DOUBLE) / n_a + CAST(1 AS DOUBLE) / n_b)), 6) AS t, CAST(n_a + n_b - 2 AS DOUBLE) AS df FROM (
      SELECT avg(value) FILTER (event_type = 'click') AS mean_a, var_samp(value) FILTER (event_type = 'click') AS var_a,
             count(value) FILTER (event_type = 'click') AS n_a, avg(value) FILTER (event_type = 'view') AS mean_b,
             var_samp(value) FILTER (event_type = 'view') AS var_b, count(value) FILTER (event_type = 'view') AS n_b FROM events)""")
def t_test(spark, folder):
    return _r6(inference.t_test(table(spark, folder, "events"), "event_type", "value", "click", "view"), "t").select(
        "n_a", "n_b", "t", "df")


_POINTS_SQL = f"""(SELECT c AS label, hits / nullif(CAST(predicted AS DOUBLE), 0) AS precision, hits / nullif(CAST(support AS DOUBLE), 0) AS recall,
      2 * hits / CAST(support + predicted AS DOUBLE) AS f1 FROM (
        SELECT c, count(*) FILTER (truth = c AND prediction = c) AS hits, count(*) FILTER (truth = c) AS support, count(*) FILTER (prediction = c) AS predicted
        FROM ({PREDICTIONS_SQL}), (SELECT unnest([1, 2, 3, 4, 5]) AS c) GROUP BY c))"""


@query("a18_bootstrap_interval", f"""
    SELECT CAST(label AS INTEGER) AS label, metric, round(value, 6) AS point, true AS mean_near_point, true AS point_inside, true AS narrow
    FROM (SELECT label, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, f1 FROM {_POINTS_SQL}) UNPIVOT (value FOR metric IN (precision, recall, f1))""")
def bootstrap(spark, folder):
    rows = predictions(spark, folder)
    points = evaluate.classification_report(rows, "truth", "prediction").where(F.col("label").rlike("^[0-9]+$")).select(
        F.col("label").cast("int").alias("label"), "precision", "recall", "f1").unpivot(["label"], ["precision", "recall", "f1"], "metric", "point")
    found = inference.bootstrap_interval(rows, "truth", "prediction", 5).join(points, ["label", "metric"])
    return found.select("label", "metric", F.round("point", 6).alias("point"), (F.abs(F.col("mean") - F.col("point")) < 0.005).alias("mean_near_point"),
                        F.col("point").between(F.col("low"), F.col("high")).alias("point_inside"), (F.col("high") - F.col("low")).between(1e-6, 0.15).alias("narrow"))


@query("a19_permutation_test", f"""
    SELECT round(a - b, 6) AS observed, CAST(10000 AS BIGINT) AS replicates, a - b > 0.1 AS significant FROM (
      SELECT count(*) FILTER (truth = 2 AND other = 2) / CAST(count(*) FILTER (other = 2) AS DOUBLE) AS a,
             count(*) FILTER (truth = 2 AND prediction = 2) / CAST(count(*) FILTER (prediction = 2) AS DOUBLE) AS b
      FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN truth % 5 + 1 ELSE truth END AS other FROM ({PREDICTIONS_SQL})))""")
def permutation(spark, folder):
    rows = predictions(spark, folder).withColumn(
        "other", F.when(F.col("event_id") % 5 == 0, F.col("truth") % 5 + 1).otherwise(F.col("truth")).cast("int"))
    found = inference.permutation_test(rows, "truth", "other", "prediction", 2, 5)
    return found.select(F.round("observed", 6).alias("observed"), "replicates", (F.col("p_value") < 0.01).alias("significant"))


@query("a20_empirical_cdf", """
    SELECT l_quantity, n, round(sum(n) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem), 6) AS cdf
    FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity)""")
def cdf(spark, folder):
    return _r6(stats.empirical_cdf(table(spark, folder, "lineitem"), "l_quantity"), "cdf")


@query("a20_grouped_cdf", """
    SELECT event_type, value, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY value)
           / CAST(sum(n) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS cdf
    FROM (SELECT event_type, floor(value) AS value, count(*) AS n FROM events GROUP BY ALL)""")
def grouped_cdf(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.floor("value").cast("double").alias("value"))
    return _r6(stats.empirical_cdf(events, "value", ["event_type"]), "cdf")


@query("a5_helpful_percentage_bins", """
    SELECT bin, count(*) AS n FROM (SELECT CAST(ceil(round(l_linenumber / total * 10, 9)) AS BIGINT) AS bin FROM (
      SELECT l_linenumber, CAST(l_quantity AS BIGINT) % 12 AS total FROM lineitem) WHERE total > 1) GROUP BY bin""")
def helpful_bins(spark, folder):
    items = table(spark, folder, "lineitem").select("l_linenumber", (F.col("l_quantity").cast("long") % 12).alias("total"))
    voted = rel.vote_features(items, "l_linenumber", "total").where("has_votes")
    return voted.groupBy(F.ceil(F.round(F.col("helpful_percentage") * 10, 9)).alias("bin")).agg(F.count("*").alias("n"))
