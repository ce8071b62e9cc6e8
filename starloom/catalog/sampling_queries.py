"""Sampling, splits, re-balancing and neighbour search."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table
from starloom.catalog.views import PREDICTIONS_SQL, RATED_DOCUMENTS_SQL, predictions, rated_documents
from starloom.operators import neighbor_graph, neighbors, sampling
from starloom.plans.session import cut_lineage


def _hash_sql(key, seed=1):
    return f"((({key} + {seed}) % 2147483648) * 1103515245 + 12345) % 2147483648"


def _fraction_sql(key, seed=1):
    return f"{_hash_sql(_hash_sql(key, seed), seed)} / CAST(2147483648 AS DOUBLE)"


_DOCS = "(SELECT doc_id, star_rating, n_chars FROM (" + RATED_DOCUMENTS_SQL + "))"


def _docs(spark, folder):
    return rated_documents(spark, folder).select("doc_id", "star_rating", "n_chars")


@query("m1_systematic_sample", """
    SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS i FROM events) WHERE i % 90 = 0""")
def systematic(spark, folder):
    return sampling.systematic_sample(table(spark, folder, "events"), ["ts", "event_id"], 90).select("event_id", "event_type")


@query("m2_hash_sample", f"SELECT event_id, event_type FROM events WHERE {_fraction_sql('event_id')} < 0.1")
def hash_sample(spark, folder):
    return sampling.hash_sample(table(spark, folder, "events"), "event_id", 0.1).select("event_id", "event_type")


@query("m2_exact_sample", f"SELECT event_id, event_type FROM events ORDER BY {_hash_sql('event_id')}, event_id LIMIT 500")
def exact_sample(spark, folder):
    return sampling.exact_sample(table(spark, folder, "events").select("event_id", "event_type"), "event_id", 500)


@query("m3_random_split", f"""
    SELECT CASE WHEN {_fraction_sql('event_id')} < 0.75 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys
    FROM events GROUP BY 1""")
def split(spark, folder):
    train, test = sampling.train_test_split(table(spark, folder, "events"), "event_id")
    both = train.select(F.lit("train").alias("part"), "event_id").unionByName(test.select(F.lit("test").alias("part"), "event_id"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("event_id").alias("keys"))


@query("m4_stratified_split", f"""
    SELECT doc_id, star_rating, CASE WHEN r <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS part FROM (
      SELECT doc_id, star_rating, row_number() OVER (PARTITION BY star_rating ORDER BY {_hash_sql('doc_id')}, doc_id) AS r,
             count(*) OVER (PARTITION BY star_rating) AS n FROM {_DOCS})""")
def stratified(spark, folder):
    train, test = sampling.stratified_split(_docs(spark, folder), "doc_id", "star_rating", drop="n_chars")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("m5_over_sample", f"""
    SELECT doc_id, star_rating, unnest(range(1, times + 1)) AS copy FROM (
      SELECT doc_id, star_rating, m // n + CAST(r <= m % n AS BIGINT) AS times FROM (
        SELECT doc_id, star_rating, row_number() OVER (PARTITION BY star_rating ORDER BY {_hash_sql('doc_id')}, doc_id) AS r,
               count(*) OVER (PARTITION BY star_rating) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM {_DOCS} GROUP BY star_rating)) AS m
        FROM {_DOCS}))""")
def over(spark, folder):
    return sampling.over_sample(_docs(spark, folder).drop("n_chars"), "doc_id", "star_rating")


@query("m6_under_sample", f"""
    SELECT star_rating, (SELECT min(c) FROM (SELECT count(*) AS c FROM {_DOCS} GROUP BY star_rating)) AS count FROM {_DOCS} GROUP BY star_rating""")
def under(spark, folder):
    return sampling.class_sizes(sampling.under_sample(_docs(spark, folder), "doc_id", "star_rating"), "star_rating")


@query("m7_smote", """
    SELECT label, m - count(*) AS generated, true AS between_parents FROM embeddings, (SELECT max(c) AS m FROM (
      SELECT count(*) AS c FROM embeddings GROUP BY label)) GROUP BY label, m HAVING count(*) < m""")
def smote(spark, folder):
    vectors = table(spark, folder, "embeddings")
    made = sampling.smote(vectors, "vec_id", "label", "embedding")
    first = F.get("embedding", F.lit(0)).cast("double")
    ends = vectors.select("vec_id", first.alias("x"))
    placed = (made.select("id", "neighbor", "label", first.alias("x")).join(ends.toDF("id", "a"), "id").join(ends.toDF("neighbor", "b"), "neighbor"))
    inside = F.col("x").between(F.least("a", "b") - 1e-9, F.greatest("a", "b") + 1e-9)
    return placed.groupBy("label").agg(F.count("*").alias("generated"), F.bool_and(inside).alias("between_parents"))


@query("m7_smote_factors", """
    SELECT label, CAST(round(count(*) * CASE label WHEN 1 THEN 1.66 WHEN 2 THEN 2.0 ELSE 1.9 END) AS BIGINT) - count(*) AS generated
    FROM embeddings WHERE label IN (1, 2, 3) GROUP BY label""")
def smote_factors(spark, folder):
    made = sampling.smote(table(spark, folder, "embeddings"), "vec_id", "label", "embedding", factors={1: 1.66, 2: 2.0, 3: 1.9})
    return made.groupBy("label").agg(F.count("*").alias("generated"))


_VECTORS = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("m9_near_miss", f"""
    WITH small AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n, label LIMIT 1),
      d AS (SELECT q.vec_id, q.label, list_distance(q.v, b.v) AS d FROM {_VECTORS} q JOIN {_VECTORS} b
            ON b.label = (SELECT label FROM small) AND q.label <> b.label),
      m AS (SELECT vec_id, label, avg(d) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC) AS r FROM d) WHERE r <= 3 GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean, vec_id) AS r FROM m)
    SELECT vec_id, label, round(mean, 6) AS mean_distance FROM k WHERE r <= (SELECT n FROM small)
    UNION ALL SELECT vec_id, label, NULL FROM embeddings WHERE label = (SELECT label FROM small)""")
def near_miss(spark, folder):
    kept = sampling.near_miss(table(spark, folder, "embeddings"), "vec_id", "label", "embedding")
    return kept.withColumn("mean_distance", F.round("mean_distance", 6))


@query("m10_class_histograms", f"""
    SELECT 'before' AS stage, star_rating, count(*) AS count FROM {_DOCS} GROUP BY star_rating
    UNION ALL SELECT 'after', star_rating, (SELECT max(c) FROM (SELECT count(*) AS c FROM {_DOCS} GROUP BY star_rating)) FROM {_DOCS} GROUP BY star_rating""")
def histograms(spark, folder):
    docs = _docs(spark, folder)
    return sampling.class_histograms(docs, sampling.over_sample(docs, "doc_id", "star_rating"), "star_rating")


@query("m11_class_weights", f"""
    SELECT doc_id, star_rating, round((SELECT count(*) FROM {_DOCS}) / (CAST(5 AS DOUBLE) * count(*) OVER (PARTITION BY star_rating)), 6) AS weight FROM {_DOCS}""")
def weights(spark, folder):
    return sampling.with_class_weights(_docs(spark, folder).drop("n_chars"), "star_rating").withColumn("weight", F.round("weight", 6))


@query("m12_sample_per_class", f"""
    SELECT event_id, truth, prediction, rank FROM (SELECT event_id, truth, prediction,
      row_number() OVER (PARTITION BY truth ORDER BY {_hash_sql('event_id')}, event_id) AS rank FROM ({PREDICTIONS_SQL}) WHERE truth <> prediction)
    WHERE rank <= 20""")
def per_class(spark, folder):
    wrong = predictions(spark, folder).where("truth <> prediction").select("event_id", "truth", "prediction")
    return sampling.sample_per_class(wrong, "event_id", "truth", 20)


_PAIRS = f"""(SELECT q.vec_id AS id, b.vec_id AS neighbor, b.label, list_distance(q.v, b.v) AS distance
    FROM {_VECTORS} q JOIN {_VECTORS} b ON q.vec_id <> b.vec_id)"""


@query("j9_nearest_neighbors", f"""
    SELECT id, neighbor, label, round(distance, 6) AS distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM {_PAIRS}) WHERE rank <= 5""")
def nearest(spark, folder):
    vectors = table(spark, folder, "embeddings")
    found = neighbors.nearest(vectors, vectors, "vec_id", "embedding", 5, label="label", exclude_self=True)
    return found.withColumn("distance", F.round("distance", 6))


@query("j9_approximate_neighbors", "SELECT count(*) AS queries, CAST(5 AS BIGINT) AS neighbors_each, true AS recall_reached FROM embeddings")
def approximate_neighbors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    exact = neighbors.nearest(vectors, vectors, "vec_id", "embedding", 5, exclude_self=True).select("id", "neighbor")
    found = cut_lineage(neighbor_graph.graph_nearest(vectors, "vec_id", "embedding", 5).select("id", "neighbor"))
    shared = found.join(exact, ["id", "neighbor"], "left_semi").agg(F.count("*")).scalar()
    per_query = found.groupBy("id").agg(F.count("*").alias("n")).agg(F.count("*").alias("queries"), F.min("n").alias("neighbors_each"), F.sum("n").alias("all"))
    return per_query.select("queries", "neighbors_each", (shared / F.col("all") >= 0.95).alias("recall_reached"))


@query("j9_radius_neighbors", f"SELECT id, label, count(*) AS n FROM {_PAIRS} WHERE distance <= 1.2 GROUP BY id, label")
def in_radius(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbors.radius_votes(vectors, vectors, "vec_id", "embedding", 1.2, "label", exclude_self=True)


@query("l6_knn_classify", f"""
    SELECT id, label AS prediction FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM (
      SELECT id, label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS k FROM {_PAIRS})
      WHERE k <= 5 GROUP BY id, label)) WHERE r = 1""")
def knn(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbors.knn_classify(vectors, vectors, "vec_id", "embedding", "label", 5, exclude_self=True)


# About 1 in 100 neighbours may be another one than the exact search finds, which seldom moves a majority.
@query("l6_graph_classify", "SELECT count(*) AS queries, true AS agrees FROM embeddings")
def graph_classify(spark, folder):
    vectors = table(spark, folder, "embeddings")
    both = [neighbors.knn_classify(vectors, vectors, "vec_id", "embedding", "label", 5, exclude_self=True, graph=g) for g in (False, True)]
    same = both[0].join(both[1].withColumnRenamed("prediction", "__p"), "id")
    return same.agg(F.count("*").alias("queries"), (F.avg((F.col("prediction") == F.col("__p")).cast("double")) >= 0.95).alias("agrees"))


@query("m7_smote_graph", """
    SELECT label, m - count(*) AS generated, true AS near_parents FROM embeddings, (SELECT max(c) AS m FROM (
      SELECT count(*) AS c FROM embeddings GROUP BY label)) GROUP BY label, m HAVING count(*) < m""")
def smote_graph(spark, folder):
    vectors = table(spark, folder, "embeddings")
    made = cut_lineage(sampling.smote(vectors, "vec_id", "label", "embedding", graph=True))
    exact = neighbors.nearest(vectors, vectors, "vec_id", "embedding", 5, group="label", exclude_self=True).select("id", "neighbor", F.lit(1).alias("__near"))
    seen = made.join(exact, ["id", "neighbor"], "left")
    return seen.groupBy("label").agg(F.count("*").alias("generated"), (F.avg(F.coalesce("__near", F.lit(0))) >= 0.9).alias("near_parents"))


@query("l7_radius_classify", f"""
    SELECT vec_id AS id, p.label AS prediction FROM embeddings LEFT JOIN (
      SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM (
        SELECT id, label, count(*) AS n FROM {_PAIRS} WHERE distance <= 1.2 GROUP BY id, label)) p ON p.id = vec_id AND r = 1""")
def radius(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return neighbors.radius_classify(vectors, vectors, "vec_id", "embedding", "label", 1.2, exclude_self=True)


# Classes 3 to 9 are merged into one majority class.
@query("m8_adasyn", f"""
    WITH e AS (SELECT vec_id, least(label, 3) AS label, v FROM {_VECTORS}),
      c AS (SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY label)) - count(*) AS quota FROM e GROUP BY label),
      r AS (SELECT id, q AS label, avg(CAST(q <> b AS INTEGER)) AS ratio FROM (
        SELECT x.vec_id AS id, x.label AS q, y.label AS b, row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.v, y.v), y.vec_id) AS k
        FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE x.label < 3) WHERE k <= 5 GROUP BY id, q),
      t AS (SELECT id, label, CAST(round_even(ratio / sum(ratio) OVER (PARTITION BY label) * quota, 0) AS BIGINT) AS times FROM r JOIN c USING (label))
    SELECT label, CAST(sum(times) AS BIGINT) AS generated, count(*) FILTER (times > 0) AS parents FROM t GROUP BY label""")
def adasyn(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("label", F.least("label", F.lit(3)))
    made = sampling.adasyn(vectors, "vec_id", "label", "embedding")
    return made.groupBy("label").agg(F.count("*").alias("generated"), F.countDistinct("id").alias("parents"))
