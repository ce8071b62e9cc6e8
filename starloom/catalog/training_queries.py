"""Spark ML features, classifiers, search, runs, and streaming scores."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from starloom.catalog.feature_queries import _grams_sql
from starloom.catalog.registry import query, table, texts
from starloom.catalog.sampling_queries import _fraction_sql
from starloom.catalog.text_queries import _WORD_PUNCT_SQL, _normal_sql
from starloom.functions import text as tx
from starloom.operators import features as ft
from starloom.operators import sampling
from starloom.operators import training as tr
from starloom.operators.features import vector_norm
from starloom.operators.word_vectors import SkipGram, train_skipgram
from starloom.plans.session import fresh_path, stage_table
from starloom.plans.sweeps import classifier_job, feature_sweep
from starloom.streaming import scoring

_CLASSES = 4
_FEATURES = 4000

_LABELLED_SQL = "(SELECT doc_id, text, CAST(quality + 2 * toxic + 1 AS INTEGER) AS star_rating FROM documents JOIN labels USING (doc_id))"
_TRAIN_SQL = f"(SELECT * FROM {_LABELLED_SQL} WHERE {_fraction_sql('doc_id')} < 0.75)"
_TEST_SQL = f"(SELECT * FROM {_LABELLED_SQL} WHERE {_fraction_sql('doc_id')} >= 0.75)"


def _labelled(spark, folder):
    """Documents with a class from their quality and toxicity labels (1 to 4, unbalanced)."""
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic") + 1).cast("int").alias("star_rating"))
    return texts(spark, folder, "documents", "doc_id").select("doc_id", "text").join(labels, "doc_id")


def _prepared(spark, folder, features=_FEATURES):
    """Training and test part with TF-IDF vectors; texts are tokenised once, the vocabulary comes from the training part."""
    grams = ft.gram_array("text", 1, 2)
    tokens = stage_table(_labelled(spark, folder).select("doc_id", "star_rating", grams.alias("grams")), "grams")
    train, test = sampling.train_test_split(tokens, "doc_id")
    vocab, rows = stage_table(ft.vocabulary(train, F.col("grams"), max_features=features), "vocabulary"), train.count()

    def vectors(part):
        return ft.tfidf_vectors(part, "doc_id", F.col("grams"), vocab, fitted_rows=rows).drop("grams")

    return tr.training_partitions(stage_table(tr.training_frame(vectors(train), "star_rating"), "train"), rows), stage_table(vectors(test), "test")


def _facts(model, name, train, test, label):
    """Per class of the test part its rows, and whether the model's output holds together.

    Predictions are classes, the probabilities (where a model gives them) are positive and sum to one, and
    the model fits its training rows better than the class shares do: by its accuracy against the
    largest share, or by the mean probability of the true class against the sum of squared shares.
    """
    def scored(part, which):
        out = tr.predict(model, part)
        chances = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
        return out.select(F.lit(which).alias("part"), F.col(label).alias("class"), "prediction", chances.alias("p"))

    rows = stage_table(scored(train, "train").unionByName(scored(test, "test")), "predictions")
    seen = rows.where("part = 'train'")
    shares = seen.groupBy("class").agg(F.count("*").alias("n")).agg(
        F.struct(F.max("n").alias("most"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("squares"))).scalar()
    fit = seen.agg(F.struct(F.count_if(F.col("class") == F.col("prediction")).alias("hits"), F.avg(F.get("p", F.col("class") - 1)).alias("chance"))).scalar()
    total = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p)
    checks = rows.agg(F.struct(F.bool_and(F.col("prediction").between(1, model_classes(model))).alias("in_range"),
                               F.bool_and((F.abs(total - 1) < 1e-6) & (F.array_min("p") >= 0)).alias("proper"))).scalar()
    per_class = rows.where("part = 'test'").groupBy("class").agg(F.count("*").alias("support")).withColumns({"__c": checks, "__s": shares, "__f": fit})
    learned = (F.col("__f.hits") > F.col("__s.most")) | F.coalesce(F.col("__f.chance") > F.col("__s.squares"), F.lit(False))
    return per_class.select(F.lit(name).alias("model"), "class", "support", F.col("__c.in_range").alias("in_range"), learned.alias("learned"),
                            F.col("__c.proper").alias("proper_probabilities"))


def _held_out_facts(model, name, train, test, label):
    """Per class of the test part its rows, and whether the model does better there than without features.

    Held-out accuracy must exceed the largest class share of the test part, and the held-out log-loss stay
    below that of always giving the class shares of the training part.
    """
    shares = train.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("n"))
    shares = shares.agg(F.map_from_entries(F.collect_list(F.struct("__class", "n"))).alias("m"), F.sum("n").alias("n")).select(F.struct("m", "n"))
    out = tr.predict(model, test).select(F.col(label).alias("class"), "prediction", vector_to_array("probability").alias("p")).withColumn("__s", shares.scalar())
    out = stage_table(out.select("class", "prediction", "p", (F.try_element_at("__s.m", F.col("class")) / F.col("__s.n")).alias("share")), "held-out")

    def loss(chance):
        return F.sum(-F.log(F.greatest(chance, F.lit(1e-9))))

    total = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p)
    whole = out.agg(F.struct(F.count_if(F.col("class") == F.col("prediction")).alias("hits"), loss(F.get("p", F.col("class") - 1)).alias("ours"),
                             loss(F.coalesce("share", F.lit(0.0))).alias("plain"), F.bool_and(F.col("prediction").between(1, model_classes(model))).alias("in_range"),
                             F.bool_and((F.abs(total - 1) < 1e-6) & (F.array_min("p") >= 0)).alias("proper"))).scalar()
    most = out.groupBy("class").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    per_class = out.groupBy("class").agg(F.count("*").alias("support")).withColumns({"__w": whole, "__m": most})
    return per_class.select(F.lit(name).alias("model"), "class", "support", F.col("__w.in_range").alias("in_range"), (F.col("__w.hits") > F.col("__m")).alias("beats_majority"),
                            (F.col("__w.ours") < F.col("__w.plain")).alias("beats_shares"), F.col("__w.proper").alias("proper_probabilities"))


def model_classes(model) -> int:
    """Number of classes a fitted model or the last stage of a pipeline knows."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    return len(last.models) if hasattr(last, "models") else last.numClasses


def _evaluated(spark, folder, names, **options):
    train, test = _prepared(spark, folder)
    rows, out = train.count(), None
    for name in names:
        model = tr.make_classifier(name, rows=rows, classes=_CLASSES, **options).fit(train)
        facts = _facts(model, name, train, test, "star_rating")
        out = facts if out is None else out.unionByName(facts)
    return out


def _facts_sql(names, proper="true"):
    return " UNION ALL ".join(f"""SELECT '{n}' AS model, star_rating AS class, count(*) AS support, true AS in_range, true AS learned,
        CAST({proper} AS BOOLEAN) AS proper_probabilities FROM {_TEST_SQL} GROUP BY star_rating""" for n in names)


def _vectors(spark, folder):
    """Embedding rows with the 10 labels as classes 1 to 10."""
    from pyspark.ml.functions import array_to_vector
    rows = table(spark, folder, "embeddings").select("vec_id", (F.col("label") + 1).alias("class"),
                                                     array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    train, test = sampling.train_test_split(rows, "vec_id")
    return tr.training_frame(train, "class"), test


@query("s10_model_roundtrip", f"SELECT doc_id, star_rating, true AS in_range, true AS same_class, true AS same_probabilities FROM {_TEST_SQL}")
def model_roundtrip(spark, folder):
    train, test = _prepared(spark, folder)
    path = fresh_path(spark, "model")
    model = Pipeline(stages=[tr.make_classifier("LR", rows=train.count())]).fit(train)
    model.write().overwrite().save(path)
    saved, read = (tr.predict(m, test).select("doc_id", "star_rating", "prediction", vector_to_array("probability").alias("p")) for m in (model, tr.load_model(path)))
    both = saved.join(read.select("doc_id", F.col("prediction").alias("again"), F.col("p").alias("q")), "doc_id")
    return both.select("doc_id", "star_rating", F.col("prediction").between(1, _CLASSES).alias("in_range"), (F.col("prediction") == F.col("again")).alias("same_class"),
                       (F.col("p") == F.col("q")).alias("same_probabilities"))


_MODEL_GRAMS = _grams_sql(_LABELLED_SQL, "doc_id", 1, 3)


@query("f4_ngram_tfidf_model", f"""
    WITH g AS (SELECT doc_id, term, len(string_split(term, ' ')) AS n FROM {_MODEL_GRAMS}), t AS (SELECT doc_id FROM {_TRAIN_SQL}),
      m AS (SELECT count(*) AS m FROM t),
      v AS (SELECT term, ln((any_value(m) + 1) / CAST(count(DISTINCT doc_id) + 1 AS DOUBLE)) AS idf FROM g JOIN t USING (doc_id), m GROUP BY term
            HAVING count(DISTINCT doc_id) >= greatest(CAST(floor(0.001 * any_value(m)) AS BIGINT), 1))
    SELECT doc_id, CAST((SELECT count(*) FROM v) AS INTEGER) AS features, coalesce(round(sum(idf), 3), 0) AS total FROM {_TEST_SQL} d
    LEFT JOIN (SELECT doc_id, idf FROM g JOIN v USING (term)) USING (doc_id) GROUP BY doc_id""")
def ngram_tfidf(spark, folder):
    train, test = sampling.train_test_split(_labelled(spark, folder), "doc_id")
    model = tr.ngram_tfidf_stages("text", train.count()).fit(train)

    @F.udf("struct<features int, total double>")
    def summary(v):
        return v.size, float(v.values.sum())

    return model.transform(test).select("doc_id", summary("features").alias("s")).select("doc_id", "s.features", F.round("s.total", 3).alias("total"))


_TOPICS = (5, 10, 20)


@query("f5_lda_topics", f"""
    SELECT CAST(k AS INTEGER) AS n_topics, count(*) AS docs, true AS shares_sum_to_one, true AS all_topics_known, true AS better_than_uniform
    FROM documents, (SELECT unnest({list(_TOPICS)}) AS k) GROUP BY k""")
def lda(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", "text")
    vocab = stage_table(ft.vocabulary(docs, ft.gram_array("text"), min_df=2, max_features=_FEATURES), "vocabulary")
    counted, terms = stage_table(ft.count_vectors(docs, "doc_id", ft.gram_array("text"), vocab).select("doc_id", "features"), "counts"), vocab.count()
    out = None
    for topics in _TOPICS:
        model, rows = tr.lda_features(counted, "features", topics)
        better = model.logPerplexity(counted) < math.log(terms)
        total = F.aggregate("topics", F.lit(0.0), lambda acc, p: acc + p)
        # a text without known terms has no topics: all its shares are zero
        part = rows.agg(F.count("*").alias("docs"), F.bool_and((F.abs(total - 1) < 1e-6) | (total == 0)).alias("shares_sum_to_one"),
                        F.bool_and((F.size("topics") == topics) & (F.array_min("topics") >= 0)).alias("all_topics_known")).select(
            F.lit(topics).alias("n_topics"), "*", F.lit(better).alias("better_than_uniform"))
        out = part if out is None else out.unionByName(part)
    return out


def _known_sql(tokens, source="documents", key="doc_id"):
    """Tokens of each text that occur five times or more in all texts."""
    return f"""(SELECT {key}, coalesce(k, 0) AS known_words FROM {source} LEFT JOIN (
        SELECT {key}, count(*) AS k FROM (SELECT {key}, unnest({tokens}) AS w FROM {source}) JOIN (
          SELECT w FROM (SELECT unnest({tokens}) AS w FROM {source}) GROUP BY w HAVING count(*) >= 5) USING (w) GROUP BY {key}) USING ({key}))"""


def _vector_facts(rows, size):
    """Known words per text, and whether the mean vector is there, whole and not zero."""
    norm = F.aggregate("mean_vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return rows.select("doc_id", "known_words", ((F.size("mean_vec") == size) & (norm > 0) & ~F.isnan(norm)).alias("has_vector"))


_LOWER_TOKENS = f"regexp_extract_all(lower(text), '{_WORD_PUNCT_SQL}')"
def _vectors_sql(tokens):
    return f"SELECT doc_id, known_words, CASE WHEN known_words > 1 THEN true END AS has_vector FROM {_known_sql(tokens)}"


@query("f6_word2vec", _vectors_sql(_LOWER_TOKENS))
def word2vec(spark, folder):
    return _vector_facts(tr.word2vec_features(_lower_docs(spark, folder), "doc_id", "text"), 100)


def _subword_sql(tokens):
    """Each token and the runs of 3 to 6 characters of it between its boundary marks."""
    runs = " || ".join(f"list_transform(range(1, length(w) + {4 - n}), lambda i: substring('<' || w || '>', i, {n}))" for n in range(3, 7))
    return f"flatten(list_transform({tokens}, lambda w: [w] || {runs}))"


@query("f7_subword_vectors", _vectors_sql(_subword_sql(_LOWER_TOKENS)))
def subword_vectors(spark, folder):
    return _vector_facts(tr.word2vec_features(_lower_docs(spark, folder), "doc_id", "text", subwords=True), 100)


_WORD_LANGUAGES_SQL = f"""
    counted AS (SELECT w, count(*) AS n FROM (SELECT unnest({_LOWER_TOKENS}) AS w FROM documents) GROUP BY w),
    by_lang AS (SELECT w, lang, count(*) AS n FROM (SELECT lang, unnest({_LOWER_TOKENS}) AS w FROM documents WHERE lang IS NOT NULL) GROUP BY w, lang),
    home AS (SELECT w, max_by(lang, n) AS lang FROM by_lang GROUP BY w HAVING count(*) = 1)"""


def _word_languages(spark, folder):
    """Words that one language alone uses: (word, n occurrences in all documents, lang)."""
    words = _lower_docs(spark, folder, "lang").select("lang", F.explode(tx.word_punct_tokens("text")).alias("word"))
    counts = words.groupBy("word", "lang").agg(F.count("*").alias("n"))
    languages = counts.groupBy("word").agg(F.sum("n").alias("n"), F.count("lang").alias("langs"), F.max("lang").alias("lang"))
    return languages.where("langs = 1").drop("langs")


def _unit(vec):
    return F.transform(vec, lambda x: x / vector_norm(vec))


def _mean_cosines(words, centers):
    """Per language of ``words``: their number, how many have a vector, and their mean cosine with their own and with the other languages' means of ``centers``."""
    means = centers.groupBy("lang").agg(Summarizer.mean(array_to_vector(_unit(F.col("vec")))).alias("m")).select(F.col("lang").alias("other"), vector_to_array("m").alias("m"))
    table = means.agg(F.collect_list(F.struct("other", "m")))  # one row a language
    sides = words.withColumn("u", _unit(F.col("vec"))).withColumn("__m", table.scalar()).select("lang", "vec", "u", F.explode("__m").alias("c"))
    cosine = F.aggregate(F.zip_with("u", "c.m", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    own = F.col("c.other") == F.col("lang")
    return sides.groupBy("lang").agg(F.count_if(own).alias("n_words"), F.count_if(own & F.col("vec").isNotNull()).alias("n_vectors"),
                                     F.avg(F.when(own, cosine)).alias("own"), F.avg(F.when(~own, cosine)).alias("others"))


@query("f6_skipgram_vectors", f"""
    WITH {_WORD_LANGUAGES_SQL}
    SELECT lang, count(*) AS n_words, count(*) AS n_vectors, true AS nearer_own FROM counted JOIN home USING (w) WHERE n >= 5 GROUP BY lang""")
def skipgram_vectors(spark, folder):
    """Words, sub-sampled skip-gram: each language's words lie nearer its own mean than those of others."""
    model = train_skipgram(_lower_docs(spark, folder), "doc_id", tx.word_punct_tokens("text"), SkipGram(high=0))
    words = _word_languages(spark, folder).where("n >= 5")
    placed = stage_table(words.join(model.vectors(words), "word"), "placed")
    return _mean_cosines(placed, placed).select("lang", "n_words", "n_vectors", (F.col("own") > F.col("others")).alias("nearer_own"))


@query("f7_unseen_words", f"""
    WITH {_WORD_LANGUAGES_SQL}
    SELECT lang, count(*) AS n_words, CAST(0 AS BIGINT) AS n_known, true AS nearer_own FROM counted JOIN home USING (w) WHERE n < 5 GROUP BY lang""")
def unseen_words(spark, folder):
    """Words too rare for the vocabulary get their vectors from n-grams, and lie nearer their own language's words than those of others."""
    model = train_skipgram(_lower_docs(spark, folder), "doc_id", tx.word_punct_tokens("text"), SkipGram())
    words = stage_table(_word_languages(spark, folder), "words")
    placed = stage_table(words.join(model.vectors(words), "word"), "placed")
    rare, frequent = placed.where("n < 5"), placed.where("n >= 5")
    known = rare.groupBy("lang").agg(F.count_if("known").alias("n_known"))
    return _mean_cosines(rare, frequent).join(known, "lang").select("lang", "n_words", "n_known", (F.col("own") > F.col("others")).alias("nearer_own"))


def _lower_docs(spark, folder, *columns):
    return texts(spark, folder, "documents", "doc_id").select("doc_id", F.lower("text").alias("text"), *columns)


@query("f12_pca", """
    SELECT CAST(c AS INTEGER) AS component, (SELECT least(count(*), 5000) FROM embeddings) AS n, true AS ordered, true AS uncorrelated, true AS widest
    FROM (SELECT unnest([1, 2, 3]) AS c)""")
def pca(spark, folder):
    vectors = table(spark, folder, "embeddings")
    scores = stage_table(tr.pca_features(vectors, "vec_id", "embedding", 3), "pca")
    spreads = [F.var_pop(f"pc{i}").alias(f"v{i}") for i in (1, 2, 3)]
    mixed = [F.abs(F.corr(f"pc{a}", f"pc{b}")) for a, b in ((1, 2), (1, 3), (2, 3))]
    # no single component of the sampled vectors spreads wider than the first principal one
    axes = vectors.join(scores.select("vec_id"), "vec_id", "left_semi").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.max("v")).scalar()
    row = scores.agg(F.count("*").alias("n"), *spreads, F.greatest(*mixed).alias("mixed")).withColumn("axis", axes)
    facts = [F.struct(F.lit(i).alias("component"), F.col("n"), (F.col(f"v{i}") <= F.col(f"v{max(i - 1, 1)}")).alias("ordered"),
                      (F.col("mixed") < 1e-6).alias("uncorrelated"), (F.col("v1") >= F.col("axis")).alias("widest")) for i in (1, 2, 3)]
    return row.select(F.inline(F.array(*facts)))


_RAW_TOKENS = f"regexp_extract_all(text, '{_WORD_PUNCT_SQL}')"
_ENCODED = {"bow-df2-ngram12": None, "tfidf-df_none-ngram11": None, "word2vec": _RAW_TOKENS, "fasttext": _subword_sql(_RAW_TOKENS)}


def _encoded_sql(name, tokens):
    """Rows of a feature set per class; word vectors leave out texts with fewer than two known words."""
    known = f"WHERE doc_id IN (SELECT doc_id FROM {_known_sql(tokens, _LABELLED_SQL)} WHERE known_words > 1)" if tokens else ""
    return f"""SELECT '{name}' AS description, 'success' AS status, star_rating, CAST(star_rating >= 3 AS INTEGER) AS helpful_product, count(*) AS n
        FROM {_LABELLED_SQL} {known} GROUP BY star_rating"""


@query("f18_feature_sweep", " UNION ALL ".join([*(_encoded_sql(*e) for e in _ENCODED.items()), "SELECT 'broken', 'failed', NULL, NULL, NULL"]))
def features_by_config(spark, folder):
    config = [{"description": "bow-df2-ngram12", "fn_name": "generate_bow_file", "min_df": 2, "max_ngram_range": 2, "max_features": _FEATURES,
               "feature_columns": "text"},
              {"description": "tfidf-df_none-ngram11", "fn_name": "generate_tfidf_file", "max_features": _FEATURES, "feature_columns": "text"},
              {"description": "word2vec", "fn_name": "generate_word2vec_file", "feature_size": 100, "feature_columns": "text"},
              {"description": "fasttext", "fn_name": "generate_fasttext_file", "feature_size": 100, "feature_columns": "text"},
              {"description": "broken", "fn_name": "generate_nothing", "feature_columns": "text"}]
    done = feature_sweep(_labelled(spark, folder), config, "doc_id", "star_rating", fresh_path(spark, "sweep"), parallel=4)
    out = None
    for row in done:
        part = (spark.read.parquet(row["outfile"]).groupBy("star_rating", "helpful_product").agg(F.count("*").alias("n")) if row["status"] == "success"
                else spark.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (("star_rating", "int"), ("helpful_product", "int"), ("n", "long"))]))
        part = part.select(F.lit(row["description"]).alias("description"), F.lit(row["status"]).alias("status"), "star_rating", "helpful_product", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("l1_logistic_regression", _facts_sql(["LR", "LRB"]))
def logistic(spark, folder):
    return _evaluated(spark, folder, ["LR", "LRB"])


@query("l2_decision_tree", _facts_sql(["DT", "DTB"]))
def trees(spark, folder):
    return _evaluated(spark, folder, ["DT", "DTB"], max_depth=30)


@query("l3_random_forest", _facts_sql(["RF"]))
def forest(spark, folder):
    return _evaluated(spark, folder, ["RF"], max_depth=30)


@query("l4_boosted_trees", _facts_sql(["GB"], "NULL"))
def boosted(spark, folder):
    return _evaluated(spark, folder, ["GB"], max_depth=3)


@query("l4_histogram_boosting", f"""
    SELECT 'lGBM' AS model, star_rating AS class, count(*) AS support, true AS in_range, true AS beats_majority, true AS beats_shares, true AS proper_probabilities
    FROM {_TEST_SQL} GROUP BY star_rating""")
def histogram_boosting(spark, folder):
    train, test = _prepared(spark, folder)
    model = tr.make_classifier("lGBM", max_iter=50, max_depth=3).fit(train)
    return _held_out_facts(model, "lGBM", train, test, "star_rating")


_VECTOR_TEST_SQL = f"(SELECT label + 1 AS class FROM embeddings WHERE {_fraction_sql('vec_id')} >= 0.75)"


@query("l5_rbf_machine", f"""
    SELECT 'SVC_RBF' AS model, CAST(class AS INTEGER) AS class, count(*) AS support, true AS in_range, true AS learned, CAST(NULL AS BOOLEAN) AS proper_probabilities
    FROM {_VECTOR_TEST_SQL} GROUP BY class""")
def rbf(spark, folder):
    train, test = _vectors(spark, folder)
    train, rows = stage_table(train, "train"), train.count()
    model = tr.make_classifier("SVC_RBF", rows=rows, classes=10).fit(tr.training_partitions(train, rows))
    return _facts(model, "SVC_RBF", train, test, "class")


@query("l8_fully_connected", _facts_sql(["DNN"]))
def fully_connected(spark, folder):
    train, test = _prepared(spark, folder)
    model = tr.make_classifier("DNN", rows=train.count(), layers=[train.first()["features"].size, 128, 128, _CLASSES]).fit(train)
    return _facts(model, "DNN", train, test, "star_rating")


_PENALTIES = [0.001, 0.01, 0.1]


@query("l9_parameter_search", " UNION ALL ".join(f"""
    SELECT CAST({i} AS INTEGER) AS candidate, '{{"regParam": {v}}}' AS params, true AS score_in_range, true AS one_best, true AS learned""" for i, v in enumerate(_PENALTIES)))
def parameter_search(spark, folder):
    return _search_facts(spark, folder, {"regParam": _PENALTIES}).select("candidate", "params", "score_in_range", "one_best", "learned")


def _search_facts(spark, folder, space, **options):
    train, test = _prepared(spark, folder)
    found, scores = tr.search(spark, tr.make_classifier("LRB", rows=train.count()), train, "doc_id", space, _CLASSES, **options)
    # the model of the best candidate, fitted on all folds, against the share of the largest class
    hits = tr.predict(found.bestModel, test).agg(F.count_if(F.col("star_rating") == F.col("prediction")).alias("hits")).scalar()
    most = test.groupBy("star_rating").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    one_best = scores.agg((F.count_if("best") == 1) & (F.max(F.when(F.col("best"), F.col("score"))) == F.max("score"))).scalar()
    return scores.select("candidate", "params", F.col("score").between(0, 1).alias("score_in_range"), one_best.alias("one_best"), (hits > most).alias("learned"))


_MIXES = [0.0, 0.5, 1.0]


@query("l9_random_search", """
    SELECT CAST(c AS INTEGER) AS candidate, true AS in_space, CAST(1 AS BIGINT) AS times_drawn, true AS score_in_range, true AS one_best, true AS learned
    FROM (SELECT unnest([0, 1, 2, 3]) AS c)""")
def random_search(spark, folder):
    """Four of the nine combinations of penalty and mix, drawn at random without repeats."""
    rows = stage_table(_search_facts(spark, folder, {"regParam": _PENALTIES, "elasticNetParam": _MIXES}, n_iter=4), "candidates")
    drawn = F.from_json("params", "regParam double, elasticNetParam double")
    in_space = drawn["regParam"].isin(_PENALTIES) & drawn["elasticNetParam"].isin(_MIXES)
    times = rows.groupBy("params").agg(F.count("*").alias("times_drawn"))
    return rows.join(times, "params").select("candidate", in_space.alias("in_space"), "times_drawn", "score_in_range", "one_best", "learned")


@query("l10_run_job", f"""
    SELECT 'LRB' AS model_name, 'success' AS status, (SELECT count(*) FROM {_TRAIN_SQL}) AS train_examples, (SELECT count(*) FROM {_TEST_SQL}) AS test_examples,
      (SELECT {" || ',' || ".join(f"count(*) FILTER (star_rating = {c})" for c in range(1, _CLASSES + 1))} FROM {_TEST_SQL}) AS matrix_supports,
      true AS accuracy_of_matrix, true AS score_in_range""")
def run(spark, folder):
    train, test = _prepared(spark, folder)
    report, _ = tr.run_job(spark, "LRB", "text-tfidf", tr.make_classifier("LRB", rows=train.count()), train, test, "doc_id",
                           "star_rating", _CLASSES)
    matrix = F.from_json("confusion_matrix", "array<array<bigint>>")
    sums = F.transform(matrix, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, n: acc + n))
    hits = F.aggregate(F.transform(matrix, lambda r, i: F.get(r, i)), F.lit(0).cast("long"), lambda acc, n: acc + n)
    return report.select("model_name", "status", "train_examples", "test_examples", F.array_join(sums, ",").alias("matrix_supports"),
                         (F.abs(hits / F.col("test_examples") - F.col("accuracy")) < 1e-9).alias("accuracy_of_matrix"), F.col("eval_metric").between(0, 1).alias("score_in_range"))


_JOBS = [("LRB", None), ("KNN", "smote"), ("DT", "random_under_sampling"), ("RN", "nearmiss2"), ("unknown", None)]
_AFTER = {None: "n", "smote": "CASE WHEN n > 1 THEN max(n) OVER () ELSE n END", "random_under_sampling": "min(n) OVER ()", "nearmiss2": "min(n) OVER ()"}


def _job_sql(name, method):
    done = f"""'{name}' AS model_name, {f"'{method}'" if method else "CAST(NULL AS VARCHAR)"} AS sampling"""
    if name == "unknown":
        return f"SELECT {done}, 'failed' AS status, CAST(NULL AS BIGINT) AS test_examples, NULL AS stage, CAST(NULL AS INTEGER) AS star_rating, CAST(NULL AS BIGINT) AS count"
    sizes = f"(SELECT star_rating, count(*) AS n FROM {_TRAIN_SQL} GROUP BY star_rating)"
    return " UNION ALL ".join(f"""SELECT {done}, 'success' AS status, (SELECT count(*) FROM {_TEST_SQL}) AS test_examples, '{stage}' AS stage, star_rating, {n} AS count
        FROM {sizes}""" for stage, n in (("before", "n"), ("after", _AFTER[method])))


@query("l11_classifier_sweep", " UNION ALL ".join(_job_sql(*j) for j in _JOBS))
def classifier_sweep(spark, folder):
    labelled, grams = _labelled(spark, folder), ft.gram_array("text", 1, 2)
    vocab = stage_table(ft.vocabulary(labelled, grams, max_features=_FEATURES), "vocabulary")
    rows = stage_table(ft.tfidf_vectors(labelled, "doc_id", grams, vocab), "features")
    folder_of_models, report = fresh_path(spark, "models"), fresh_path(spark, "report")
    config = [{"model_name": n, "sampling": m, "class_column": "star_rating", "drop_columns": "text", "dtype": "float32", "max_depth": 30, "radius": 1.2} for n, m in _JOBS]
    done = tr.sweep(spark, config, lambda settings: classifier_job(spark, rows, settings, "doc_id", _CLASSES, folder_of_models), report, parallel=4)
    runs, out = {r["description"]: r["test_examples"] for r in spark.read.parquet(report).select("description", "test_examples").collect()}, None  # one row per job
    for d in done:
        name = f"{d['model_name']}-{d['sampling'] or 'sampling_none'}"
        part = (spark.read.parquet(f"{folder_of_models}/{name}-histogram") if d["status"] == "success"
                else spark.range(1).select(F.lit(None).cast("int").alias("star_rating"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("stage")))
        part = part.select(F.lit(d["model_name"]).alias("model_name"), F.lit(d["sampling"]).cast("string").alias("sampling"), F.lit(d["status"]).alias("status"),
                           F.lit(runs.get(name)).cast("long").alias("test_examples"), "stage", "star_rating", "count")
        out = part if out is None else out.unionByName(part)
    return out


def _arithmetic_scorer(df):
    """Deterministic stand-in model: class scores from the word count of the cleaned text."""
    words = F.size(F.split("review", " "))
    return df.withColumn("scores", F.array(*[((words * (7 + c) + c * 13) % 101 / 101.0) for c in range(1, 6)]))


def _reviews(spark, folder):
    """Conversation turns as reviews; some carry an invalid rating."""
    return texts(spark, folder, "conversations", "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("review"),
        ((F.col("conv_id") + F.col("turn")) % 7).cast("int").alias("product_rating"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("received"))


_SCORE_CLEAN = _normal_sql("text", None)
_SCORED_SQL = f"""(SELECT id, text, clean, rating, created, [{", ".join(f"(len(string_split(clean, ' ')) * {7 + c} + {c * 13}) % 101 / 101.0" for c in range(1, 6))}] AS s
    FROM (SELECT conv_id * 1000 + turn AS id, text, {_SCORE_CLEAN} AS clean, CAST((conv_id + turn) % 7 AS INTEGER) AS rating,
                 make_timestamp((1600000000 + conv_id * 1000 + turn) * 1000000) AS created FROM conversations) WHERE rating BETWEEN 1 AND 5)"""


@query("r1_score_reviews", f"""
    SELECT id, md5(text) AS raw, md5(clean) AS preprocessed, rating AS class_expected, CAST(list_position(s, list_max(s)) AS INTEGER) AS class_predicted,
           'SUCCESS' AS status FROM {_SCORED_SQL}""")
def score(spark, folder):
    reviews = _reviews(spark, folder)
    valid, _ = scoring.split_valid(reviews)
    index = ft.sequence_index(reviews, "id", "review")
    rows = scoring.score_reviews(valid, _arithmetic_scorer, "arithmetic", "v1.0", created=F.col("received"), index=index)
    return rows.where(F.col("input_encoded").isNotNull()).select(
        "id", F.md5("input_raw").alias("raw"), F.md5("input_preprocessed").alias("preprocessed"), "class_expected", "class_predicted", "status")


@query("r1_score_with_model", f"SELECT id, rating AS class_expected, true AS in_range, true AS most_likely, true AS proper_probabilities FROM {_SCORED_SQL}")
def score_model(spark, folder):
    train, _ = sampling.train_test_split(_labelled(spark, folder), "doc_id")
    rows = train.count()
    encoder = tr.ngram_tfidf_stages("text", rows).fit(train)
    encoded = stage_table(encoder.transform(tr.training_frame(train, "star_rating")).select("features", "label0", "weight"), "encoded")
    model = PipelineModel([*encoder.stages, tr.make_classifier("LRB", rows=rows).fit(tr.training_partitions(encoded, rows))])
    valid, _ = scoring.split_valid(_reviews(spark, folder))
    renamed = valid.withColumnRenamed("review", "text")
    scored = scoring.score_reviews(renamed, scoring.model_scorer(model), "LRB", "v1.0", text="text", created=F.col("received"))
    chances = F.map_values(F.from_json("class_predicted_raw", "map<string,string>")).cast("array<double>")
    total = F.aggregate(chances, F.lit(0.0), lambda acc, p: acc + p)
    return scored.select("id", "class_expected", F.col("class_predicted").between(1, _CLASSES).alias("in_range"),
                         (F.get(chances, F.col("class_predicted") - 1) == F.array_max(chances)).alias("most_likely"), (F.abs(total - 1) < 1e-6).alias("proper_probabilities"))


@query("r2_stream_log", f"""
    SELECT 'log' AS sink, id, rating AS class_expected, CAST(list_position(s, list_max(s)) AS INTEGER) AS class_predicted FROM {_SCORED_SQL}
    UNION ALL SELECT 'rejected', conv_id * 1000 + turn, CAST((conv_id + turn) % 7 AS INTEGER), NULL FROM conversations WHERE (conv_id + turn) % 7 NOT BETWEEN 1 AND 5""")
def stream_log(spark, folder):
    source, log, rejected = (fresh_path(spark, n) for n in ("incoming", "log", "rejected"))
    reviews = _reviews(spark, folder)
    reviews.write.parquet(source)
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 4).parquet(source)

    def to_log(batch):
        return scoring.score_reviews(batch, _arithmetic_scorer, "arithmetic", "v1.0", created=F.col("received"))

    started = scoring.stream_scores(stream, to_log, log, rejected, fresh_path(spark, "stream-checkpoint"))
    started.awaitTermination()
    logged = spark.read.parquet(log).select(F.lit("log").alias("sink"), "id", "class_expected", "class_predicted")
    return logged.unionByName(spark.read.parquet(rejected).select(
        F.lit("rejected").alias("sink"), "id", F.col("product_rating").alias("class_expected"), F.lit(None).cast("int").alias("class_predicted")))


@query("r3_history", f"""
    SELECT id, created, rating AS class_expected, 'arithmetic' AS model_name FROM {_SCORED_SQL} ORDER BY created DESC, id DESC""")
def history(spark, folder):
    path = fresh_path(spark, "log")
    valid, _ = scoring.split_valid(_reviews(spark, folder))
    rows = scoring.score_reviews(valid, _arithmetic_scorer, "arithmetic", "v1.0", created=F.col("received").cast("timestamp_ntz"))
    scoring.append_log(rows, path)
    return scoring.history(spark, path).select("id", "created", "class_expected", "model_name")


def _compacted(spark, folder):
    """A log that a stream wrote in several batches, compacted twice, with its first batch written again in between."""
    source, log = fresh_path(spark, "incoming"), fresh_path(spark, "log")
    reviews = _reviews(spark, folder)
    reviews.repartition(8, "id").write.parquet(source)
    stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 2).parquet(source)

    def to_log(batch):
        return scoring.score_reviews(batch, _arithmetic_scorer, "arithmetic", "v1.0", created=F.col("received").cast("timestamp_ntz"))

    scoring.stream_scores(stream, to_log, log, fresh_path(spark, "rejected"), fresh_path(spark, "stream-checkpoint")).awaitTermination()
    scoring.compact_log(spark, log)
    again = stage_table(spark.read.parquet(log).where("batch = 0").drop("batch"), "again")
    again.write.mode("overwrite").parquet(f"{log}/batch=0")
    scoring.compact_log(spark, log, whole=True)
    return log


@query("r2_compacted_log", f"""
    SELECT CAST(created AS DATE) AS day, count(*) AS n, count(DISTINCT id) AS n_ids, CAST(sum(rating) AS BIGINT) AS ratings FROM {_SCORED_SQL} GROUP BY 1""")
def compacted_log(spark, folder):
    rows = scoring.compacted_log(spark, _compacted(spark, folder))
    return rows.groupBy(F.to_date("created").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum("class_expected").alias("ratings"))


@query("r3_latest", f"""
    SELECT id, created, rating AS class_expected, 'arithmetic' AS model_name FROM {_SCORED_SQL} ORDER BY created DESC, id DESC LIMIT 200""")
def latest(spark, folder):
    return scoring.latest(spark, _compacted(spark, folder), 200).select("id", "created", "class_expected", "model_name")
