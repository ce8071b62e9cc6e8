"""n-grams, vocabularies, TF-IDF, sequences and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, table, texts
from starloom.catalog.merge_queries import _WORD_VECTORS_SQL, _word_vectors
from starloom.catalog.views import RATED_DOCUMENTS_SQL
from starloom.functions import text as tx
from starloom.operators import features as ft
from starloom.operators import joins, stats

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _grams_sql(source, key, low, high):
    """(key, term) rows of all n-grams, through self-joined token positions."""
    base = f"(SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT {key}, {_TOKENS} AS w FROM {source}))"
    parts = []
    for n in range(low, high + 1):
        window = f"WINDOW o AS (PARTITION BY {key} ORDER BY pos)"
        pieces = " || ' ' || ".join(["word", *[f"lead(word, {j}) OVER o" for j in range(1, n)]])
        parts.append(f"SELECT {key}, term FROM (SELECT {key}, {pieces} AS term FROM {base} {window}) WHERE term IS NOT NULL")
    return "(" + " UNION ALL ".join(parts) + ")"


def _vocab_sql(grams, key, k, min_df=1):
    return f"""(SELECT term, tf, df, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (
        SELECT term, count(*) AS tf, count(DISTINCT {key}) AS df FROM {grams} GROUP BY term HAVING count(DISTINCT {key}) >= {min_df}
        ORDER BY tf DESC, term LIMIT {k}))"""


def _docs(spark, folder):
    return texts(spark, folder, "documents", "doc_id").select("doc_id", "text")


def _turns(spark, folder):
    return texts(spark, folder, "conversations", "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")


_TURNS = "(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)"


@query("f1_ngrams", f"SELECT term, count(*) AS n FROM {_grams_sql('documents', 'doc_id', 1, 3)} GROUP BY term")
def ngrams(spark, folder):
    return stats.term_counts(_docs(spark, folder), ft.gram_array("text", 1, 3), "term", "n")


_BOW_GRAMS = _grams_sql("documents", "doc_id", 1, 2)


@query("f2_bag_of_words", f"""
    SELECT doc_id, term, tf, term_id FROM (SELECT doc_id, term, count(*) AS tf FROM {_BOW_GRAMS} GROUP BY ALL) c
    JOIN (SELECT term, term_id FROM {_vocab_sql(_BOW_GRAMS, 'doc_id', 1000, 3)}) USING (term)""")
def bag_of_words(spark, folder):
    docs, grams = _docs(spark, folder), ft.gram_array("text", 1, 2)
    vocab = ft.vocabulary(docs, grams, min_df=3, max_features=1000).cache()
    return ft.bag_of_words(docs, "doc_id", grams, vocab).join(F.broadcast(vocab.select("term", "term_id")), "term_id").select(
        "doc_id", "term", "tf", "term_id")


@query("f2_vocabulary_limits", f"""
    SELECT term, tf, df FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {_grams_sql('documents', 'doc_id', 1, 1)} GROUP BY term)
    WHERE df >= 0.01 * (SELECT count(*) FROM documents) AND df <= 0.4 * (SELECT count(*) FROM documents)""")
def vocabulary_limits(spark, folder):
    vocab = ft.vocabulary(_docs(spark, folder), ft.gram_array("text"), min_df=0.01, max_df=0.4)
    return vocab.select("term", "tf", "df")


_TF_GRAMS = _grams_sql("documents", "doc_id", 1, 3)


@query("f3_tfidf", f"""
    WITH v AS (SELECT term, term_id, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM {_vocab_sql(_TF_GRAMS, 'doc_id', 500)}),
      c AS (SELECT doc_id, term_id, count(*) * any_value(idf) AS raw FROM {_TF_GRAMS} JOIN v USING (term) GROUP BY ALL)
    SELECT doc_id, term_id, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM c""")
def tfidf(spark, folder):
    docs, grams = _docs(spark, folder), ft.gram_array("text", 1, 3)
    vocab = ft.vocabulary(docs, grams, max_features=500, spans=("text", 3)).cache()
    return ft.tfidf(docs, "doc_id", grams, vocab, digits=6, spans=("text", 3))


@query("f8_average_vectors", f"""
    WITH e AS (SELECT word, vec FROM ({_WORD_VECTORS_SQL}) WHERE len(vec) = 64),
      t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+')) AS word FROM documents),
      j AS (SELECT doc_id, vec, count(*) OVER (PARTITION BY doc_id) AS known FROM t JOIN e USING (word))
    SELECT doc_id, known AS known_words, i AS position, round(avg(CAST(vec[i] AS DOUBLE)), 6) AS value FROM j, range(1, 65) d(i)
    WHERE known > 1 GROUP BY ALL""")
def average_vectors(spark, folder):
    docs = _docs(spark, folder).withColumn("text", F.lower("text"))
    vectors = _word_vectors(spark, folder).where(F.size("vec") == 64)
    means = ft.average_vectors(docs, "doc_id", tx.word_punct_tokens("text"), vectors)
    return means.select("doc_id", "known_words", F.posexplode("mean_vec").alias("p", "v")).select(
        "doc_id", "known_words", (F.col("p") + 1).cast("long").alias("position"), F.round("v", 6).alias("value"))


_SEQ = """list_filter(string_split(translate(lower(text), '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 34)), ' '), lambda w: w <> '')"""
_INDEX = f"""(SELECT word, n, row_number() OVER (ORDER BY n DESC, first_turn, first_pos) + 1 AS index FROM (
    SELECT word, count(*) AS n, min(turn_id) AS first_turn, arg_min(pos, (turn_id, pos)) AS first_pos FROM (
      SELECT turn_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT turn_id, {_SEQ} AS w FROM {_TURNS})) GROUP BY word))"""


@query("f9_sequence_index", f"SELECT word, n, index FROM {_INDEX} UNION ALL SELECT '<UNK>', NULL, 1")
def sequence_index(spark, folder):
    return ft.sequence_index(_turns(spark, folder), "turn_id", "text")


def _encoded_sql(length, mode):
    cut = f"s[greatest(len(s) - {length - 1}, 1):len(s)]" if mode == "pre" else f"s[1:{length}]"
    zeros = f"list_resize(CAST([] AS BIGINT[]), CAST(greatest({length} - len(s), 0) AS INTEGER), 0)"
    joined = f"{zeros} || {cut}" if mode == "pre" else f"{cut} || {zeros}"
    return f"""SELECT turn_id, '{mode}' AS mode, array_to_string({joined}, ' ') AS sequence FROM (
        SELECT turn_id, coalesce(list(coalesce(CASE WHEN index < 5000 THEN index END, 1) ORDER BY pos) FILTER (word IS NOT NULL), []) AS s FROM {_TURNS}
        LEFT JOIN (SELECT turn_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT turn_id, {_SEQ} AS w FROM {_TURNS})) USING (turn_id)
        LEFT JOIN {_INDEX} USING (word) GROUP BY turn_id)"""


@query("f10_encode_sequences", f"{_encoded_sql(100, 'pre')} UNION ALL {_encoded_sql(100, 'post')}")
def encode(spark, folder):
    turns = _turns(spark, folder)
    index = ft.sequence_index(turns, "turn_id", "text").cache()
    out = None
    for mode in ("pre", "post"):
        part = ft.encode_sequences(turns, "turn_id", "text", index, 100, mode, num_words=5000).select(
            "turn_id", F.lit(mode).alias("mode"), F.array_join("sequence", " ").alias("sequence"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f11_one_hot", """
    SELECT doc_id, star_rating, array_to_string(list_transform(range(1, 6), lambda c: CAST(c = star_rating AS INTEGER)), ',') AS hot,
           CAST(star_rating AS BIGINT) AS decoded FROM (""" + RATED_DOCUMENTS_SQL + ")")
def one_hot(spark, folder):
    from starloom.catalog.views import rated_documents
    rows = rated_documents(spark, folder).select("doc_id", "star_rating", ft.one_hot("star_rating", 5).alias("hot"))
    return rows.select("doc_id", "star_rating", F.array_join("hot", ",").alias("hot"), ft.arg_max("hot").alias("decoded"))


_SIZES = list(range(1000, 10001, 1000))


def _missing_sql(low, high):
    grams = _grams_sql("documents", "doc_id", low, high)
    return f"""SELECT '{low}-{high}' AS grams, CAST(k AS BIGINT) AS max_features, count(*) FILTER (r IS NULL OR r > k) AS rows_without_features,
        round(count(*) FILTER (r IS NULL OR r > k) / count(*), 6) AS share FROM documents t LEFT JOIN (
          SELECT doc_id, min(rank) AS r FROM {grams} g JOIN (SELECT term, row_number() OVER (ORDER BY tf DESC, term) AS rank FROM (
            SELECT term, count(*) AS tf FROM {grams} GROUP BY term)) USING (term) GROUP BY doc_id) USING (doc_id), (SELECT unnest({_SIZES}) AS k) s
        GROUP BY k"""


@query("f13_missing_by_size", " UNION ALL ".join(_missing_sql(*r) for r in ((1, 1), (2, 2), (3, 3), (1, 3))))
def missing_by_size(spark, folder):
    grams = {f"{n}-{n}": ft.gram_array("text", n, n) for n in (1, 2, 3)}
    return ft.missing_by_size(_docs(spark, folder), "doc_id", grams, _SIZES, unions={"1-3": list(grams)}).withColumn("share", F.round("share", 6))


@query("f14_top_and_bottom_grams", f"""
    WITH v AS {_vocab_sql(_TF_GRAMS, 'doc_id', 1000)} SELECT * FROM (
      SELECT 'top' AS side, term, tf FROM v ORDER BY tf DESC, term LIMIT 20) UNION ALL SELECT * FROM (
      SELECT 'bottom', term, tf FROM v ORDER BY tf, term DESC LIMIT 20)""")
def top_and_bottom(spark, folder):
    vocab = ft.vocabulary(_docs(spark, folder), ft.gram_array("text", 1, 3), max_features=1000, spans=("text", 3)).cache()
    top = vocab.orderBy(F.desc("tf"), "term").limit(20).select(F.lit("top").alias("side"), "term", "tf")
    return top.unionByName(vocab.orderBy("tf", F.desc("term")).limit(20).select(F.lit("bottom").alias("side"), "term", "tf"))


@query("f14_mean_tfidf", f"""
    WITH v AS (SELECT term, term_id, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM {_vocab_sql(_TF_GRAMS, 'doc_id', 500)}),
      c AS (SELECT doc_id, term, count(*) * any_value(idf) AS raw FROM {_TF_GRAMS} JOIN v USING (term) GROUP BY ALL)
    SELECT term, round(sum(tfidf) / (SELECT count(*) FROM documents), 6) AS mean_tfidf FROM (
      SELECT term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS tfidf FROM c) GROUP BY term""")
def mean_tfidf(spark, folder):
    docs, grams = _docs(spark, folder), ft.gram_array("text", 1, 3)
    vocab = ft.vocabulary(docs, grams, max_features=500, spans=("text", 3)).cache()
    means = ft.mean_tfidf(ft.tfidf(docs, "doc_id", grams, vocab, digits=None, spans=("text", 3)), docs.agg(F.count("*")).scalar())
    return means.join(F.broadcast(vocab.select("term", "term_id")), "term_id").select("term", F.round("mean_tfidf", 6).alias("mean_tfidf"))


@query("f15_gram_lengths", f"""
    SELECT CAST(len(string_split(term, ' ')) AS INTEGER) AS words, count(*) AS n, round(count(*) / CAST(10 AS DOUBLE), 6) AS percent
    FROM {_vocab_sql(_TF_GRAMS, 'doc_id', 1000)} GROUP BY 1""")
def gram_lengths(spark, folder):
    vocab = ft.vocabulary(_docs(spark, folder), ft.gram_array("text", 1, 3), max_features=1000, spans=("text", 3))
    return ft.gram_lengths(vocab).withColumn("percent", F.round("percent", 6))


_ROLE_GRAMS = _grams_sql("(SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations)", "turn_id", 3, 3)


@query("f16_featureless_classes", f"""
    WITH c AS (SELECT conv_id * 1000 + turn AS turn_id, role FROM conversations),
      hit AS (SELECT DISTINCT turn_id FROM {_ROLE_GRAMS} WHERE term IN (SELECT term FROM (
        SELECT term, count(*) AS n FROM {_ROLE_GRAMS} GROUP BY term ORDER BY n DESC, term LIMIT 200))),
      m AS (SELECT 'without' AS dataset, role FROM c WHERE turn_id NOT IN (SELECT turn_id FROM hit) UNION ALL SELECT 'original', role FROM c)
    SELECT dataset, role, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / any_value(t), 6) AS percent FROM m
    JOIN (SELECT dataset, count(*) AS t FROM m GROUP BY dataset) USING (dataset) GROUP BY dataset, role""")
def featureless(spark, folder):
    turns = texts(spark, folder, "conversations", "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "role", "text")
    grams = ft.gram_array("text", 3, 3)
    terms = ft.ranked_terms(turns, grams, 200).select("term")
    hit = turns.select("turn_id", F.explode(grams).alias("term")).join(F.broadcast(terms), "term", "left_semi").select("turn_id").distinct()
    without = turns.join(hit, "turn_id", "left_anti")
    return stats.compare_distributions({"original": turns, "without": without}, ["role"]).withColumn("percent", F.round("percent", 6))


_VOCAB = f"(SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS word FROM documents) GROUP BY word)"


@query("f17_random_unknown_vectors", f"""
    SELECT word, e.vec IS NOT NULL AS found, CAST(64 AS INTEGER) AS dim, round(CAST(e.vec[1] AS DOUBLE), 6) AS first FROM {_VOCAB}
    LEFT JOIN (SELECT * FROM ({_WORD_VECTORS_SQL}) WHERE len(vec) = 64) e USING (word)""")
def random_unknown(spark, folder):
    vocab = stats.term_counts(_docs(spark, folder), tx.count_tokens("text"), "word", "n").select("word")
    filled = ft.fill_unknown_vectors(vocab, _word_vectors(spark, folder), 64)
    first = F.when(F.col("found"), F.round(F.get("vec", F.lit(0)).cast("double"), 6))
    return filled.select("word", "found", F.size("vec").alias("dim"), first.alias("first"))


@query("f19_normalized_vectors", f"""
    SELECT found, count(*) AS n, round(min(norm), 4) AS low, round(max(norm), 4) AS high FROM (
      SELECT e.vec IS NOT NULL AS found, CASE WHEN e.vec IS NOT NULL THEN CAST(1 AS DOUBLE) END AS norm FROM {_VOCAB}
      LEFT JOIN (SELECT * FROM ({_WORD_VECTORS_SQL}) WHERE len(vec) = 64) e USING (word)) GROUP BY found""")
def normalized(spark, folder):
    vocab = stats.term_counts(_docs(spark, folder), tx.count_tokens("text"), "word", "n").select("word")
    filled = ft.fill_unknown_vectors(vocab, _word_vectors(spark, folder), 64, normalize=True, match_moments=False)
    norm = F.when(F.col("found"), ft.vector_norm(F.col("vec")))
    return filled.select("found", norm.alias("norm")).groupBy("found").agg(
        F.count("*").alias("n"), F.round(F.min("norm"), 4).alias("low"), F.round(F.max("norm"), 4).alias("high"))
