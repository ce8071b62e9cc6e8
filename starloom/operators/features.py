"""n-gram vocabularies, bag-of-words, TF-IDF, sequence encoding and word-vector features.

Long tables (key, term_id, value) are the relational form; the ``*_vectors`` functions give the
same numbers as one sparse vector column per row without any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.plans.ranking import number_rows, top_rows
from starloom.plans.session import cut_lineage
from starloom.plans.sizing import lookup_join, materialized

# Fixed value: characters the sequence tokeniser turns into blanks.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

MODEL_TERMS = 1_000_000
#: Words that may be named in a plan.
NAMED_WORDS = 5000


def gram_array(text: Column | str, low: int = 1, high: int = 1, among: list[str] | None = None) -> Column:
    """Bag-of-words tokens of a text as n-grams, of the words ``among`` only where these are given."""
    if among is not None:
        return tx.ngrams(tx.count_tokens(text), low, high, among)
    return tx.ngrams(tx.count_tokens(text), low, high) if (low, high) != (1, 1) else tx.count_tokens(text)


def term_statistics(df: DataFrame, grams: Column) -> DataFrame:
    """Corpus frequency (tf) and document frequency (df) of every term in one shuffle.

    Each text contributes its terms once with tf 1 and its distinct terms with df 1; both are
    summed map-side before the shuffle, so frequent terms stay small.
    """
    rows = df.select(grams.alias("__g")).select(F.inline(F.concat(
        F.transform("__g", lambda g: F.struct(g.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("__g"), lambda g: F.struct(g.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))))
    return rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(df: DataFrame, grams: Column, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None,
               spans: tuple[Column | str, int] | None = None) -> DataFrame:
    """Terms within the document-frequency limits, the most frequent ones when limited.

    Integer limits are counts and float limits shares of the rows. Ties at the cut go to the
    alphabetically smaller term; term ids follow the alphabetical order of the kept terms.

    ``spans`` says that ``grams`` are the n-grams of 1 to so many words of a text. A limited vocabulary then counts words
    first: no n-gram is met more often than any of its words, so only those of words met at least as often as the
    last word of a vocabulary of words alone can enter.
    """
    if spans is None or max_features is None:
        return _limited(term_statistics(df, grams), df, min_df, max_df, max_features)
    text, high = spans
    words = cut_lineage(term_statistics(df, gram_array(text)))
    least = _within(words, df, min_df, max_df).orderBy(F.desc("tf")).limit(max_features).agg(F.count("*"), F.min("tf")).first()
    among = words.where(F.col("tf") >= least[1]).select("term").limit(NAMED_WORDS + 1).collect() if least[0] == max_features else None
    if among is None or len(among) > NAMED_WORDS:
        return _limited(term_statistics(df, grams), df, min_df, max_df, max_features)
    longer = term_statistics(df, gram_array(text, 2, high, [r["term"] for r in among]))
    return _limited(words.unionByName(longer), df, min_df, max_df, max_features)


def _within(terms: DataFrame, df: DataFrame, min_df: float, max_df: float) -> DataFrame:
    """Terms within the document-frequency limits."""
    if isinstance(min_df, float) or (isinstance(max_df, float) and max_df != 1.0):
        rows = df.agg(F.count("*")).scalar()
        low = F.lit(min_df) * rows if isinstance(min_df, float) else F.lit(min_df)
        high = F.lit(max_df) * rows if isinstance(max_df, float) else F.lit(max_df)
        terms = terms.where((F.col("df") >= low) & (F.col("df") <= high))
    else:
        if min_df > 1:
            terms = terms.where(F.col("df") >= min_df)
        if not isinstance(max_df, float):
            terms = terms.where(F.col("df") <= max_df)
    return terms


def _limited(terms: DataFrame, df: DataFrame, min_df: float, max_df: float, max_features: int | None) -> DataFrame:
    terms = _within(terms, df, min_df, max_df)
    if max_features is None:
        return number_rows(terms, ["term"], "term_id", start=0)
    kept = terms.orderBy(F.desc("tf"), "term").limit(max_features)
    return kept.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


def bag_of_words(df: DataFrame, key: str, grams: Column, vocab: DataFrame) -> DataFrame:
    """Counts (key, term_id, tf) of vocabulary terms."""
    terms = df.select(key, F.explode(grams).alias("term"))
    return lookup_join(terms, vocab.select("term", "term_id"), ["term"]).groupBy(key, "term_id").agg(F.count("*").alias("tf"))


def smooth_idf(vocab: DataFrame, rows: Column) -> DataFrame:
    """Vocabulary with idf = ln((1 + n) / (1 + df)) + 1."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + rows) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf(df: DataFrame, key: str, grams: Column, vocab: DataFrame, digits: int | None = 2, rows: Column | None = None,
          spans: tuple[Column | str, int] | None = None) -> DataFrame:
    """TF-IDF with smoothed idf and unit row length, rounded like the stored feature files.

    ``rows`` is the number of rows behind the vocabulary's document frequencies (those of ``df`` by default). ``spans``
    says that ``grams`` are the n-grams of 1 to so many words of a text; only those of the vocabulary's words are then built.
    """
    if spans is not None:
        vocab = materialized(vocab)
        words = vocab.select(F.explode(F.split("term", " ")).alias("word")).distinct().limit(NAMED_WORDS + 1).collect()
        if len(words) <= NAMED_WORDS:
            grams = gram_array(spans[0], 1, spans[1], [r["word"] for r in words])
    rows = df.agg(F.count("*")).scalar() if rows is None else rows
    weighted = smooth_idf(vocab, rows).select("term", "term_id", "idf")
    terms = df.select(key, F.explode(grams).alias("term"))
    cells = lookup_join(terms, weighted, ["term"]).groupBy(key, "term_id").agg((F.count("*") * F.first("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    value = F.col("raw") / norm
    return cells.select(key, "term_id", (F.round(value, digits) if digits is not None else value).alias("tfidf"))


def count_vectors(df: DataFrame, key: str, grams: Column, vocab: DataFrame, output: str = "features", max_terms: int = MODEL_TERMS) -> DataFrame:
    """Bag-of-words as sparse vectors.

    A vocabulary of at most ``max_terms`` goes to every task as a model: one projection, no shuffle.
    A larger one stays distributed: the long form is grouped by ``key`` (unique, not null).
    """
    vocab = materialized(vocab)
    size = vocab.count()
    if size > max_terms:
        return _gathered(df, key, bag_of_words(df, key, grams, vocab), "tf", size, output)
    model = CountVectorizerModel.from_vocabulary([r["term"] for r in _ordered(vocab)], inputCol="__grams", outputCol=output)
    return model.transform(df.withColumn("__grams", grams)).drop("__grams")


def _ordered(vocab: DataFrame) -> list:
    """Rows in id order of a vocabulary whose size has been checked."""
    return vocab.orderBy("term_id").select("term", "df").collect()


def _gathered(df: DataFrame, key: str, cells: DataFrame, value: str, size: int, output: str) -> DataFrame:
    """``df`` with one sparse vector per row from its (key, term_id, value) cells."""
    @F.udf(VectorUDT())
    def sparse(cells):
        return Vectors.sparse(size, [(c["term_id"], c["v"]) for c in cells or []])

    rows = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_id", F.col(value).cast("double").alias("v")))).alias("__cells"))
    return df.join(rows, key, "left").withColumn(output, sparse("__cells")).drop("__cells")


def tfidf_vectors(df: DataFrame, key: str, grams: Column, vocab: DataFrame, output: str = "features", max_terms: int = MODEL_TERMS,
                  fitted_rows: int | None = None) -> DataFrame:
    """TF-IDF (smoothed idf, unit length) as sparse vectors, planned like ``count_vectors``.

    ``fitted_rows`` is the number of rows the vocabulary comes from, when that is not ``df``.
    """
    rows = df.count() if fitted_rows is None else fitted_rows
    vocab = materialized(vocab)
    size = vocab.count()
    if size > max_terms:
        return _gathered(df, key, tfidf(df, key, grams, vocab, None, F.lit(rows)), "tfidf", size, output)
    idf = [math.log((1 + rows) / (1 + r["df"])) + 1 for r in _ordered(vocab)]
    counted = count_vectors(df, key, grams, vocab, "__tf", max_terms)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__scaled").transform(counted)
    return Normalizer(p=2.0, inputCol="__scaled", outputCol=output).transform(scaled).drop("__tf", "__scaled")


# -- profiling of n-gram vocabularies ----------------------------------------------------------

def ranked_terms(df: DataFrame, grams: Column, limit: int) -> DataFrame:
    """The ``limit`` most frequent terms with their rank (1 = most frequent)."""
    return top_rows(term_statistics(df, grams), [F.desc("tf"), "term"], limit, "rank")


def missing_by_size(df: DataFrame, key: str, grams: Mapping[str, Column], sizes: Sequence[int], unions: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows without any feature for every vocabulary size and every kind of n-gram.

    ``unions`` names further vocabularies, each over several kinds whose terms differ. Terms are
    counted map-side and only their sums shuffled; the most frequent ones reach the rows as a
    measured lookup, and a row's best rank answers all sizes.
    """
    def named(kind: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("grams"), t.alias("term")))

    names = {kind: [kind] for kind in grams} | dict(unions or {})
    cells = df.select(key, F.inline(F.concat(*[named(kind, terms) for kind, terms in grams.items()])))
    terms = cut_lineage(cells.groupBy("grams", "term").agg(F.count("*").alias("tf")))
    ranks = reduce(DataFrame.unionByName, [
        top_rows(terms.where(F.col("grams").isin(*kinds)), [F.desc("tf"), "term", "grams"], max(sizes)).select("grams", "term", F.lit(name).alias("name"), "rank")
        for name, kinds in names.items()])
    best = lookup_join(cells, ranks, ["grams", "term"]).groupBy(key).agg(*[F.min(F.when(F.col("name") == name, F.col("rank"))).alias(f"__{i}") for i, name in enumerate(names)])
    found = best.agg(*[F.count_if(F.col(f"__{i}") <= s).alias(f"__{i}_{s}") for i in range(len(names)) for s in sizes]).withColumn("__total", df.agg(F.count("*")).scalar())
    missing = [(F.lit(name).alias("grams"), F.lit(s).cast("long").alias("max_features"), (F.col("__total") - F.col(f"__{i}_{s}")).alias("rows_without_features")) for i, name in enumerate(names) for s in sizes]
    return found.select(F.inline(F.array(*[F.struct(name, size, count, (count / F.col("__total")).alias("share")) for name, size, count in missing])))


def gram_lengths(terms: DataFrame) -> DataFrame:
    """How many vocabulary entries are unigrams, bigrams, ... and their percentage."""
    from starloom.operators.stats import group_share
    return group_share(terms.select(F.size(F.split("term", " ")).alias("words")), ["words"])


def mean_tfidf(cells: DataFrame, rows: Column) -> DataFrame:
    """Mean TF-IDF per term over all rows; rows without the term count as zero."""
    return cells.groupBy("term_id").agg((F.sum("tfidf") / rows).alias("mean_tfidf"))


# -- sequences ---------------------------------------------------------------------------------

def sequence_tokens(text: Column | str) -> Column:
    """Lower-cased words after turning punctuation into blanks; other characters stay."""
    source = F.lower(F.col(text) if isinstance(text, str) else text)
    blanked = F.translate(source, SEQUENCE_FILTERS, " " * len(SEQUENCE_FILTERS))
    return F.filter(F.split(blanked, " "), lambda w: w != "")


def sequence_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """Word index: 1 is the unknown word, then by falling frequency, ties by first appearance."""
    words = df.select(F.col(key).alias("__k"), F.posexplode(sequence_tokens(text)).alias("__p", "word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("__k", "__p")).alias("first_seen"))
    index = number_rows(counted, [F.desc("n"), "first_seen"], "index", start=2).select("word", "n", "index")
    unknown = df.sparkSession.range(1).select(F.lit("<UNK>").alias("word"), F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("index"))
    return unknown.unionByName(index)


def pad(sequence: Column | str, length: int, padding: str = "pre", truncating: str = "pre") -> Column:
    """Fixed-length id sequence; cut and filled with zeros at the front ('pre') or back ('post')."""
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    size = F.size(sequence)
    start = F.greatest(size - F.lit(length) + 1, F.lit(1)) if truncating == "pre" else F.lit(1)
    cut = F.slice(sequence, start, F.lit(length))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - size, F.lit(0)))
    return F.concat(zeros, cut) if padding == "pre" else F.concat(cut, zeros)


def encode_sequences(df: DataFrame, key: str, text: str, index: DataFrame, length: int, mode: str = "pre",
                     num_words: int | None = None) -> DataFrame:
    """Texts as padded id sequences; unknown words become 1. Training pads 'pre', serving 'post'.

    No word is left out, so texts are cut to the length before their words are looked up. Rows of one
    key are one text; ``key`` must be unique.
    """
    tokens = F.col("__tokens")
    kept = F.slice(tokens, F.greatest(F.size(tokens) - F.lit(length) + 1, F.lit(1)) if mode == "pre" else F.lit(1), F.lit(length))
    words = df.select(key, sequence_tokens(text).alias("__tokens")).select(key, F.posexplode_outer(kept).alias("__p", "word"))
    known = index.select("word", F.col("index").alias("__id"))
    if num_words is not None:
        known = known.where(F.col("__id") < num_words)
    placed = F.when(F.col("word").isNotNull(), F.struct("__p", F.coalesce("__id", F.lit(1).cast("long")).alias("id")))
    coded = lookup_join(words, known, ["word"], "left").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(placed)), lambda s: s["id"]).alias("__s"))
    return coded.select(key, pad("__s", length, mode, mode).alias("sequence"))


def one_hot(label: Column | str, classes: int) -> Column:
    """Indicator array of a 1-based label."""
    value = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda c: (c == value).cast("int"))


def arg_max(scores: Column | str) -> Column:
    """1-based position of the largest score (first on ties)."""
    array = F.col(scores) if isinstance(scores, str) else scores
    return F.array_position(array, F.array_max(array))


# -- word vectors ------------------------------------------------------------------------------

def average_vectors(df: DataFrame, key: str, words: Column, vectors: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    """Mean vector of the known words of each text; null with fewer than two known words.

    All vectors must have one length. Each place is summed on its own: such sums stay in the map-side hash table,
    while those of whole vectors sort the vectors of all words on disk.
    """
    known = cut_lineage(vectors.select(word, F.col(vec).cast("array<double>").alias("__v")))
    low, high = known.agg(F.min(F.size("__v")), F.max(F.size("__v"))).first()
    if low != high:
        raise ValueError(f"word vectors of {low} to {high} numbers")
    joined = lookup_join(df.select(key, F.explode(words).alias(word)), known, [word], computed=True)
    sums = joined.groupBy(key).agg(F.count("*").alias("known_words"), *[F.sum(F.get("__v", F.lit(i))).alias(f"__{i}") for i in range(high or 0)])
    mean = F.array(*[F.col(f"__{i}") / F.col("known_words") for i in range(high or 0)]).cast("array<double>")
    return df.select(key).join(sums.select(key, "known_words", mean.alias("__mean")), key, "left").select(
        key, F.coalesce("known_words", F.lit(0)).alias("known_words"), F.when(F.col("known_words") > 1, F.col("__mean")).alias("mean_vec"))


def vector_norm(vec: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def hashed_normal(word: Column, dim: int, mean: Column, std: Column, seed: int = 1) -> Column:
    """Normal random vector that depends only on the word, so a re-run task repeats it."""
    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(word, i, F.lit(seed + salt)), F.lit(2**31 - 1)) + 1) / F.lit(2.0**31)

    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (
        mean + std * F.sqrt(F.lit(-2.0) * F.log(uniform(i, 0))) * F.cos(F.lit(2 * math.pi) * uniform(i, 7919))).cast("float"))


def fill_unknown_vectors(vocab: DataFrame, embeddings: DataFrame, dim: int, word: str = "word", vec: str = "vec",
                         normalize: bool = False, match_moments: bool = True, seed: int = 1) -> DataFrame:
    """Vocabulary with known vectors (optionally scaled to unit length) and random ones elsewhere.

    Random vectors follow the mean and deviation of all embedding values, or the standard
    normal distribution.
    """
    known = embeddings.where(F.size(vec) == dim)
    if match_moments:
        values = known.select(F.explode(vec).alias("x")).agg(
            F.struct(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).alias("moments"))
        vocab = vocab.withColumn("__moments", values.scalar())
        mean, std = F.col("__moments.m"), F.col("__moments.s")
    else:
        mean, std = F.lit(0.0), F.lit(1.0)
    usable = known.select(word, F.col(vec).alias("__vec"))
    if normalize:
        usable = usable.withColumn("__norm", vector_norm(F.col("__vec"))).select(word, F.when(F.col("__norm") > 0, F.transform(
            "__vec", lambda x: (x / F.col("__norm")).cast("float"))).otherwise(F.col("__vec")).alias("__vec"))
    return vocab.join(usable, word, "left").select(
        *[c for c in vocab.columns if c != "__moments"], F.col("__vec").isNotNull().alias("found"),
        F.when(F.col("__vec").isNotNull(), F.col("__vec")).otherwise(hashed_normal(F.col(word), dim, mean, std, seed)).alias(vec))
