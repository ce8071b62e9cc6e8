import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.operators import features as ft
from starloom.operators import training as tr

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "zz", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").cache()


def test_vocabulary_limits(docs):
    grams = ft.gram_array("t", 1, 2)
    vocab = {r.term: (r.tf, r.df, r.term_id) for r in ft.vocabulary(docs, grams, max_features=4).collect()}
    assert vocab == {"cat": (2, 2, 0), "dog": (2, 2, 1), "sat": (2, 2, 2), "the": (3, 2, 3)}
    assert {r.term for r in ft.vocabulary(docs, grams, min_df=2).collect()} == {"the", "cat", "sat", "dog"}
    assert {r.term for r in ft.vocabulary(docs, grams, min_df=0.4, max_df=0.5).collect()} == {"the", "cat", "sat", "dog"}


def test_tfidf_long_and_vector_forms_agree(docs):
    grams = ft.gram_array("t", 1, 3)
    vocab = ft.vocabulary(docs, grams, max_features=12).cache()
    wide = ft.tfidf_vectors(docs, "id", grams, vocab).select("id", F.posexplode(vector_to_array("features")).alias("term_id", "v")).where("v > 0")
    long = ft.tfidf(docs, "id", grams, vocab, digits=None)
    assert {(r.id, r.term_id): r.tfidf for r in long.collect()} == pytest.approx({(r.id, r.term_id): r.v for r in wide.collect()})
    norms = long.groupBy("id").agg(F.sum(F.col("tfidf") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0) for r in norms)
    counted = ft.count_vectors(docs, "id", grams, vocab).select("id", F.posexplode(vector_to_array("features")).alias("term_id", "v")).where("v > 0")
    bag = ft.bag_of_words(docs, "id", grams, vocab)
    assert {(r.id, r.term_id): r.tf for r in bag.collect()} == {(r.id, r.term_id): r.v for r in counted.collect()}


def test_tfidf_formula(docs):
    vocab = ft.vocabulary(docs, ft.gram_array("t"))
    ids = {r.term: (r.term_id, r.df) for r in vocab.collect()}
    got = {(r.id, r.term_id): r.tfidf for r in ft.tfidf(docs, "id", ft.gram_array("t"), vocab, digits=2).collect()}
    raw = {w: TEXTS[1].split().count(w) * (np.log((1 + 5) / (1 + ids[w][1])) + 1) for w in ("the", "dog", "sat")}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    for w, v in raw.items():
        assert got[(1, ids[w][0])] == pytest.approx(round(v / norm, 2))


def test_missing_by_size(docs):
    rows = {r.max_features: r.rows_without_features for r in ft.missing_by_size(docs, "id", {"one": ft.gram_array("t")}, [1, 3, 100]).collect()}
    assert rows == {1: 3, 3: 2, 100: 1}


def test_vocabulary_beyond_a_model_gives_the_same_vectors(docs):
    grams = ft.gram_array("t", 1, 2)
    vocab = ft.vocabulary(docs, grams).cache()
    for build in (ft.count_vectors, ft.tfidf_vectors):
        small, large = ({r.id: r.features.toArray().tolist() for r in build(docs, "id", grams, vocab, max_terms=m).collect()} for m in (1000, 3))
        assert small.keys() == large.keys() == set(range(5))
        assert all(small[i] == pytest.approx(large[i]) for i in small)


def test_sequences(spark, docs):
    index = ft.sequence_index(docs, "id", "t").cache()
    assert [r.word for r in index.orderBy("index").limit(6).collect()] == ["<UNK>", "the", "cat", "sat", "dog", "a"]
    other = spark.createDataFrame([(1, "The cat, unseen dog!"), (2, None), (3, "the " * 7)], "id int, t string")
    pre = {r.id: r.sequence for r in ft.encode_sequences(other, "id", "t", index, 5).collect()}
    post = {r.id: r.sequence for r in ft.encode_sequences(other, "id", "t", index, 5, mode="post", num_words=4).collect()}
    assert pre == {1: [0, 2, 3, 1, 5], 2: [0] * 5, 3: [2] * 5}
    assert post == {1: [2, 3, 1, 1, 0], 2: [0] * 5, 3: [2] * 5}


def test_one_hot(spark):
    row = spark.createDataFrame([(3,)], "y int").select(ft.one_hot("y", 5).alias("h"), ft.arg_max(ft.one_hot("y", 5)).alias("a")).first()
    assert row.h == [0, 0, 1, 0, 0] and row.a == 3


def test_limited_vocabulary_counts_few_ngrams(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["aa bb cc"] * int(rng.integers(0, 3)) + [f"w{rng.integers(200)}" for _ in range(12)] + ["bb cc"])) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    grams, built = ft.gram_array("text", 1, 3), []
    whole, real = ft.vocabulary(df, grams, max_features=8), ft.term_statistics
    monkeypatch.setattr(ft, "term_statistics", lambda d, g: built.append(real(d, g)) or built[-1])
    pruned = ft.vocabulary(df, grams, max_features=8, spans=("text", 3))
    assert sorted(pruned.collect()) == sorted(whole.collect())
    assert sum(b.count() for b in built) < real(df, grams).count() / 2
    cells = [ft.tfidf(df, "id", grams, whole, digits=9, spans=s).collect() for s in (None, ("text", 3))]
    assert sorted(cells[0]) == sorted(cells[1]) and cells[0]
    for options in ({"min_df": 4}, {"max_df": 0.5}):  # limits on documents leave out frequent words, not what follows from them
        assert sorted(ft.vocabulary(df, grams, max_features=9, spans=("text", 3), **options).collect()) == sorted(ft.vocabulary(df, grams, max_features=9, **options).collect())
    monkeypatch.setattr(ft, "NAMED_WORDS", 2)
    assert sorted(ft.vocabulary(df, grams, max_features=8, spans=("text", 3)).collect()) == sorted(whole.collect())


def test_average_vectors(spark, docs):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 4.0]), ("sat", [2.0, 2.0])], "word string, vec array<float>")
    rows = {r.id: r.mean_vec for r in ft.average_vectors(docs, "id", tx.word_punct_tokens("t"), vectors).collect()}
    assert rows == {0: [1.5, 1.0], 1: [1.0, 3.0], 2: [0.5, 2.0], 3: None, 4: None}


def test_average_vectors_sum_on_the_map_side(spark, docs):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 4.0])], "word string, vec array<float>")
    found = ft.average_vectors(docs, "id", tx.word_punct_tokens("t"), vectors)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    none = ft.average_vectors(docs, "id", tx.word_punct_tokens("t"), vectors.limit(0))
    assert {(r.known_words, r.mean_vec) for r in none.collect()} == {(0, None)}
    mixed = vectors.unionByName(spark.createDataFrame([("sat", [1.0])], "word string, vec array<float>"))
    with pytest.raises(ValueError):
        ft.average_vectors(docs, "id", tx.word_punct_tokens("t"), mixed)


def test_unknown_vectors_are_repeatable(spark):
    vocab = spark.createDataFrame([(f"w{i}",) for i in range(400)] + [("cat",)], "word string")
    known = spark.createDataFrame([("cat", [3.0, 4.0]), ("bad", [1.0])], "word string, vec array<float>")
    first = {r.word: r.vec for r in ft.fill_unknown_vectors(vocab, known, 2, normalize=True, match_moments=False).collect()}
    second = {r.word: r.vec for r in ft.fill_unknown_vectors(vocab.repartition(5), known, 2, normalize=True, match_moments=False).collect()}
    assert first == second and first["cat"] == pytest.approx([0.6, 0.8])
    values = np.array([v for w, v in first.items() if w != "cat"])
    assert abs(values.mean()) < 0.15 and abs(values.std() - 1) < 0.1
    moved = ft.fill_unknown_vectors(vocab, known, 2).where("not found").select(F.explode("vec").alias("x")).agg(F.avg("x")).first()[0]
    assert abs(moved - 3.5) < 0.15


def test_subwords(spark):
    row = spark.createDataFrame([(["cat"],)], "w array<string>").select(tr.subword_tokens(F.col("w"), 3, 4)).first()[0]
    assert row == ["cat", "<ca", "cat", "at>", "<cat", "cat>"]
