import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators import joins, windows
from starloom.operators import relational as rel
from starloom.plans.ranking import number_rows, rank_within
from starloom.plans.sizing import lookup_join
from starloom.sources import tables as src


def test_casts(spark):
    df = spark.createDataFrame([(0, 3, 10)], "a bigint, b bigint, class bigint")
    assert rel.cast_features(df, "class").dtypes == df.dtypes
    assert dict(rel.cast_features(df, "class", "int8").dtypes) == {"a": "tinyint", "b": "tinyint", "class": "tinyint"}
    assert dict(rel.cast_features(df, "class", "uint32").dtypes) == {"a": "bigint", "b": "bigint", "class": "tinyint"}
    assert dict(rel.cast_features(df, "class", "float32").dtypes)["a"] == "float"
    assert dict(rel.cast_column(df, "b", "int8").dtypes) == {"a": "bigint", "b": "tinyint", "class": "bigint"}


def test_drop_empty(spark):
    df = spark.createDataFrame([("x", "x"), ("", "x"), (None, "x"), ("x", ""), ("x", None)], "a string, b string")
    assert rel.drop_empty(df, ["a", "b"]).count() == 1


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "old")], "id int, t string, z_orig string")
    assert rel.duplicate_columns(df, ["t"]).columns == ["id", "t_orig", "t"]
    with pytest.raises(ValueError):
        rel.drop_columns(df, ["nope"])


def test_labels(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "s int")
    rows = rel.class_subset(df, "s", [1, 4, 5]).withColumn("back", rel.restore_label("class_code", [1, 4, 5])).collect()
    assert sorted((r.s, r.class_code, r.back) for r in rows) == [(1, 1, 1), (4, 2, 4), (5, 3, 5)]


def test_votes(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (1, 2)], "h int, t int")
    rows = [(r.has_votes, r.helpful_percentage, r.helpful_review) for r in rel.vote_features(df, "h", "t").collect()]
    assert rows == [(False, None, False), (False, None, False), (True, 2 / 3, True), (True, 0.5, False)]


def test_global_numbers(spark):
    df = spark.range(0, 1000, numPartitions=7).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    assert all(r.rn == r.k + 1 for r in number_rows(df, ["k"]).collect())
    sums = number_rows(df, ["k"], running={"total": "k"}).collect()
    assert all(r.total == r.k * (r.k + 1) // 2 for r in sums)
    ranks = rank_within(df, "g", ["k"], size_name="n").collect()
    for g in (0, 1):
        part = sorted((r.k, r.rn) for r in ranks if r.g == g)
        assert [rn for _, rn in part] == list(range(1, len(part) + 1))
        assert {r.n for r in ranks if r.g == g} == {len(part)}


def test_salted_lookup_equals_broadcast(spark):
    facts = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(0, 200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        small = lookup_join(facts, lookup, ["k"], how)
        salted = lookup_join(facts, lookup, ["k"], how, row_limit=10, salts=4)
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)


def test_merge_predictions_equals_outer_joins(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "k int, p1 int")
    b = spark.createDataFrame([(2, 5, "t2"), (3, 4, "t3"), (4, 4, None)], "k int, p2 int, text string")
    rows = sorted(joins.merge_predictions({"a": a, "b": b}, "k", "text").select("k", "p1", "p2", "text").collect())
    assert [tuple(r) for r in rows] == [(2, 2, 5, "t2"), (3, None, 4, "t3")]


def test_known_words(spark):
    df = spark.createDataFrame([(1, "a zz b zz yy"), (2, "a b")], "id int, t string")
    known = spark.createDataFrame([("a",), ("b",)], "word string")
    rows = {r.id: (r.out_of_vocab, r.text_train) for r in joins.split_known_words(df, "id", "t", known).collect()}
    assert rows == {1: ("yy zz", "a b"), 2: (None, "a b")}


def test_improvement(spark):
    df = spark.createDataFrame([("m", 1, 0.5, 1.0), ("m", 2, 0.7, 3.0), ("m", 3, 0.8, 3.0)], "m string, n int, s double, t double")
    rows = windows.improvement(df, ["m"], "n", "s", "t").orderBy("n").collect()
    assert [(r.s_diff, r.t_diff) for r in rows][0] == (0.0, 0.0) and rows[0].improvement_ratio is None
    assert rows[1].improvement_ratio == pytest.approx(0.1) and rows[2].improvement_ratio is None


def test_best_run_takes_first_on_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "i int, s double")
    assert windows.best_run(df, "s", F.col("i")).first().i == 2


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.StringType())])


def test_csv_roundtrip_keeps_texts(spark, tmp_path):
    texts = ['quote " comma, x', "line\nbreak\n", " blanks ", 'a "" b', "tab\tx"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    src.write_csv(df, str(tmp_path / "c"))
    assert [r.body for r in src.read_csv(spark, str(tmp_path / "c"), SCHEMA).orderBy("id").collect()] == texts


def test_tsv_has_no_quoting_and_samples_every_second_row(spark, tmp_path):
    (tmp_path / "in.tsv").write_text('id\tbody\n' + "".join(f'{i}\t"half {i}\n' for i in range(1, 6)))
    rows = src.convert_tsv(spark, str(tmp_path / "in.tsv"), str(tmp_path / "out"), SCHEMA, rate=2, order=["id"])
    assert sorted((r.id, r.body) for r in rows.collect()) == [(2, '"half 2'), (4, '"half 4')]


def test_tolerant_scan(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\ta\n2\tb\textra\nx\tc\n4\td\n5\n")
    good, bad = src.read_tolerant(spark, str(tmp_path / "x.tsv"), SCHEMA)
    assert sorted(r.id for r in good.collect()) == [1, 4]
    assert sorted(r.line for r in bad.collect()) == ["2\tb\textra", "5", "x\tc"]


def test_embeddings_and_reports(spark, tmp_path):
    (tmp_path / "e.txt").write_text("the 0.5 -1\ncat 1 2\n")
    rows = {r.word: r.vec for r in src.read_embeddings(spark, str(tmp_path / "e.txt")).collect()}
    assert rows == {"the": [0.5, -1.0], "cat": [1.0, 2.0]}
    (tmp_path / "r.csv").write_text("acc,report\n0.5,'{\"1\": {\"recall\": 0.5}, \"x\": 1}'\n")
    assert src.read_report_csv(spark, str(tmp_path / "r.csv")).first().report == '{"1": {"recall": 0.5}, "x": 1}'
    assert src.feature_set_name("body", "tfidf", 10, 5) == "body-tfidf-10-5-nolda"


def test_description(spark):
    text = "review_body-tfidf-df_none-ngram13-49784-4000-nolda-sampling_none-LR-star_rating"
    row = rel.parse_description(spark.createDataFrame([(text,)], "description string")).first()
    assert (row.config_df, row.config_ngram, row.has_lda, row.has_sampling, row.label_column) == (None, "ngram13", False, False, "star_rating")
    assert row.feature_summary == "tfidf-ngram13-4000" and row.feature_summary_sampling == "tfidf-ngram13-sampling_none"
