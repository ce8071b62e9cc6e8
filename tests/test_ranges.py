"""Byte-range readers against Spark's own readers, and selection against sorted lists."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from starloom.operators import stats
from starloom.plans import ranking, selection
from starloom.sources import ranges, tables

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def quoted(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


@pytest.mark.parametrize("case", ["plain", "long fields", "crlf", "long header", "open quote"])
def test_quoted_records_equal_the_whole_file_reader(spark, small_splits, tmp_path, case):
    rng, eol = random.Random(len(case)), "\r\n" if case == "crlf" else "\n"
    for f in range(2):
        with open(tmp_path / f"f{f}.csv", "w", newline="") as out:
            out.write('k,a,"b' + "\n" * (5000 if case == "long header" else 0) + '"' + eol)
            for k in range(400):
                n = 9000 if case == "long fields" and k % 100 == 7 else rng.choice([0, 3, 10, 60])
                out.write(f'{f * 1000 + k},{quoted("".join(rng.choices("ab ,\"\nx", k=n)))},{quoted(rng.choice(["", "é", chr(10) + "z", chr(34)]))}{eol}')
            if case == "open quote":
                out.write('5000,"never closed\nto the end')
    got = tables.read_csv(spark, str(tmp_path), SCHEMA)
    want = spark.read.schema(SCHEMA).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_lines_are_numbered_by_file_and_across_without_moving_them(spark, small_splits, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType())])
    for f in range(3):
        (tmp_path / f"f{f}.tsv").write_text("k\ta\n" + "".join(f"{k}\tx{f}\n" for k in range(1, 900 + f)))
    scan = tables.read_tsv(spark, str(tmp_path), schema)
    numbered = ranges.number_file_rows(scan)
    assert scan.rdd.getNumPartitions() > 3 and numbered.where("line_no = k").count() == 2700
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    across = {r.line_no: (r.a, r.k) for r in ranges.number_file_rows(scan, across=True).collect()}
    assert len(across) == 2700 and across[1] == ("x0", 1) and across[900] == ("x1", 1) and across[2700] == ("x2", 901)
    kept = ranges.sample_file_rows(scan, 90).collect()
    assert sorted({r.k for r in kept}) == [90 * k for k in range(1, 11)] and len(kept) == 29
    assert {r.k for r in ranges.file_line_range(scan, 5, 6).collect()} == {5, 6} and ranges.sample_file_rows(scan, 0) is scan
    converted = tables.convert_tsv(spark, str(tmp_path), str(tmp_path / "out"), schema, rate=450)
    assert sorted((r.a, r.k) for r in converted.collect()) == [(f"x{f}", k) for f in range(3) for k in (450, 900) if k < 900 + f]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.tsv").write_text("")
    assert ranges.number_file_rows(tables.read_tsv(spark, str(tmp_path / "empty"), schema)).count() == 0
    assert tables.read_csv(spark, str(tmp_path / "empty"), schema).count() == 0


def test_first_rows_by_heads_and_by_number(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "(id * 7919) % 503 as v")
    want = sorted(((r.id, r.v) for r in df.collect()), key=lambda r: (r[1], r[0]))[:40]
    for limit in (100_000, 10):
        monkeypatch.setattr(ranking, "HEAD_ROWS", limit)
        assert sorted(map(tuple, ranking.first_rows(df, ["v", "id"], 40).collect()), key=lambda r: (r[1], r[0])) == want


@pytest.mark.parametrize("small", [8, 100_000])
def test_group_quantiles_equal_sorted_lists(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL_BIN", small)
    monkeypatch.setattr(selection, "BINS", 64)
    rng = random.Random(6)
    groups = {"wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(300)], "ties": [float(rng.randint(0, 3)) for _ in range(400)], "one": [2.5], None: [rng.gauss(0, 1) for _ in range(250)],
              "ends": [float("inf"), float("-inf"), 0.0, -0.0, 1.0, 5e-324, 1.7e308, -1.7e308], "close": [1.0 + k * 2.0 ** -52 for k in range(60)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.probability): r.quantile for r in stats.exact_quantiles(df, "v", probabilities, ["g"]).collect()}
    assert {g for g, _ in got} == set(groups)
    for g, values in groups.items():
        s = sorted(values)
        for p in probabilities:
            place = p * (len(s) - 1)
            low, high = s[int(place)], s[min(int(place) + 1, len(s) - 1)]
            want = low if place == int(place) or low == high else (1 - place + int(place)) * low + (place - int(place)) * high
            assert got[g, p] == pytest.approx(want, rel=1e-12, abs=0, nan_ok=True), (g, p)
    assert stats.exact_quantiles(df.where("g = 'none'"), "v", probabilities).count() == 0
    described = {r.g: r for r in stats.describe(df.where("g in ('ties', 'none')"), "v", ["g"]).collect()}
    assert described["ties"]["q50"] == float(np.median(groups["ties"])) and described["none"]["count"] == 0 and described["none"]["q50"] is None
