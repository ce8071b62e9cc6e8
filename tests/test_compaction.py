import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from starloom.streaming import scoring

START = datetime(2024, 3, 1)


def _batch(spark, log, number, rows):
    spark.createDataFrame(rows, "id long, created timestamp_ntz").write.mode("overwrite").parquet(f"{log}/batch={number}")


def _row(i):
    """Nine rows a day."""
    return i, START + timedelta(days=i // 9, minutes=i % 9)


def _ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    for number in range(4):
        _batch(spark, path, number, [_row(i) for i in range(number * 15, number * 15 + 15)])
    return path


def test_every_row_is_read_once_before_and_after(spark, log):
    everything = list(range(60))
    assert _ids(scoring.compacted_log(spark, log)) == everything
    assert scoring.compact_log(spark, log) == 3
    assert _ids(scoring.compacted_log(spark, log)) == everything
    assert scoring.compact_log(spark, log) == 0  # the last batch may still be written again
    assert scoring.compact_log(spark, log, whole=True) == 1
    assert _ids(scoring.compacted_log(spark, log)) == everything
    assert spark.read.parquet(f"{log}-days").count() == 60


def test_a_batch_written_again_changes_nothing(spark, log):
    scoring.compact_log(spark, log)
    _batch(spark, log, 1, [_row(i) for i in range(15, 30)])
    scoring.compact_log(spark, log, whole=True)
    _batch(spark, log, 3, [_row(i) for i in range(45, 60)])
    assert _ids(scoring.compacted_log(spark, log)) == list(range(60)) and scoring.compact_log(spark, log, whole=True) == 0


def test_a_compaction_that_was_cut_off_runs_again(spark, log, tmp_path):
    # what a run leaves that ends before its span counts as taken: days without a span
    half = spark.read.parquet(log).where("batch < 2").withColumn("day", F.to_date("created")).drop("batch")
    half.write.partitionBy("day").parquet(f"{log}-days/span=0")
    assert _ids(scoring.compacted_log(spark, log)) == list(range(60))
    assert scoring.compact_log(spark, log, whole=True) == 4
    assert _ids(scoring.compacted_log(spark, log)) == list(range(60))


def test_latest_equals_sorting_all_and_opens_only_new_days(spark, log, capsys):
    scoring.compact_log(spark, log)
    for n in (1, 10, 17, 40, 100):
        assert [r.id for r in scoring.latest(spark, log, n).collect()] == list(range(59, max(59 - n, -1), -1))
    scoring.compact_log(spark, log, whole=True)
    rows = scoring.latest(spark, log, 8)
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 2024-03-06", plan)
    assert [r.id for r in rows.collect()] == list(range(59, 51, -1))
    assert _ids(scoring.compacted_log(spark, log, date(2024, 3, 7))) == list(range(54, 60))


def test_rows_without_a_time_stay_and_come_last(spark, log):
    _batch(spark, log, 4, [(100, None), (101, None)])
    scoring.compact_log(spark, log, whole=True)
    assert _ids(scoring.compacted_log(spark, log)) == [*range(60), 100, 101]
    assert [r.id for r in scoring.latest(spark, log, 62).collect()] == [*range(59, -1, -1), 101, 100]


def test_an_empty_batch_is_passed_over(spark, tmp_path):
    log = str(tmp_path / "log")
    for number, rows in enumerate(([], [_row(1)], [], [_row(2)])):
        _batch(spark, log, number, rows)
    assert scoring.latest(spark, log, 5).count() == 2
    assert scoring.compact_log(spark, log) == 1 and scoring.compact_log(spark, log, whole=True) == 1
    assert _ids(scoring.latest(spark, log, 5)) == [1, 2]
