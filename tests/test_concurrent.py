import threading
import time

import pytest

from starloom.operators import training as tr
from starloom.plans.concurrent import TimedOut, run_each




def test_results_keep_the_order_and_errors_stay_with_their_item(spark):
    def work(n):
        if n == 2:
            raise ValueError("two")
        return spark.range(n).count()

    got = run_each(spark, [5, 2, 7], work, parallel=3)
    assert [r for r, _ in got] == [5, None, 7] and [type(e) for _, e in got] == [type(None), ValueError, type(None)]
    assert run_each(spark, [], work) == []


def test_jobs_overlap_in_pools_of_their_own(spark):
    barrier = threading.Barrier(3, timeout=30)  # passes only if all three run at once
    pools = set()

    def work(n):
        barrier.wait()
        pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return spark.range(n).count()

    assert [r for r, _ in run_each(spark, [1, 2, 3], work, parallel=3)] == [1, 2, 3]
    assert len(pools) == 3 and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def _sleeper(spark):
    def nap(batches):
        for batch in batches:
            time.sleep(120)
            yield batch

    return spark.range(2).mapInPandas(nap, "id long").count()


def test_a_hanging_job_is_cancelled_and_the_rest_goes_on(spark):
    start = time.monotonic()
    got = run_each(spark, ["hang", "quick"], lambda n: _sleeper(spark) if n == "hang" else spark.range(4).count(), parallel=2, timeout=6)
    assert isinstance(got[0][1], TimedOut) and got[1] == (4, None)
    assert time.monotonic() - start < 60
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []


@pytest.fixture
def job(spark):
    ran = []

    def run(settings):
        ran.append(settings["model_name"])
        if settings["model_name"] == "hang":
            _sleeper(spark)
        if settings["model_name"] == "bad":
            raise KeyError("bad")
        return tr._run_row(spark, {"model_name": settings["model_name"], "description": settings["model_name"], "status": "success", "status_date": tr._now(),
                                   "accuracy": float(settings["x"])})

    run.ran = ran
    return run


def _rows(spark, path):
    return sorted((r.model_name, r.status, r.accuracy) for r in spark.read.parquet(path).collect())


def test_a_parallel_sweep_gives_the_rows_of_the_loop(spark, job, tmp_path):
    config = [{"model_name": f"m{i}", "x": i} for i in range(8)] + [{"model_name": "bad", "x": 0}]
    outcomes = []
    for n, parallel in ((0, 1), (1, 4)):
        outcomes.append([{k: v for k, v in d.items() if k != "status_date"} for d in tr.sweep(spark, config, job, str(tmp_path / str(n)), parallel=parallel)])
    assert outcomes[0] == outcomes[1] and [d["status"] for d in outcomes[0]] == ["success"] * 8 + ["failed"]
    assert _rows(spark, str(tmp_path / "0")) == _rows(spark, str(tmp_path / "1")) == [(f"m{i}", "success", float(i)) for i in range(8)]


def test_a_sweep_resumes_from_its_report(spark, job, tmp_path):
    path, config = str(tmp_path / "report"), [{"model_name": "a", "x": 1}, {"model_name": "bad", "x": 0}, {"model_name": "b", "x": 2}]
    tr.sweep(spark, config[:2], job, path, resume=True)
    done = tr.sweep(spark, [*config, {"model_name": "a", "x": 3}], job, path, resume=True)
    assert job.ran == ["a", "bad", "bad", "b", "a"]
    assert [d["status"] for d in done] == ["success", "failed", "success", "success"]
    assert _rows(spark, path) == [("a", "success", 1.0), ("a", "success", 3.0), ("b", "success", 2.0)]


def test_a_hanging_job_of_a_sweep_ends_as_failed(spark, job, tmp_path):
    path = str(tmp_path / "report")
    done = tr.sweep(spark, [{"model_name": "hang", "x": 0}, {"model_name": "a", "x": 1}], job, path, parallel=2, timeout=8)
    assert [d["status"] for d in done] == ["failed", "success"] and "stopped after 8 seconds" in done[0]["message"]
    assert _rows(spark, path) == [("a", "success", 1.0), ("hang", "failed", None)]
