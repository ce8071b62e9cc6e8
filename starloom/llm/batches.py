"""Session settings for tasks that handle whole texts in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from starloom.plans.session import ship_package

ROWS_PER_BATCH = 2000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Give the package to the workers and hand them texts in batches of at most ``ROWS_PER_BATCH`` rows.

    Both the JVM and the worker hold a batch of texts at a time; a smaller setting of the session stays.
    """
    ship_package(spark)
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(_SETTING, ROWS_PER_BATCH)
