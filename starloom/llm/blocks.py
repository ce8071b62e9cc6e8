"""Comparing the members of groups of any size in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.sizing import lookup_join

BLOCK_KEYS = ("key", "left_block", "right_block")


def paired_blocks(members: DataFrame, row_id: str, block_rows: int) -> DataFrame:
    """Rows of groups with two or more members, once for each pair of blocks they belong to.

    ``members`` has a long ``key``. A group of up to ``block_rows`` rows is one block and its rows
    appear once. A larger group is cut into blocks by a hash of ``row_id``; every unordered pair of
    blocks becomes a unit of work, so each pair of members meets in exactly one unit and no unit
    holds more than about two blocks. Units are brought together, sorted, for ``grouped_rows``.
    """
    sizes = members.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("__blocks"))
    placed = lookup_join(members, sizes, ["key"]).withColumn("own_block", F.pmod(F.xxhash64(row_id), F.col("__blocks")).cast("int"))
    paired = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    paired = paired.withColumns({"left_block": F.least("own_block", "__other"), "right_block": F.greatest("own_block", "__other")})
    return paired.drop("__blocks", "__other").repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, row_id)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: Sequence[str] = BLOCK_KEYS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, each with the bounds of its groups.

    The last group of a batch waits for the next one, so memory holds a batch and one group.
    """
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            change |= values[1:] != values[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1])
        if bounds[-1]:
            yield table.slice(0, bounds[-1]), bounds
        waiting = table.slice(bounds[-1])
    if waiting is not None:
        yield waiting, np.array([0, waiting.num_rows])
