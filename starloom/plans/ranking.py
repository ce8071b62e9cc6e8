"""Global row numbers and in-group ranks that never sort everything in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.session import cut_lineage
from starloom.plans.sizing import lookup_join

HEAD_ROWS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row offset in the low 33 bits


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "rn", start: int = 1,
                running: Mapping[str, str] | None = None) -> DataFrame:
    """Add a dense global row number along ``order`` (must be a total order).

    ``running`` maps new column names to measures whose running sums are wanted as well.

    A range-partitioned sort spreads the rows, the sorted rows are checkpointed so that both
    readers below agree on the partitions, and the offset table holds one row per partition,
    which is what makes its broadcast and its single-task running sum safe.
    """
    sums = dict(running or {})
    placed = cut_lineage(df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__place", _ROW_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"), *[F.sum(m).alias(f"__sum_{n}") for n, m in sums.items()])
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    if sums:
        local = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumns({f"__local_{n}": F.sum(m).over(local) for n, m in sums.items()})
    within = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), "__part").select(
        *df.columns, (F.col("__offset") + within + F.lit(start)).alias(name),
        *[(F.col(f"__before_{n}") + F.col(f"__local_{n}")).alias(n) for n in sums])


def rank_within(df: DataFrame, group: str, order: Sequence[Column | str], name: str = "rn",
                size_name: str | None = None) -> DataFrame:
    """Row number inside each ``group`` along ``order`` without one task per group.

    Rows are numbered globally by (group, order); the rank is the distance to the group's
    first number. A group holding a third of the table therefore spans many range partitions.
    The per-group table has one row per group; it is broadcast when measured small and joined
    with salted keys otherwise, so the hot group does not meet in one task there either.
    """
    numbered = number_rows(df, [F.col(group), *order], name="__global")
    groups = numbered.groupBy(group).agg(F.min("__global").alias("__first"), F.count("*").alias("__members"))
    keep = [F.col(c) for c in df.columns]
    extra = [(F.col("__global") - F.col("__first") + 1).alias(name)]
    if size_name:
        extra.append(F.col("__members").alias(size_name))
    return lookup_join(numbered, groups, [group]).select(*keep, *extra)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows along ``order`` (a total order), in any order.

    Up to HEAD_ROWS every task keeps its own first ``n`` and one merges these; more are cut off a
    range-partitioned sort by the global number.
    """
    if n <= HEAD_ROWS:
        return df.orderBy(*order).limit(n)
    return number_rows(df, order, "__place").where(F.col("__place") <= n).drop("__place")


def top_rows(df: DataFrame, order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows along ``order`` with their rank (a bounded top-k report)."""
    head = df.orderBy(*order).limit(k)
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
