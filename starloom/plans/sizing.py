"""Join helpers that broadcast only after measuring, and salt hot keys otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.plans.session import cut_lineage

BROADCAST_ROW_LIMIT = 2_000_000
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024
SALTS = 16


def materialized(df: DataFrame) -> DataFrame:
    """``df`` itself when cached, else a checkpoint of it, so that measuring and joining compute it once."""
    return df if df.storageLevel.useMemory or df.storageLevel.useDisk else cut_lineage(df)


def _row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row, from the lengths of its variable parts."""
    total = F.lit(16).cast("long")
    for field in df.schema:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(value)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = F.size(value) * 8
        elif isinstance(kind, VectorUDT):
            size = F.size(vector_to_array(value)) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(value))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size.cast("long"), F.lit(8).cast("long"))
    return total


def fits_broadcast(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT, byte_limit: int = BROADCAST_BYTE_LIMIT) -> bool:
    """True when ``df`` is within both limits, measured by one distributed aggregate."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return rows <= row_limit and size <= byte_limit


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner",
                row_limit: int = BROADCAST_ROW_LIMIT, salts: int = SALTS, computed: bool = False) -> DataFrame:
    """Join a large, possibly skewed ``facts`` side to a ``lookup`` side unique in ``keys``.

    The lookup is computed once (cached or checkpointed, unless ``computed`` says it is) and measured. Within the row and byte
    limits it is broadcast, without a shuffle of the facts. Beyond that both sides are shuffled
    on (keys, salt): a fact's salt is a hash of its row, and each lookup row is repeated once
    per salt, so one key holding a third of the facts is spread over ``salts`` tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    lookup = lookup if computed else materialized(lookup)
    if fits_broadcast(lookup, row_limit):
        return facts.join(F.broadcast(lookup), list(keys), how)
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use idle cores before compute-heavy steps.

    Redistributes only when the input has fewer splits than the cluster has cores (a few small
    files); a scan that already has a split per core is returned untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    Catalyst pushes a filter below a projection by copying the projected expressions into it,
    which repeats a long text-cleaning chain. A non-deterministic column keeps the filter above.
    """
    guarded = df.withColumn("__once", F.spark_partition_id())
    return guarded.where(condition & (F.col("__once") >= 0)).drop("__once")
