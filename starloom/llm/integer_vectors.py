"""Vectors of floating-point numbers as vectors of integers on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.session import stage_table


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, shift: int, **others: Column) -> DataFrame:
    """(id, x, others) with x = floor(scale * c) + shift in longs, written to the shared folder.

    Rows stay whose vector is not null, holds no null and no non-finite entry, and has the most
    frequent length (the smaller of equally frequent ones); empty vectors go.
    """
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift))
    rows = df.where(vector.isNotNull() & (F.size(vector) > 0) & ~bad)
    staged = stage_table(rows.select(F.col(id_col).cast("long").alias("id"), x.cast("array<long>").alias("x"), *[c.alias(k) for k, c in others.items()]), "integer-vectors")
    widths = staged.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    usual = widths.agg(F.max_by("width", F.struct("n", -F.col("width")))).first()[0]
    return staged.where(F.size("x") == (usual or 0))
