"""Projection, filtering, relabelling and report clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.sizing import filter_once


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; naming one that does not exist is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def duplicate_columns(df: DataFrame, columns: Sequence[str], reorder: bool = True) -> DataFrame:
    """Copy each listed column to ``<name>_orig``, placed right before it when reordering.

    Columns already named like a copy are not carried over.
    """
    kept = [c for c in df.columns if "_orig" not in c]
    if not reorder:
        return df.select(*kept, *[F.col(c).alias(f"{c}_orig") for c in columns])
    out: list[Column] = []
    for name in kept:
        if name in columns:
            out.append(F.col(name).alias(f"{name}_orig"))
        out.append(F.col(name))
    return df.select(*out)


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows in which any listed text column is null or has no characters."""
    return filter_once(df, reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.length(c) > 0) for c in columns]))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (listed) column."""
    return df.na.drop("any", subset=list(columns) if columns else None)


# numpy type names used in configurations and the Spark types that hold their range
_DTYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint",
           "uint16": "int", "uint32": "bigint", "float32": "float", "float64": "double"}


def cast_features(df: DataFrame, class_column: str, dtype: str | None = None) -> DataFrame:
    """Cast all columns but the class to ``dtype`` and the class to one byte; no dtype, no change."""
    if not dtype:
        return df
    target = _DTYPES[dtype]
    return df.select(*[F.col(c).cast("tinyint" if c == class_column else target).alias(c) for c in df.columns])


def cast_column(df: DataFrame, column: str, dtype: str | None = None) -> DataFrame:
    """Cast one column; no dtype, no change."""
    return df.withColumn(column, F.col(column).cast(_DTYPES[dtype])) if dtype else df


def relabel(label: Column | str, classes: Sequence[int]) -> Column:
    """Dense 1-based code of a label among ``classes`` (null for labels outside)."""
    table = F.create_map(*[F.lit(v) for pair in zip(classes, range(1, len(classes) + 1)) for v in pair])
    return F.try_element_at(table, F.col(label) if isinstance(label, str) else label)


def restore_label(code: Column | str, classes: Sequence[int]) -> Column:
    """Inverse of :func:`relabel`."""
    table = F.create_map(*[F.lit(v) for pair in zip(range(1, len(classes) + 1), classes) for v in pair])
    return F.try_element_at(table, F.col(code) if isinstance(code, str) else code)


def class_subset(df: DataFrame, label: str, classes: Sequence[int], name: str = "class_code") -> DataFrame:
    """Rows of the given classes with a dense class code."""
    return df.where(F.col(label).isin(list(classes))).withColumn(name, relabel(label, classes))


def helpful_product(rating: Column | str) -> Column:
    """1 when the rating is at least three stars."""
    return F.when((F.col(rating) if isinstance(rating, str) else rating) >= 3, 1).otherwise(0)


def vote_features(df: DataFrame, helpful: str, total: str) -> DataFrame:
    """has_votes (more than one vote), helpful_percentage (null without votes), helpful_review."""
    voted = F.col(total) > 1
    share = F.when(voted, F.col(helpful) / F.col(total))
    return df.select("*", voted.alias("has_votes"), share.alias("helpful_percentage"),
                     F.coalesce(share > 0.5, F.lit(False)).alias("helpful_review"))


def attach_class(features: DataFrame, labels: DataFrame, key: str, class_column: str) -> DataFrame:
    """Add the class column to a feature table through the shared key."""
    return features.join(labels.select(key, class_column), key)


def replace_literals(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Apply literal replacements one after the other."""
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), replacements, text)


def correct_cells(df: DataFrame, condition: Column, values: Mapping[str, object]) -> DataFrame:
    """Overwrite the given columns in the rows that meet ``condition``."""
    return df.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def remove_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is not true (null counts as not true)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def parse_description(df: DataFrame, description: str = "description") -> DataFrame:
    """Split a dash-joined run description into its positional settings."""
    part = F.split(F.col(description), "-")

    def item(i: int) -> Column:
        return F.get(part, F.lit(i))

    df = df.select(
        "*",
        item(0).alias("feature_column"), item(1).alias("feature_engineering"),
        F.nullif(item(2), F.lit("df_none")).alias("config_df"),
        F.nullif(item(3), F.lit("ngram_none")).alias("config_ngram"),
        item(4).alias("sample_size"), item(5).alias("feature_size"),
        (item(6) != "nolda").alias("has_lda"), item(6).alias("lda_str"),
        (item(7) != "sampling_none").alias("has_sampling"), item(7).alias("sampling_type"),
        item(9).alias("label_column"),
    )
    ngram = F.coalesce("config_ngram", F.lit("nan"))
    return df.select(
        "*",
        F.concat_ws("-", "feature_engineering", ngram, "feature_size").alias("feature_summary"),
        F.concat_ws("-", "feature_engineering", ngram, "sampling_type").alias("feature_summary_sampling"),
    )
