"""Merges of prediction sets, report series and vocabularies with embeddings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.plans.ranking import rank_within
from starloom.plans.sizing import lookup_join


def merge_predictions(sets: Mapping[str, DataFrame], key: str, text: str) -> DataFrame:
    """Full outer merge of prediction sets on their shared key; rows without text are dropped.

    Each set must be unique in ``key``. Stacking the sets and grouping once needs a single
    shuffle, where a chain of outer joins would shuffle every intermediate result.
    """
    columns = list(dict.fromkeys(c for df in sets.values() for c in df.columns if c != key))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets.values())
    merged = stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
    return merged.where(F.col(text).isNotNull())


def merge_series(series: Mapping[str, DataFrame], key: str, measure: str) -> DataFrame:
    """Outer merge of one measure per named series: key plus one column per series."""
    renamed = {name: df.select(key, F.col(measure).alias(name)) for name, df in series.items()}
    return reduce(lambda a, b: a.join(b, key, "full_outer"), renamed.values())


def attach_text(rows: DataFrame, texts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to their texts or labels on the explicit key (inner or left)."""
    return rows.join(texts, key, how)


def vocabulary_vectors(vocabulary: DataFrame, embeddings: DataFrame, dim: int, word: str = "word", vec: str = "vec") -> DataFrame:
    """Vector of every vocabulary word; missing or wrongly sized vectors become zeros."""
    usable = embeddings.where(F.size(vec) == dim).select(F.col(word), F.col(vec).alias("__vec"))
    return vocabulary.join(usable, word, "left").select(
        *vocabulary.columns, F.coalesce("__vec", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias(vec),
        F.col("__vec").isNotNull().alias("found"))


def missing_words(vocabulary: DataFrame, embeddings: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary words without an embedding."""
    return vocabulary.join(embeddings.select(word), word, "left_anti")


def split_known_words(df: DataFrame, key: str, text: str, known: DataFrame, word: str = "word", limit: int = 100) -> DataFrame:
    """Per text: distinct unknown words (sorted) and the words a model is trained on.

    With unknown words the training text is the known words cut to word count minus distinct
    unknown words; without any it is the first ``limit`` words.
    """
    tokens = df.select(key, F.posexplode(tx.blank_tokens(text)).alias("__pos", word))
    marked = lookup_join(tokens, known.select(word).distinct().withColumn("__known", F.lit(True)), [word], "left")
    packed = marked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("__pos", word, F.coalesce("__known", F.lit(False)).alias("known")))).alias("__t"))
    words = F.transform("__t", lambda t: t[word])
    known_words = F.transform(F.filter("__t", lambda t: t["known"]), lambda t: t[word])
    unknown = F.array_sort(F.array_distinct(F.transform(F.filter("__t", lambda t: ~t["known"]), lambda t: t[word])))
    split = packed.select(key, words.alias("__w"), known_words.alias("__k"), unknown.alias("__u"))
    trained = F.when(F.size("__u") > 0, F.slice("__k", F.lit(1), F.size("__w") - F.size("__u"))).otherwise(
        F.slice("__w", F.lit(1), F.least(F.size("__w"), F.lit(limit))))
    return split.select(key, F.when(F.size("__u") > 0, F.array_join("__u", " ")).alias("out_of_vocab"),
                        F.array_join(trained, " ").alias("text_train"))


def align_series(df: DataFrame, keys: Sequence[str], series: Sequence[str], position: str = "epoch") -> DataFrame:
    """Parallel arrays to one row per position; shorter arrays are padded with nulls."""
    zipped = F.arrays_zip(*[F.col(c) for c in series])
    exploded = df.select(*keys, F.posexplode(zipped).alias("__p", "__z"))
    return exploded.select(*keys, (F.col("__p") + 1).cast("long").alias(position), *[F.col(f"__z.{c}").alias(c) for c in series])


def align_long_series(series: Sequence[tuple[DataFrame, str]], key: str, position: str = "epoch") -> DataFrame:
    """Series kept as rows, each ordered by its own values, to one row per key and position; shorter ones give nulls.

    Places are ranks along a global order, so a key with very many values is no array and no single task.
    """
    placed = [rank_within(df.select(key, value), key, [F.col(value)], position) for df, value in series]
    return reduce(lambda a, b: a.join(b, [key, position], "full"), placed)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in a computed key set."""
    return lookup_join(df, keys.select(*on), list(on), "left_semi")


def label_names(label: Column, names: Mapping[int, str]) -> Column:
    """Map class codes to display names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)
