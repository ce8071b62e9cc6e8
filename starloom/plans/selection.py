"""Exact order statistics of any measure, per group, by refining histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.session import cut_lineage
from starloom.plans.sizing import fits_broadcast

BINS = 4096
SMALL_BIN = 20_000
_LARGEST = 1.7976931348623157e308
_SMALLEST = 746.0  # more than the logarithm of one over the smallest double


def _finite(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(_LARGEST)), F.lit(-_LARGEST))


def _bin(by_size: bool) -> Column:
    """Bin of ``__v`` between ``__lo`` and ``__hi``: a function that never falls, on the scale of logarithms or of values.

    Where the scale cannot tell the ends apart, the second bin takes all above the lower end.
    """
    def scaled(name: str) -> Column:
        value = _finite(F.col(name))
        size = F.when(value == 0, 0.0).otherwise(F.log(F.abs(value)) + _SMALLEST)
        return F.signum(value) * size if by_size else value * 0.5

    low, high = scaled("__lo"), scaled("__hi")
    place = F.floor((scaled("__v") - low) / (high - low) * F.lit(float(BINS)))
    return F.when(high > low, F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).otherwise((F.col("__v") > F.col("__lo")).cast("long"))


def _inside(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows with the intervals they lie in; one row an interval, a few a group."""
    side = F.broadcast(intervals) if fits_broadcast(intervals) else intervals
    return rows.join(side, "__g").where(F.col("__v").between(F.col("__lo"), F.col("__hi")))


def group_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, probability, quantile, n, low, high): linearly interpolated quantiles of ``column``, with its count and ends.

    The group's rows are histogrammed between its ends, map-side; a wanted rank falls into one bin,
    whose ends are the next interval, until the interval is one value or holds at most SMALL_BIN
    rows, which are then ranked. Where no group holds more than that, one aggregate does. No buffer or task holds the distinct values of a measure, and a
    group of any size is counted where its rows lie. Null and not-a-number values are left out; a
    group without others has no rows.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = cut_lineage(df.select(group.alias("__g"), F.col(column).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    sizes = rows.groupBy("__g").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= SMALL_BIN:
        direct = rows.groupBy("__g").agg(F.percentile("__v", asked).alias("q"), F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        direct = direct.withColumn("z", F.explode(F.arrays_zip(asked.alias("probability"), F.col("q").alias("quantile"))))
        return direct.select(*[F.col("__g")[k].alias(k) for k in keys], "z.probability", "z.quantile", "n", "low", "high")
    wanted = sizes.withColumn("__p", F.explode(asked))
    place = F.col("__p") * (F.col("__n") - 1)
    wanted = cut_lineage(wanted.withColumn("__place", place).select(
        "__g", "__p", "__n", F.col("__lo").alias("__low"), F.col("__hi").alias("__high"), (F.col("__place") - F.floor("__place")).alias("__part"), F.floor("__place").alias("__rank")))
    ranks = wanted.select("__g", F.explode(F.array("__rank", F.least(F.col("__rank") + 1, F.col("__n") - 1))).alias("__rank"), F.lit(0).cast("long").alias("__below"),
                          F.col("__n").alias("__size"), F.col("__low").alias("__lo"), F.col("__high").alias("__hi")).distinct()
    found = _ranked(rows, cut_lineage(ranks))
    at = found.select("__g", F.col("__rank").alias("__at"), "__value")
    named = F.map_from_entries(F.collect_list(F.struct("__at", "__value")))
    values = at.groupBy("__g").agg(named.alias("__values"))  # two entries a probability
    low, high = F.col("__values")[F.col("__rank")], F.col("__values")[F.least(F.col("__rank") + 1, F.col("__n") - 1)]
    quantile = F.when((F.col("__part") == 0) | (low == high), low).otherwise((1 - F.col("__part")) * low + F.col("__part") * high)
    out = wanted.join(values, "__g")
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], F.col("__p").alias("probability"), quantile.alias("quantile"), F.col("__n").alias("n"), F.col("__low").alias("low"), F.col("__high").alias("high"))


def _ranked(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """(__g, __rank, __value) for ranks from 0 among a group's rows, each known to lie in an interval."""
    done, by_size = [], True
    interval = ["__g", "__lo", "__hi", "__below", "__size"]
    while True:
        settled = (F.col("__lo") == F.col("__hi")) | (F.col("__size") <= SMALL_BIN)
        done.append(ranks.where(settled))
        open_ranks = ranks.where(~settled)
        if open_ranks.isEmpty():
            break
        inside = _inside(rows, open_ranks.select(*interval).distinct())
        counted = inside.groupBy("__g", "__lo", "__below", _bin(by_size).alias("__bin")).agg(F.count("*").alias("__held"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
        earlier = Window.partitionBy("__g", "__lo").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = counted.withColumn("__under", F.col("__below") + F.coalesce(F.sum("__held").over(earlier), F.lit(0)))
        placed = open_ranks.select("__g", "__rank", "__lo").join(bins, ["__g", "__lo"]).where((F.col("__rank") >= F.col("__under")) & (F.col("__rank") < F.col("__under") + F.col("__held")))
        ranks = cut_lineage(placed.select("__g", "__rank", F.col("__under").alias("__below"), F.col("__held").alias("__size"), F.col("__least").alias("__lo"), F.col("__most").alias("__hi")))
        by_size = not by_size
    known = done[0]
    for more in done[1:]:
        known = known.unionByName(more)
    known = cut_lineage(known)
    single = known.where("__lo = __hi").select("__g", "__rank", F.col("__lo").alias("__value"))
    small = known.where("__lo <> __hi")
    order = Window.partitionBy("__g", "__lo", "__hi").orderBy("__v")  # SMALL_BIN rows at most
    numbered = _inside(rows, small.select(*interval).distinct()).withColumn("__rank", F.col("__below") + F.row_number().over(order) - 1)
    return single.unionByName(numbered.join(small.select("__g", "__rank", "__lo", "__hi"), ["__g", "__rank", "__lo", "__hi"], "left_semi").select("__g", "__rank", F.col("__v").alias("__value")))
