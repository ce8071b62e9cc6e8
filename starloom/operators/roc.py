"""ROC curves and areas per class, micro- and macro-averaged, without collecting scores.

Scores are first reduced to one row per (curve, distinct score) with positive and negative
counts; cumulative counts come from a range-partitioned running sum, and neighbours along a
curve meet through consecutive global row numbers, so no curve has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.ranking import number_rows
from starloom.plans.session import cut_lineage


def long_scores(df: DataFrame, truth: str, scores: Sequence[Column]) -> DataFrame:
    """Rows (curve, score, hit): one per class and row, plus the pooled 'micro' curve."""
    pairs = []
    for label, score in enumerate(scores, start=1):
        hit = (F.col(truth) == label).cast("long")
        for curve in (str(label), "micro"):
            pairs.append(F.struct(F.lit(curve).alias("curve"), score.cast("double").alias("score"), hit.alias("hit")))
    return df.select(F.inline(F.array(*pairs)))


def curve_points(scores: DataFrame) -> DataFrame:
    """Cumulative ROC points per curve and distinct score, in descending score order."""
    groups = scores.groupBy("curve", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    numbered = number_rows(groups, [F.col("curve"), F.desc("score")], "rn", running={"cum_pos": "pos", "cum_neg": "neg"})
    totals = numbered.groupBy("curve").agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"),
        F.min(F.col("cum_pos") - F.col("pos")).alias("before_pos"), F.min(F.col("cum_neg") - F.col("neg")).alias("before_neg"))
    tp, fp = F.col("cum_pos") - F.col("before_pos"), F.col("cum_neg") - F.col("before_neg")
    return numbered.join(F.broadcast(totals), "curve").select(
        "curve", "score", "rn", "pos", "neg", "first_rn", "last_rn", "all_pos", "all_neg",
        tp.alias("tp"), fp.alias("fp"), (fp / F.col("all_neg")).alias("fpr"), (tp / F.col("all_pos")).alias("tpr"))


def thinned_points(points: DataFrame) -> DataFrame:
    """Curve points without those lying on a straight continuation, starting at (0, 0)."""
    following = points.select(F.col("curve").alias("__c"), (F.col("rn") - 1).alias("__rn"), F.col("pos").alias("__pos"), F.col("neg").alias("__neg"))
    joined = points.join(following, (F.col("curve") == F.col("__c")) & (F.col("rn") == F.col("__rn")), "left")
    bend = (F.col("pos") != F.col("__pos")) | (F.col("neg") != F.col("__neg"))
    kept = joined.where((F.col("rn") == F.col("first_rn")) | (F.col("rn") == F.col("last_rn")) | bend).select("curve", "fpr", "tpr")
    origin = points.select("curve").distinct().select("curve", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.unionByName(origin)


def _areas(points: DataFrame) -> DataFrame:
    """Trapezoid area per curve: every score group adds its false positives times mean height."""
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return points.groupBy("curve").agg((F.sum(strip) / F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("auc"))


def roc_auc(df: DataFrame, truth: str, scores: Sequence[Column]) -> DataFrame:
    """Rows (curve, auc): one per class plus 'micro' and 'macro'.

    The macro curve averages the class curves interpolated on the union of their false
    positive rates. Its trapezoid area is the mean class area plus, for every vertical jump
    of a class curve, half the jump times the distance to the preceding grid point.
    """
    points = cut_lineage(curve_points(long_scores(df, truth, scores)))
    areas = _areas(points)
    kept = thinned_points(points.where(F.col("curve") != "micro"))
    jumps = kept.groupBy("curve", "fpr").agg((F.max("tpr") - F.min("tpr")).alias("jump"))
    grid = number_rows(jumps.select("fpr").distinct(), ["fpr"], "g")
    previous = grid.select((F.col("g") + 1).alias("g"), F.col("fpr").alias("prev"))
    gaps = grid.join(previous, "g").select("fpr", (F.col("fpr") - F.col("prev")).alias("gap"))
    extra = jumps.join(gaps, "fpr").agg(F.coalesce(F.sum(F.col("jump") * F.col("gap") / 2), F.lit(0.0)).alias("extra")).scalar()
    macro = areas.where(F.col("curve") != "micro").agg(((F.sum("auc") + extra) / F.count("*")).alias("auc"))
    return areas.unionByName(macro.select(F.lit("macro").alias("curve"), "auc"))


def roc_curves(df: DataFrame, truth: str, scores: Sequence[Column]) -> DataFrame:
    """Points (curve, fpr, tpr) of the class and micro curves."""
    return thinned_points(cut_lineage(curve_points(long_scores(df, truth, scores))))
