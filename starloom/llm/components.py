"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    key = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(key), F.sum(F.shiftright(key, 20))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("__v")).select("u", F.least("u", "__v").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Neighbourhoods are never gathered: a step is a grouped minimum, which is summed map-side, and a
    join that adaptive execution splits where a node has very many edges. Lineage is cut by a
    checkpoint in the shared folder after each round; rounds grow with the logarithm of the nodes.
    Edges with a null end and loops are ignored; an empty input gives an empty result.
    """
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        last, seen = seen, _fingerprint(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
