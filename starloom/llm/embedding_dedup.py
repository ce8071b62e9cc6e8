"""Near-duplicate vectors through a pivot-permutation index with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.blocks import grouped_rows, paired_blocks
from starloom.llm.components import connected_components
from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

THRESHOLD = 0.9
NEAREST = 6
MAX_PIVOTS = 65_536
BLOCK_ROWS = 1024
_SHIFT = 31
_CLASS = ["__h1", "__h2"]


def _valid(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column in double precision, of length 1 and filled up with zeros; and their sizes."""
    column = table.column("vector").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), sizes


def nearest_pivots(pivots: int) -> int:
    """How many nearest reference points describe a vector: NEAREST up to 64 pivots, 0.6 more with each doubling.

    The more pivots there are, the fewer of its nearest two vectors at the threshold share; with a
    fixed number their recall would fall as the table grows.
    """
    return NEAREST + max(0, round(0.6 * math.log2(max(1, pivots) / 64)))


def choose_pivots(vectors: DataFrame, width: int, rows: int, count: int | None = None) -> np.ndarray:
    """Reference points: the vectors of the smallest key hashes, 2 * sqrt(rows) of them.

    With that many, the lists of pivot pairs keep their length as the table grows. MAX_PIVOTS bounds
    what reaches the driver and the workers; every vector is indexed whatever their number.
    """
    count = min(rows, MAX_PIVOTS, count or max(32, int(2 * rows ** 0.5)))
    picked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vector").toArrow()
    return _unit(picked, width)[0] if picked.num_rows else np.zeros((0, width))


def _describe(pivots: np.ndarray, nearest: int):
    """Each vector's nearest pivots in order, and the keys of the inverted lists it enters."""
    nearest = min(nearest, len(pivots))
    pairs = np.array(list(combinations(range(nearest), 2)) or [(0, 0)])
    step = max(1, 4_000_000 // max(1, len(pivots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, _ = _unit(pa.Table.from_batches([batch]), pivots.shape[1])
            order = np.concatenate([np.argsort(-(unit[i:i + step] @ pivots.T), axis=1, kind="stable")[:, :nearest] for i in range(0, len(unit), step)])
            ranked = np.sort(order, axis=1).astype(np.int64)
            keys = (ranked[:, pairs[:, 0]] << _SHIFT) | ranked[:, pairs[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("vector"), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["rep", "copies", "vector", "permutation", "lists"])

    return run


def _verify(width: int, threshold: float):
    """Exact cosines inside a unit of work: links counted once per pair, and edges that span what is linked.

    Two vectors that share more than two pivots meet in several lists. Their link counts only in the
    list of their two smallest shared pivots.
    """

    def unit_rows(key, left, right, reps, copies, own, unit, sizes, tops):
        a, b = (np.arange(len(reps)),) * 2 if left == right else (np.flatnonzero(own == left), np.flatnonzero(own == right))
        near = (unit[a] @ unit[b].T >= threshold) & (sizes[a][:, None] == sizes[b][None, :])
        if left == right:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        i, j = (np.triu(near, 1) if left == right else near).nonzero()
        links = np.zeros(len(reps), np.int64)
        for s in range(0, len(i), 100_000):
            x, y = a[i[s:s + 100_000]], b[j[s:s + 100_000]]
            shared = (tops[x][:, :, None] == tops[y][:, None, :]).any(axis=2)
            first = shared.argmax(axis=1)
            rest = shared.copy()
            rest[np.arange(len(x)), first] = False
            second = np.where(rest.any(axis=1), rest.argmax(axis=1), first)
            at = np.arange(len(x))
            mine = ((tops[x][at, first] << _SHIFT) | tops[x][at, second]) == key
            np.add.at(links, x[mine], copies[y[mine]])
            np.add.at(links, y[mine], copies[x[mine]])
        label, none = reps.copy(), np.iinfo(np.int64).max
        while True:
            before = label.copy()
            label[a] = np.minimum(label[a], np.where(near, label[b][None, :], none).min(axis=1, initial=none))
            label[b] = np.minimum(label[b], np.where(near, label[a][:, None], none).min(axis=0, initial=none))
            if (before == label).all():
                return links, label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped_rows(batches):
            col = {c: table.column(c).to_numpy() for c in ("key", "left_block", "right_block", "own_block", "rep", "copies")}
            unit, sizes = _unit(table, width)
            tops = np.sort(np.stack(table.column("permutation").to_numpy()), axis=1).astype(np.int64)
            found = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                reps = col["rep"][s:e]
                made = unit_rows(col["key"][s], col["left_block"][s], col["right_block"][s], reps, col["copies"][s:e], col["own_block"][s:e], unit[s:e], sizes[s:e], tops[s:e])
                if made is not None:
                    keep = (made[0] > 0) | (made[1] != reps)
                    found.append((reps[keep], made[0][keep], made[1][keep]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["rep", "links", "edge"])

    return run


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                           nearest: int | None = None, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df``'s ids with n_links, component_id and kept; cosine >= ``threshold`` in double precision links two rows.

    Equal vectors form one class, compared once. Each class is described by its ``nearest``
    reference points (by default more of them the more there are); two of them shared make a candidate, retrieved from the inverted list of that
    pair of pivots. Long lists are cut into blocks and all pairs of blocks compared, so no list has
    a cap. Candidates are verified exactly; what can be missed is a pair that shares fewer than two
    pivots (recall is measured in the tests).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    id, link with nothing. Vectors of different length are never linked. Equal rows each count as a
    vector. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("__ok", F.col("__id").isNotNull() & _valid("vector"))
    rows = rows.withColumns({"__h1": F.when(F.col("__ok"), F.xxhash64("vector")), "__h2": F.when(F.col("__ok"), F.xxhash64(F.lit(1), "vector"))})
    classes = stage_table(rows.where("__ok").groupBy(*_CLASS).agg(F.min("__id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")), "vector-classes")
    count, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    points = choose_pivots(classes, width or 1, count, pivots)
    spread = max(1, classes.sparkSession.sparkContext.defaultParallelism)
    source = classes.select("rep", "copies", "vector")
    described = stage_table(source.repartition(spread) if source.rdd.getNumPartitions() < spread else source, "vector-input").mapInArrow(
        _describe(points, nearest or nearest_pivots(len(points))), f"rep long, copies long, vector {dict(classes.dtypes)['vector']}, permutation array<int>, lists array<long>")
    described = stage_table(described, "pivot-index")
    members = described.select("rep", "copies", "vector", "permutation", F.explode("lists").alias("key"))
    found = stage_table(paired_blocks(members, "rep", block_rows).mapInArrow(_verify(width or 1, threshold), "rep long, links long, edge long"), "vector-links")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("__links")).join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = lookup_join(rows.select("__id", *_CLASS), classes.where("copies > 1").select(*_CLASS, F.col("rep").alias("__rep"), "copies"), _CLASS, "left")
    named = named.withColumn("rep", F.coalesce("__rep", "__id"))
    out = lookup_join(named, linked, ["rep"], "left")
    component = F.when(F.col("__h1").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("__id"))
    links = F.when(F.col("__h1").isNotNull(), F.coalesce("__links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(F.lit(0))
    return out.select(F.col("__id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))
