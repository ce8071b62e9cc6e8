"""Hard negatives by anchor clusters that share one sorted candidate list (after MAXIMUS, Abuzaid et al. 2019)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.integer_vectors import integer_vectors
from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
SHARE = (30, 90)
CENTROID_BYTES = 8 << 20
UNIT_ANCHORS = 32_768
STRIPE_ROWS = 1 << 20
CHUNK_ROWS = 16_384
_LEAST_STRIPE = 4096
_BLOCK_SCORES = 1 << 20
_FIRST_STEP = 128
_ROUNDS = 2
_SEEN = "anchor long, slot int, target long, target_score long, found long, score long"


class _Walk:
    """The anchors of a unit walking the candidates of a stripe, cluster by cluster.

    Each anchor fills ``slots`` lists of the ``k`` best candidates with a score between the slot's
    bounds, ties to the smaller id. A candidate at angle t from the centre of a cluster of angular
    radius r scores at most |anchor| |candidate| cos(max(0, t - r)) with any of its members. A chunk
    of candidates is sorted by that bound once for each cluster; a member stops where the bound
    falls below its lists' last entries or lower bounds.
    """

    def __init__(self, ids, labels, x, clusters, centres, k, same, low, high):
        self.ids, self.labels, self.x, self.k, self.same = ids, labels, x, k, same
        self.low, self.high = low.astype(x.dtype), high.astype(x.dtype)  # members x slots
        self.slots = low.shape[1]
        self.last = self.low.copy()
        self.norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.groups = []
        for c in np.unique(clusters):
            members = np.flatnonzero(clusters == c)
            cosine = (x[members] @ centres[c]) / np.maximum(self.norms[members], 1e-300)
            angle = np.arccos(np.clip(np.where(self.norms[members] > 0, cosine, 1.0), -1.0, 1.0))
            self.groups.append((members, centres[c], float(angle.max()) + 1e-7))
        self.pool = (np.zeros(0, np.int64), np.zeros(0, x.dtype), np.zeros(0, np.int64))

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        for members, centre, radius in self.groups:
            cosine = (x @ centre) / np.maximum(norms, 1e-300)
            bound = norms * np.cos(np.maximum(0.0, np.arccos(np.clip(cosine, -1.0, 1.0)) - radius))
            order = np.argsort(-bound, kind="stable")
            at, step = 0, _FIRST_STEP
            while at < len(order):
                reach = self.norms[members] * bound[order[at]]
                reach += np.abs(reach) * 1e-6 + 1e-3
                members = members[(reach[:, None] >= self.last[members]).any(axis=1)]
                if not len(members):
                    break
                here = order[at:at + step]
                self._score(members, ids[here], labels[here], x[here])
                at, step = at + step, max(_FIRST_STEP, min(2 * step, _BLOCK_SCORES // len(members)))

    def _score(self, members, ids, labels, x) -> None:
        scores = self.x[members] @ x.T
        alike = self.labels[members][:, None] == labels[None, :]
        open_to = alike & (self.ids[members][:, None] != ids[None, :]) if self.same else ~alike
        entries = [self.pool]
        for s in range(self.slots):
            low, high = self.last[members, s][:, None], self.high[members, s][:, None]
            fit = np.where(open_to & (scores >= low) & (scores <= high), scores, -np.inf)
            if fit.shape[1] > self.k:
                kth = np.partition(fit, -self.k, axis=1)[:, -self.k][:, None]
                i, j = np.nonzero((fit >= kth) & (fit > -np.inf))
            else:
                i, j = np.nonzero(fit > -np.inf)
            if len(i):
                entries.append((members[i] * self.slots + s, scores[i, j], ids[j]))
        if len(entries) == 1:
            return
        key, score, found = (np.concatenate(c) for c in zip(*entries))
        order = np.lexsort((found, -score, key))
        key, score, found = key[order], score[order], found[order]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        rank = np.arange(len(key)) - np.repeat(first, count)
        keep = rank < self.k
        full = rank == self.k - 1
        self.pool = key[keep], score[keep], found[keep]
        self.last.ravel()[key[full]] = np.maximum(self.last.ravel()[key[full]], score[full])


def _list_of(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _targets(column: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column filled up to ``slots``, and which places are real."""
    sizes = np.diff(column.offsets.to_numpy())
    real = np.arange(slots)[None, :] < sizes[:, None]
    out = np.zeros(real.shape, np.int64)
    out[real] = column.flatten().to_numpy()
    return out, real


def _walks(centres: np.ndarray, kind: type, k: int, slots: int, same: bool, share: tuple[int, int]):
    """Rows sorted by unit, stripe and side (anchors first) as the best of each anchor in each stripe."""

    def started(parts: list[pa.RecordBatch]) -> tuple[_Walk, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        col = {c: table.column(c).chunk(0) for c in table.column_names}
        targets, real = _targets(col["targets"], slots)
        scores, _ = _targets(col["target_scores"], slots)
        if same:
            low, high = np.full((len(real), 1), -np.inf), np.full((len(real), 1), np.inf)
        else:
            low, high = np.where(real, -(-share[0] * scores // 100), np.inf), np.where(real, share[1] * scores // 100, -np.inf)
        walk = _Walk(col["id"].to_numpy(), col["label"].to_numpy(zero_copy_only=False), _list_of(col["x"], kind), col["cluster"].to_numpy(), centres, k, same, low, high)
        return walk, targets, scores

    def finished(walk: _Walk, targets: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        key, score, found = walk.pool
        member, slot = np.divmod(key, walk.slots)
        columns = [walk.ids[member], slot.astype(np.int32), targets[member, slot], scores[member, slot], found, score.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SEEN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, anchors, waiting, held = None, None, [], [], 0

        def meet() -> None:
            nonlocal waiting, held
            if waiting and walk is not None:
                table = pa.Table.from_batches(waiting).combine_chunks()
                walk[0].meet(table.column("id").to_numpy(), table.column("label").to_numpy(), _list_of(table.column("x").chunk(0), kind))
            waiting, held = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy() for c in ("unit", "stripe", "side")])
            edges = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                unit, stripe, side = places[:, a].tolist()
                if (unit, stripe) != now:
                    meet()
                    if walk is not None:
                        yield finished(*walk)
                    now, walk, anchors = (unit, stripe), None, []
                if side == 0:
                    anchors.append(batch.slice(a, b - a))
                    continue
                if walk is None and anchors:
                    walk, anchors = started(anchors), []
                waiting.append(batch.slice(a, b - a))
                held += b - a
                if held >= CHUNK_ROWS:
                    meet()
        meet()
        if walk is not None:
            yield finished(*walk)

    return run


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([(x[i:i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)])


def cluster_centres(anchors: DataFrame, count: int) -> np.ndarray:
    """Spherical k-means: seeds by key hash, then rounds of distributed sums. The centres fit into CENTROID_BYTES."""
    picked = anchors.orderBy(F.xxhash64("id"), "id").limit(count).select("x").toArrow()
    centres = _unit_rows(_list_of(picked.column("x").combine_chunks(), float))
    width = centres.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(centres.shape)
        for batch in batches:
            if batch.num_rows:
                x = _unit_rows(_list_of(batch.column("x"), float))
                np.add.at(total, _nearest(centres, x), x)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "value"])

    for _ in range(_ROUNDS):
        moved = np.zeros(centres.size)
        for r in anchors.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            moved[r["cell"]] = r["value"]
        moved = moved.reshape(-1, width)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, _unit_rows(moved), centres)
    return centres


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(centres, _unit_rows(_list_of(batch.column("x"), float)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    return run


def _units(anchors: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Anchors with the unit they walk in: whole clusters side by side up to ``limit`` anchors, larger clusters in parts."""
    sizes = sorted((r["cluster"], r["count"]) for r in anchors.groupBy("cluster").count().collect())  # one row a centre
    plan, unit, room = [], 0, limit
    for cluster, size in sizes:
        if size > room and room < limit:
            unit, room = unit + 1, limit
        parts = -(-size // limit)
        plan.append((cluster, unit, parts))
        unit, room = (unit + parts, limit) if parts > 1 else (unit, room - size)
    table = anchors.sparkSession.createDataFrame(plan, "cluster int, __unit int, __parts int")
    placed = anchors.join(F.broadcast(table), "cluster")
    return placed.withColumn("unit", F.col("__unit") + F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__unit", "__parts"), unit + (room < limit)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor_every: int = 100, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, share: tuple[int, int] = SHARE, scale: int = SCALE, clusters: int | None = None, unit_anchors: int = UNIT_ANCHORS, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become integers floor(scale * c); a score is an integer inner product, larger ones
    first, ties by the smaller id. An anchor is a row whose id is divisible by ``anchor_every``; its
    positives are its best ``positives`` rows of the same label, and for each of them the best
    ``negatives`` rows of other labels are returned whose score in hundredths of the positive's lies
    in ``share``. Positives and negatives are two walks over the same lists. All rows are candidates,
    in stripes by key hash; units of clustered anchors meet every stripe, and each task keeps
    the best of its stripe only. Results are exact whatever the clusters, which only tell where to stop.

    Rows with a null id, label or vector, with null or non-finite components, with a vector of other than the
    most frequent length or a squared integer length of 2^53 or more take no part. Of rows that
    share an id one takes part, the smallest by label and vector. Anchors without positives, and
    positives without negatives in the range, give no rows; an empty table gives none.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), id_col, vector_col, scale, 0, label=F.col(label_col))
    size = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    vectors = vectors.where(size < 2.0 ** 53)
    one = vectors.groupBy("id").agg(F.min(F.struct("label", F.col("x").cast("array<int>").alias("x"))).alias("row"))
    rows = stage_table(one.select("id", "row.label", "row.x"), "candidates")
    anchors = rows.where(F.col("id") % anchor_every == 0)
    count, largest = rows.agg(F.count("*"), F.max(size)).first()
    asked = anchors.count()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return spark.createDataFrame([], result)
    width = rows.select(F.size("x")).first()[0]
    centres = cluster_centres(anchors, max(1, min(asked, clusters or math.ceil(asked ** 0.5 / 2), CENTROID_BYTES // (8 * width))))
    kind = np.float32 if largest < 2 ** 24 else np.float64
    found = anchors.mapInArrow(_assigned(centres), f"id long, label {rows.schema['label'].dataType.simpleString()}, x array<int>, cluster int")
    placed, units = _units(stage_table(found, "clustered-anchors"), unit_anchors)
    cores = spark.sparkContext.defaultParallelism
    stripes = max(-(-count // stripe_rows), min(-(-2 * cores // units), -(-count // _LEAST_STRIPE)))

    def walked(asking: DataFrame, k: int, slots: int, same: bool) -> DataFrame:
        left = asking.select("unit", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("side"), "id", "label", "x", "cluster", "targets", "target_scores")
        none = F.array().cast("array<long>")
        right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"), F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(1).alias("side"),
                            "id", "label", "x", F.lit(0).alias("cluster"), none.alias("targets"), none.alias("target_scores"))
        met = left.unionByName(right).repartition(units * stripes, "unit", "stripe").sortWithinPartitions("unit", "stripe", "side")
        seen = met.mapInArrow(_walks(centres, kind, k, slots, same, share), _SEEN)
        best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found")
        return seen.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)

    empty = F.array().cast("array<long>")
    near = walked(placed.withColumns({"targets": empty, "target_scores": empty}), positives, 1, True)
    listed = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "found", "score"))).alias("best"))  # at most `positives` entries
    targets = listed.select(F.col("anchor").alias("id"), F.col("best.found").alias("targets"), F.col("best.score").alias("target_scores"))
    asking = lookup_join(placed, targets, ["id"])
    out = walked(asking, negatives, positives, False)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("target").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
                      F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"))
