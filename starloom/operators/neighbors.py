"""Exact nearest, farthest and in-radius search between vector tables.

Base rows are assigned to the nearest of a few pivots (a Voronoi partition). Cells that lie near each other are
packed into blocks of bounded size; a cell holding a third of the rows is cut into several. The triangle inequality
tells, per query, which cells can still hold an answer, and a query is sent once to each block with such a cell.
Queries come in blocks as well, by their own cell. A task compares one block of queries with one of base rows, a
bounded piece of the matrix of distances at a time, and returns at most k rows (or one count per label) per query
instead of all pairs. So a vector is copied once per block of the other side at most, and never once per cell.
Single-precision products choose the candidates, with a margin for their error; exact distances decide. Results are exact.

Where vectors have no clusters the bounds rule out few cells and the exact search meets most
pairs. ``probes`` is the way for that: a query visits its nearest cells only, and distances stay
exact. A whole number is a number of cells: with 2 sqrt(n) cells a query meets in the order of
probes * sqrt(n) rows instead of n, and recall falls as the table grows. A fraction is a share of
the rows: nearest cells are visited until they hold it, which keeps recall as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.hashing import key_hash
from starloom.plans.session import cut_lineage

BLOCK_ROWS, BLOCK_VALUES = 32_768, 1 << 22
MIN_PIVOTS, MAX_PIVOTS = 64, 2048
_SLACK = 1e-9
_ROUTED_VALUES = 1_000_000
#: Distances held at a time, rows whose distances give the first bound, and pairs whose exact distance is taken at a time.
_CHUNK_VALUES, _SAMPLE, _EXACT = 1 << 22, 2048, 1 << 15


@dataclass(frozen=True)
class _Cells:
    """Pivots and per-cell bounds; pivots x groups x k numbers at most."""

    pivots: np.ndarray
    gaps: np.ndarray                      # pivot-to-pivot distances
    stats: dict[tuple[int, int], tuple[int, float, float, np.ndarray]]  # (group, cell) -> rows, min, max, k extremes

    def packed(self) -> tuple[dict[tuple[int, int], tuple[int, int]], list[tuple[int, list[int]]]]:
        """First block and number of blocks of each (group, cell); group and cells of each block."""
        order, sizes = _chain(self.gaps), {key: info[0] for key, info in self.stats.items()}
        return _packed({g: [c for c in order if (g, c) in sizes] for g in sorted({g for g, _ in sizes})}, sizes, self.pivots.shape[1])


def _chain(gaps: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest that is left."""
    if not len(gaps):
        return []
    left, order = np.ones(len(gaps), bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.where(left, gaps[order[-1]], np.inf).argmin()) if np.isfinite(gaps[order[-1]][left]).any() else int(left.argmax()))
        left[order[-1]] = False
    return order


def _packed(ordered: dict[int, list[int]], sizes: dict[tuple[int, int], int], width: int) -> tuple[dict, list]:
    """Cells packed into blocks in the given order, larger ones cut; no block holds cells of two groups."""
    most = min(BLOCK_ROWS, max(2048, -(-sum(sizes.values()) // 8)), max(256, BLOCK_VALUES // max(1, width)))
    places, blocks = {}, []
    for g, cells in ordered.items():
        held = most
        for c in cells:
            n = sizes[(g, c)]
            if n > most:
                places[(g, c)] = (len(blocks), -(-n // most))
                blocks += [(g, [c])] * -(-n // most)
                held = most
                continue
            if held + n > most:
                blocks.append((g, []))
                held = 0
            places[(g, c)] = (len(blocks) - 1, 1)
            blocks[-1][1].append(c)
            held += n
    return places, blocks


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = a @ b.T
    squares *= -2.0
    squares += (a * a).sum(1)[:, None]
    squares += (b * b).sum(1)[None, :]
    np.maximum(squares, 0.0, out=squares)
    return np.sqrt(squares, out=squares)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _encoded(vectors: np.ndarray, single: bool) -> list[bytes]:
    """Each row as bytes: a count, then so many places and their values, or all values after a count of -1."""
    kind, counts = np.float32 if single else np.float64, np.count_nonzero(vectors, axis=1)
    out = []
    for row, n in zip(vectors, counts):
        if 2 * n < len(row):
            at = np.flatnonzero(row)
            out.append(np.int32(n).tobytes() + at.astype(np.int32).tobytes() + row[at].astype(kind).tobytes())
        else:
            out.append(np.int32(-1).tobytes() + row.astype(kind).tobytes())
    return out


def _decoded(column: pd.Series, width: int, single: bool) -> np.ndarray:
    out, kind = np.zeros((len(column), width)), np.float32 if single else np.float64
    for row, data in zip(out, column):
        n = int(np.frombuffer(data, np.int32, 1)[0])
        if n < 0:
            row[:] = np.frombuffer(data, np.uint8, offset=4).view(kind)
        else:
            row[np.frombuffer(data, np.int32, n, 4)] = np.frombuffer(data, np.uint8, offset=4 + 4 * n).view(kind)
    return out


def _slices(batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), step):
            yield batch.iloc[start:start + step]


def _key_type(df: DataFrame, key: str) -> str:
    """Integers of any width are longs; other keys keep their type."""
    kind = df.schema[key].dataType
    return "bigint" if isinstance(kind, T.IntegralType) else kind.simpleString()


def _single(df: DataFrame, vec: str) -> bool:
    """Vectors of floats stay such while they move; all others are doubles."""
    kind = df.schema[vec].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _prepare(df: DataFrame, key: str, vec: str, group: str | None, label: str | None) -> DataFrame:
    return df.select(F.col(key).cast(_key_type(df, key)).alias("id"), F.col(vec).cast("array<float>" if _single(df, vec) else "array<double>").alias("v"),
                     (F.col(group).cast("int") if group else F.lit(0)).alias("g"),
                     (F.col(label).cast("int") if label else F.lit(0)).alias("label"))


def _build(base: DataFrame, k: int, far: bool, pivots: int | None) -> tuple[DataFrame, _Cells]:
    """Assign base rows to cells and gather the bounds of every cell.

    Unless named, there are 2 sqrt(rows) pivots, so cells grow with the root of the table only (MAX_PIVOTS
    bounds what reaches the driver; larger cells are cut into blocks).
    """
    if pivots is None:
        pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, int(2 * base.count() ** 0.5)))
    kind, single = _key_type(base, "id"), _single(base, "v")
    chosen = base.orderBy(key_hash("id", 17), "id").limit(pivots).select("v").collect()
    if not chosen:
        empty = base.withColumns({"v": F.lit(None).cast("binary"), "cell": F.lit(0), "d": F.lit(0.0)})
        return empty, _Cells(np.zeros((0, 0)), np.zeros((0, 0)), {})
    points = np.array([r["v"] for r in chosen], dtype=np.float64)
    step = max(1, _ROUTED_VALUES // len(points))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, step):
            vectors = _matrix(batch["v"])
            d = _distances(vectors, points)
            cell = d.argmin(1)
            yield batch.assign(v=_encoded(vectors, single), cell=cell.astype("int32"), d=d[np.arange(len(d)), cell])

    assigned = cut_lineage(base.mapInPandas(assign, f"id {kind}, v binary, g int, label int, cell int, d double"))
    extreme = F.row_number().over(Window.partitionBy("g", "cell").orderBy(F.desc("d") if far else F.asc("d"), "id"))
    edge = assigned.select("g", "cell", "d", extreme.alias("r")).where(F.col("r") <= max(k, 1)).groupBy("g", "cell").agg(
        F.collect_list("d").alias("edge"))
    sizes = assigned.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    # one row per (group, pivot) with k numbers
    stats = {(r["g"], r["cell"]): (r["n"], r["low"], r["high"], np.array(r["edge"])) for r in sizes.join(edge, ["g", "cell"]).collect()}
    return assigned, _Cells(points, _distances(points, points), stats)


def _route(queries: DataFrame, cells: _Cells, k: int, mode: str, radius: float, probes: int | float | None = None) -> DataFrame:
    """Send each query to the blocks with cells that can hold an answer, or with its ``probes`` nearest ones.

    One row a query and block: its own cell, the block, the block's cells it asks (bits) and a bound on the distance of
    its k-th answer. A float in ``probes`` is the share of the (group's) rows that the nearest cells must hold. With
    ``probes`` further cells are visited until the visited ones hold k rows.
    """
    step = max(1, _ROUTED_VALUES // max(1, len(cells.pivots) * max(1, k)))
    single, (_, blocks) = _single(queries, "v"), cells.packed()

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_group: dict[int, list[int]] = {}
        for g, c in sorted(cells.stats):
            by_group.setdefault(g, []).append(c)
        asked_of: dict[int, list] = {}
        for number, (g, held) in enumerate(blocks):
            asked_of.setdefault(g, []).append((number, np.searchsorted(by_group[g], held)))
        for batch in _slices(batches, step):
            for g, part in batch.groupby("g"):
                members = by_group.get(int(g))
                if not members:
                    continue
                info = [cells.stats[(int(g), c)] for c in members]
                low, high = np.array([i[1] for i in info]), np.array([i[2] for i in info])
                vectors = _matrix(part["v"])
                every = _distances(vectors, cells.pivots)
                nearest = every.argmin(1)
                d = every[:, members]
                limit = np.full(len(d), np.inf)
                edge_cell = np.concatenate([[j] * len(i[3]) for j, i in enumerate(info)]).astype(int)
                edge = np.concatenate([i[3] for i in info])
                if probes is not None:
                    order = d.argsort(axis=1, kind="stable")
                    sizes = np.array([i[0] for i in info])
                    before = sizes[order].cumsum(axis=1) - sizes[order]
                    enough = before < probes * sizes.sum() if isinstance(probes, float) else np.arange(len(members)) < probes
                    keep = np.zeros(d.shape, bool)
                    np.put_along_axis(keep, order, enough | (before < k), axis=1)
                elif mode == "far":
                    limit = -limit
                    if len(edge) >= k:
                        limit = -np.partition(-np.abs(d[:, edge_cell] - edge), k - 1, axis=1)[:, k - 1]
                    keep = d + high >= limit[:, None] - _SLACK
                else:
                    if mode == "radius":
                        limit = np.full(len(d), radius)
                    elif len(edge) >= k:
                        limit = np.partition(d[:, edge_cell] + edge, k - 1, axis=1)[:, k - 1]
                    gap = cells.gaps[nearest][:, members]
                    own = every[np.arange(len(d)), nearest][:, None]
                    beyond = np.divide(d * d - own * own, 2 * gap, out=np.zeros_like(d), where=gap > 0)
                    bound = np.maximum(np.maximum(d - high, low - d), beyond)
                    keep = bound <= limit[:, None] + _SLACK
                lists = [[] for _ in range(len(d))]
                for number, places in asked_of[int(g)]:
                    wanted = keep[:, places]
                    bits = np.packbits(wanted, axis=1)
                    for i in np.flatnonzero(wanted.any(1)):
                        lists[i].append({"block": number, "cells": bits[i].tobytes()})
                yield pd.DataFrame({"id": part["id"].to_numpy(), "v": _encoded(vectors, single), "g": np.int32(g), "own": nearest.astype("int32"), "bound": limit, "asked": lists})

    kind = f"id {_key_type(queries, 'id')}, v binary, g int, own int, bound double, asked array<struct<block: int, cells: binary>>"
    return cut_lineage(queries.mapInPandas(route, kind)).select("id", "v", "g", "own", "bound", F.inline("asked"))


def _blocks(routed: DataFrame, assigned: DataFrame, cells: _Cells) -> tuple[DataFrame, DataFrame]:
    """Both sides by (base block, query block); every block of queries meets the base blocks that one of them asks."""
    spark = routed.sparkSession
    ids = routed.select("id", "g", "own").distinct()
    # one row per (group, pivot)
    sizes = {(r["g"], r["own"]): r["n"] for r in ids.groupBy("g", "own").agg(F.count("*").alias("n")).collect()}
    order = _chain(cells.gaps)
    query_places, _ = _packed({g: [c for c in order if (g, c) in sizes] for g in sorted({g for g, _ in sizes})}, sizes, cells.pivots.shape[1])
    base_places, _ = cells.packed()

    def placed(df: DataFrame, cell: str, places: dict, name: str) -> DataFrame:
        table = spark.createDataFrame([(*key, *place) for key, place in places.items()], f"g int, {cell} int, __first int, __parts int")
        own = F.col("__first") + F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")
        return df.join(F.broadcast(table), ["g", cell]).withColumn(name, own).drop("__first", "__parts")

    left = placed(routed, "own", query_places, "qb").select("block", "qb", "id", "v", "own", "bound", "cells")
    # one row a pair of blocks that meet
    pairs = spark.createDataFrame(left.select("block", "qb").distinct().collect(), "block int, qb int")
    right = placed(assigned, "cell", base_places, "block").select("block", "id", "v", "label", "cell")
    return left, right.join(F.broadcast(pairs), "block")


_KEYS = ["block", "qb"]


def _augmented(vectors: np.ndarray, kind: type, query: bool) -> np.ndarray:
    """Rows whose products are squared distances."""
    out = np.empty((len(vectors), vectors.shape[1] + 2), kind)
    squares = (vectors * vectors).sum(1)
    out[:, :-2] = -2.0 * vectors if query else vectors
    out[:, -2], out[:, -1] = (1.0, squares) if query else (squares, 1.0)
    return out


class _Unit:
    """One block of queries and one of base rows, both in the order of their cells."""

    def __init__(self, q: pd.DataFrame, b: pd.DataFrame, members: list[int], width: int, single: tuple[bool, bool], exclude_self: bool, masked: bool) -> None:
        self.q, self.b = q.sort_values("own", kind="stable"), b.sort_values("cell", kind="stable")
        self.qm, self.bm = (_decoded(side["v"], width, one) for side, one in zip((self.q, self.b), single))
        self.ids, self.others = self.q["id"].to_numpy(), self.b["id"].to_numpy()
        self.bounds, self.exclude_self, self.masked = self.q["bound"].to_numpy(), exclude_self, masked
        self.asked = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=len(members)) for x in self.q["cells"]]).astype(bool)
        place = {c: i for i, c in enumerate(members)}
        self.place = np.array([place[c] for c in self.b["cell"]])
        self.sides = {}
        with np.errstate(invalid="ignore", over="ignore"):
            self.reach = (np.sqrt((self.qm ** 2).sum(1).max()) + np.sqrt((self.bm ** 2).sum(1).max())) ** 2

    def slack(self, kind: type) -> float:
        """More than rounding can change a squared distance by."""
        return 2.0 * (self.qm.shape[1] + 16) * float(np.finfo(kind).eps) * self.reach

    def squares(self, rows: slice, columns: np.ndarray, kind: type) -> np.ndarray:
        if kind not in self.sides:
            self.sides[kind] = _augmented(self.qm, kind, True), _augmented(self.bm, kind, False)
        q, b = self.sides[kind]
        return q[rows] @ (b if len(columns) == len(b) else b[columns]).T

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Some queries and the base rows in cells that one of them asks."""
        step = max(1, _CHUNK_VALUES // len(self.bm))
        for start in range(0, len(self.qm), step):
            rows = slice(start, min(start + step, len(self.qm)))
            columns = np.flatnonzero(self.asked[rows].any(0)[self.place])
            if len(columns):
                yield rows, columns

    def kept(self, rows: slice, columns: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (place in the chunk's rows, place in its columns) count."""
        ok = np.ones(len(i), bool)
        if self.exclude_self:
            ok &= self.ids[rows][i] != self.others[columns][j]
        if self.masked:
            ok &= self.asked[rows][i, self.place[columns][j]]
        return ok

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of pairs of rows."""
        out = np.empty(len(i))
        step = max(1, _EXACT * 64 // self.qm.shape[1])
        for start in range(0, len(i), step):
            s = slice(start, start + step)
            out[s] = np.sqrt(((self.qm[i[s]] - self.bm[j[s]]) ** 2).sum(1))
        return out

    def within(self, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows no farther apart than ``radius``."""
        margin = self.slack(np.float32)
        for rows, columns in self.chunks():
            d = self.squares(rows, columns, np.float32)
            i, j = np.nonzero(d <= radius * radius + margin)
            near, ok = d[i, j] > radius * radius - margin, self.kept(rows, columns, i, j)
            ok[near] &= self.exact(rows.start + i[near], columns[j[near]]) <= radius
            yield rows.start + i[ok], columns[j[ok]]

    def best(self, k: int, far: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The k best pairs of each query's row, ties by the smaller key, with their distances."""
        sign = -1.0 if far else 1.0
        _, rank = np.unique(self.others, return_inverse=True)
        for rows, columns in self.chunks():
            for kind in (np.float32, np.float64):
                i, j = self.candidates(rows, columns, k, sign, kind)
                # near copies lie closer than single precision tells apart
                if len(i) <= 64 * (k + 8) * (rows.stop - rows.start):
                    break
            distance = self.exact(rows.start + i, columns[j])
            order = np.lexsort((rank[columns[j]], sign * distance, i))
            order = order[np.isfinite(distance[order])]
            i, j, distance = i[order], j[order], distance[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            kept = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
            yield rows.start + i[kept], columns[j[kept]], distance[kept]

    def candidates(self, rows: slice, columns: np.ndarray, k: int, sign: float, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the k best: a sample of the columns and the bound of the cells tell how far these reach."""
        known, margin = self.bounds[rows], self.slack(kind)
        limit = np.full(len(known), np.inf)
        if not self.exclude_self:
            # several rows with a query's own key may stand behind the bound of the cells
            finite = np.isfinite(known)
            limit[finite] = sign * np.square(known[finite]) + 2 * _SLACK * (1 + np.abs(known[finite]))
        few = columns[::max(1, len(columns) // max(_SAMPLE, 8 * k))]
        sample = sign * self.squares(rows, few, kind)
        i, j = (x.ravel() for x in np.indices(sample.shape))
        sample[~self.kept(rows, few, i, j).reshape(sample.shape)] = np.inf
        if sample.shape[1] >= k:
            limit = np.fmin(limit, np.partition(sample, k - 1, axis=1)[:, k - 1])
        limit, d = (limit + 2 * margin).astype(kind)[:, None], self.squares(rows, columns, kind)
        i, j = np.nonzero(d >= -limit if sign < 0 else d <= limit)
        ok = self.kept(rows, columns, i, j)
        return i[ok], j[ok]


def _search(queries: DataFrame, base: DataFrame, k: int, mode: str, radius: float, exclude_self: bool, pivots: int | None,
            probes: int | float | None = None) -> DataFrame:
    kind = _key_type(queries, "id")
    keys = {"id": "int64"} if kind == "bigint" else {}
    assigned, cells = _build(base, k + int(exclude_self), mode == "far", pivots)
    routed = _route(queries, cells, k + int(exclude_self), mode, radius, probes)
    left, right = _blocks(routed, assigned, cells)
    blocks, width, single = cells.packed()[1], cells.pivots.shape[1], (_single(queries, "v"), _single(base, "v"))

    def unit(group: tuple, q: pd.DataFrame, b: pd.DataFrame) -> _Unit | None:
        return _Unit(q, b, blocks[int(group[0])][1], width, single, exclude_self, probes is not None) if len(q) and len(b) else None

    def best(group: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, met = [pd.DataFrame({"id": [], "neighbor": [], "label": [], "distance": []})], unit(group, q, b)
        if met:
            labels = met.b["label"].to_numpy()
            out = [pd.DataFrame({"id": met.ids[i], "neighbor": met.others[j], "label": labels[j], "distance": d}) for i, j, d in met.best(k, mode == "far")] or out
        return pd.concat(out).astype({**keys, **{"neighbor": t for t in keys.values()}, "label": "int32", "distance": "float64"})

    def votes(group: tuple, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, met = [pd.DataFrame({"id": [], "label": [], "n": []})], unit(group, q, b)
        if met:
            labels, code = np.unique(met.b["label"].to_numpy(), return_inverse=True)
            for i, j in met.within(radius):
                pairs, n = np.unique(i * len(labels) + code[j], return_counts=True)
                out.append(pd.DataFrame({"id": met.ids[pairs // len(labels)], "label": labels[pairs % len(labels)], "n": n}))
        return pd.concat(out[1:] or out).astype({**keys, "label": "int32", "n": "int64"})

    grouped = left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS))
    if mode == "radius":
        return grouped.applyInPandas(votes, f"id {kind}, label int, n long").groupBy("id", "label").agg(F.sum("n").alias("n"))
    found = grouped.applyInPandas(best, f"id {kind}, neighbor {kind}, label int, distance double")
    order = [F.desc("distance") if mode == "far" else F.asc("distance"), F.asc("neighbor")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, group: str | None = None, label: str | None = None,
            exclude_self: bool = False, pivots: int | None = None, probes: int | float | None = None) -> DataFrame:
    """The ``k`` nearest base rows of each query: (id, neighbor, label, distance, rank).

    With ``group`` only rows of the same group are neighbours. Ties go to the smaller key. With
    ``probes`` the search is approximate: only rows in so many nearest cells are met, or, with a
    float, in those that hold this share of the rows.
    """
    return _search(_prepare(queries, key, vec, group, None), _prepare(base, key, vec, group, label), k, "near", 0.0, exclude_self, pivots, probes)


def farthest(queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, pivots: int | None = None) -> DataFrame:
    """The ``k`` farthest base rows of each query."""
    return _search(_prepare(queries, key, vec, None, None), _prepare(base, key, vec, None, None), k, "far", 0.0, False, pivots)


def radius_votes(queries: DataFrame, base: DataFrame, key: str, vec: str, radius: float, label: str, exclude_self: bool = False,
                 pivots: int | None = None) -> DataFrame:
    """Base rows within ``radius`` of each query, counted per label: (id, label, n)."""
    return _search(_prepare(queries, key, vec, None, None), _prepare(base, key, vec, None, label), 1, "radius", radius, exclude_self, pivots)


def majority(votes: DataFrame) -> DataFrame:
    """Most frequent label per id (smallest label on ties) from (id, label, n)."""
    return votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


def knn_classify(queries: DataFrame, base: DataFrame, key: str, vec: str, label: str, k: int = 5, exclude_self: bool = False,
                 probes: int | float | None = None, graph: bool = False) -> DataFrame:
    """k-nearest-neighbour class of each query; ``graph`` asks the neighbour graph, also for sparse ML vectors.

    With ``graph`` and ``exclude_self`` the queries must be rows of the base.
    """
    if graph:
        from starloom.operators.neighbor_graph import graph_nearest

        found = graph_nearest(base, key, vec, k, None if exclude_self else queries, label=label)
        if exclude_self:
            found = found.join(queries.select(F.col(key).alias("id")), "id", "left_semi")
    else:
        found = nearest(queries, base, key, vec, k, label=label, exclude_self=exclude_self, probes=probes)
    return majority(found.groupBy("id", "label").agg(F.count("*").alias("n")))


def radius_classify(queries: DataFrame, base: DataFrame, key: str, vec: str, label: str, radius: float, exclude_self: bool = False) -> DataFrame:
    """Radius-neighbour class of each query; null for rows without neighbours."""
    voted = majority(radius_votes(queries, base, key, vec, radius, label, exclude_self))
    return queries.select(F.col(key).cast(_key_type(queries, key)).alias("id")).join(voted, "id", "left")
