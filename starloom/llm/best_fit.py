"""Vector best-fit packing: few sequences, each within a token, a document and an attention capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.tokens import BatchEncoder
from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

SEQUENCE_TOKENS = 2048
END_ID = 0
WEIGHTS = (1.0, 0.1, 0.1)
RULES = ("residual_norm", "dot_product")
_PIECES = "part int, id long, piece int, start long, length long, ids_crc32 long, nth long"
_PLACED = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold: tokens, pieces, and the sum of the squares of their lengths.

    By default only the tokens bind: no more than ``tokens`` pieces and no larger sum of squares can come together.
    """

    tokens: int = SEQUENCE_TOKENS
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2


class Placement(NamedTuple):
    """``count`` pieces of one length, from rank ``first`` among these, one into each sequence from ``sequence`` on."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def best_fit(sizes: Mapping[int, int], capacities: Capacities = Capacities(), weights: Sequence[float] = WEIGHTS,
             rule: str = "residual_norm") -> list[Placement]:
    """Sequences for ``sizes`` (pieces by length), longest pieces first, each into the best that has room in every dimension.

    A piece is the vector (length, 1, length squared) and a sequence's state what is left of its
    capacities, all as shares of these. The best state has the smallest weighted norm of what would
    be left (``residual_norm``) or the largest weighted product with the piece (``dot_product``).
    Sequences of equal state are handled together and pieces of equal length too: a chosen sequence
    takes as many of them as fit. So the work depends on lengths and states, not on the number of
    pieces. A piece that passes a capacity on its own gets a sequence to itself.
    """
    if rule not in RULES:
        raise ValueError(f"no rule is called {rule}")
    full = capacities.vector()
    scale, weight = np.array(full, float), np.array(weights, float)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # what is left -> ranges of sequences
    out, fresh = [], 0

    def fill(length: int, first: int, left: int, state: tuple[int, int, int], sequence: int, held: int) -> int:
        """Put up to ``left`` pieces into the ``held`` sequences from ``sequence`` on; how many were put."""
        item, put = (length, 1, length * length), 0
        while held and left > put and (all(r >= i for r, i in zip(state, item)) or state == full):
            count = min(held, left - put)
            out.append(Placement(length, first + put, count, sequence, full[0] - state[0]))
            if count < held:
                states.setdefault(state, []).append((sequence + count, held - count))
            state, held, put = tuple(max(r - i, 0) for r, i in zip(state, item)), count, put + count
        if held:
            states.setdefault(state, []).append((sequence, held))
        return put

    for length in sorted(sizes, reverse=True):
        left, first, item = sizes[length], 0, np.array((length, 1, length * length))
        known = np.array(list(states), np.int64).reshape(-1, 3)
        rooms = known[(known >= item).all(axis=1)]
        score = ((weight * ((rooms - item) / scale) ** 2).sum(axis=1) if rule == "residual_norm" else -(weight * (rooms / scale) * (item / scale)).sum(axis=1))
        for k in np.lexsort((rooms[:, 2], rooms[:, 1], rooms[:, 0], score)):
            state = tuple(int(v) for v in rooms[k])
            fits = min(state[0] // length, state[1], state[2] // (length * length))
            ranges = states.pop(state)
            while ranges and left:
                sequence, held = ranges.pop()
                used = min(held, -(-left // fits))
                if used < held:
                    ranges.append((sequence + used, held - used))
                put = fill(length, first, left, state, sequence, used)
                first, left = first + put, left - put
            if ranges:
                states.setdefault(state, []).extend(ranges)
            if not left:
                break
        if left:
            fits = max(1, min(full[0] // length, full[1], full[2] // (length * length)))
            opened = -(-left // fits)
            fill(length, first, left, full, fresh, opened)
            fresh += opened
    return out


def _cut(vocabulary: str | None, end_id: int, size: int):
    """Pieces of at most ``size`` tokens, each with its rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = BatchEncoder(vocabulary, end_id), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tokens = encoder.encode(batch.column("text"))
            pieces = -(-tokens // size)
            row = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(tokens[row] - start, size)
            place = (np.cumsum(tokens) - tokens)[row] + start
            wide = memoryview(ids.astype("<u4"))
            crc = [zlib.crc32(wide[a:a + n]) for a, n in zip(place.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            lengths, firsts, counts = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(firsts, counts) + seen[length[order]]
            seen[lengths] += counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), part, np.int32)), batch.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(nth)],
                names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def _place(plan: list[Placement]):
    """The sequence and offset of each piece, by its length and its rank among the pieces of that length."""
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    lengths, starts = np.unique(table[:, 0], return_index=True)
    stops = np.append(starts[1:], len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            entry = np.empty(len(length), np.int64)
            for value in np.unique(length):
                k, mine = np.searchsorted(lengths, value), length == value
                entry[mine] = starts[k] + np.searchsorted(table[starts[k]:stops[k], 1], rank[mine], "right") - 1
            found = [pa.array(table[entry, 3] + rank - table[entry, 1]), pa.array(table[entry, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), *found],
                                             names=[x.split()[0] for x in _PLACED.split(", ")])

    return run


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Capacities = Capacities(), weights: Sequence[float] = WEIGHTS,
                  rule: str = "residual_norm", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens, closed by ``end_id``, are one piece, or pieces of ``capacities.tokens`` and a
    rest where they are more. The first pass tokenises once and stages the pieces without their
    tokens, each with its rank among its task's pieces of the same length. Pieces differ for packing
    only by length, so counts by length, at most ``capacities.tokens`` of them, are all ``best_fit``
    needs; running sums of the counts over the tasks turn ranks into global ones, and a piece finds
    its sequence by (length, rank). The plan is one for the whole table, whatever its partitions.

    A null text is empty and has the end alone; a null id stays null; repeated rows are packed as
    often as they stand; texts of any length are whole; an empty table has no pieces.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    pieces = stage_table(texts.mapInArrow(_cut(vocabulary, end_id, capacities.tokens), _PIECES), "pieces")
    counts = stage_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ranked = lookup_join(pieces, first, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(best_fit(sizes, capacities, weights, rule)), _PLACED).withColumnRenamed("id", id_col)
