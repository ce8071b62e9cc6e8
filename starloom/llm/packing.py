"""Concatenate-and-cut packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.tokens import BatchEncoder, ChunkEncoder, default_vocabulary  # noqa: F401
from starloom.plans.session import stage_table

SEQUENCE_TOKENS = 4096
END_ID = 2
_TOKENS = "part int, before long, id long, length long, ids binary"
_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokenise(vocabulary: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = BatchEncoder(vocabulary, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, lengths = encoder.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            borders = (np.append(0, ends) * ids.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(borders), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), part, np.int32)), pa.array(before + ends - lengths), batch.column("id"), pa.array(lengths), packed],
                                             names=["part", "before", "id", "length", "ids"])
            before += int(lengths.sum())

    return run


def _cut(size: int):
    """Pieces of documents at the borders of the fixed windows; a piece that crosses none is the whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, place, length, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "place", "length", "ids"))):
                tokens = np.frombuffer(ids, f"<u{len(ids) // length}")
                start = 0
                while start < length:
                    sequence, offset = divmod(place + start, size)
                    take = min(length - start, size - offset)
                    rows.append((doc, start, take, zlib.crc32(tokens[start:start + take].astype("<u4").tobytes()), length, sequence, offset))
                    start += take
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence_tokens: int = SEQUENCE_TOKENS,
                   vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The token streams of all documents, each closed by ``end_id``, stand one after another and are cut
    every ``sequence_tokens``; only the last sequence can be short. The first pass tokenises once
    into a staged table with each document's place inside its partition; the running sum over the
    partitions' totals (one row a partition) gives global places; the second pass cuts.

    A null text is empty and has the end alone; a null id stays null; repeated rows are packed as
    often as they stand; texts of any length are cut whole; an empty table has no pieces.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    tokens = stage_table(texts.mapInArrow(_tokenise(vocabulary, end_id), _TOKENS), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("length").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    placed = tokens.join(F.broadcast(first), "part").select("id", (F.col("first") + F.col("before")).alias("place"), "length", "ids")
    return placed.mapInArrow(_cut(sequence_tokens), _PIECES).withColumnRenamed("id", id_col)
