"""Near-duplicate documents: universal hash minima, banding, verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.blocks import grouped_rows, paired_blocks
from starloom.llm.components import connected_components
from starloom.llm.words import WordHashes, joined, mix
from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
BANDS = 36
ROWS_PER_BAND = 6
BLOCK_ROWS = 1024
_SEED = 20_240_607
_SLICE = 2048


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; fewer words than one shingle make one of the whole text."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(joined(hashes, min(words, len(hashes))))


class Minima:
    """``bands * rows`` members of the family a * x + b modulo 2^32 with odd a, over mixed shingle hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.band = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), _SLICE):
            low = np.minimum(low, (self.a[:, None] * x[None, s:s + _SLICE] + self.b[:, None]).min(axis=1))
        return low

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, different for equal minima in different bands."""
        return joined_rows(signature.reshape(self.bands, self.rows).astype(np.uint64), self.band)


def joined_rows(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for k in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return out


def _describe(words: int, bands: int, rows: int):
    """Set size, 128-bit set fingerprint, band keys and the low byte of every minimum, for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, minima = WordHashes(), Minima(bands, rows)
        for batch in batches:
            sizes, prints, keys, lows = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(known.of(text), words)
                sizes.append(len(found))
                prints.append((found.sum(dtype=np.uint64), mix(found ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
                if len(found):
                    signature = minima.signature(found)
                    keys.append(minima.keys(signature).view(np.int64))
                    lows.append((signature & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(np.zeros(0, np.int64))
                    lows.append(b"")
            prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
                names=["id", "n_shingles", "p1", "p2", "bands", "low"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            made = [shingle_set(known.of(text), words).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.large_binary() if sum(map(len, made)) >> 31 else pa.binary())], names=["id", "shingles"])

    return run


def least_agreement(percent: int, minima: int) -> int:
    """Equal low bytes below which a pair cannot have the similarity, but for a chance under 1e-6 (five deviations)."""
    p = percent / 100
    return max(1, int(minima * p - 5 * (minima * p * (1 - p)) ** 0.5))


def _agreeing(least: int):
    """Pairs whose verification signatures agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
                keep = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _confirm(percent: int):
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _candidates(table: pa.Table, bounds: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row by row of the units, the rows of other components that may be alike and were not met in an earlier band.

    A pair that shares several bands belongs to the unit of the first of them.
    """
    key, parts, sizes, own, left, right = (table.column(c).to_numpy() for c in ("key", "part", "n_shingles", "own_block", "left_block", "right_block"))
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(key), -1)
    bands = np.stack(table.column("bands").to_numpy())
    for s, e in zip(bounds[:-1], bounds[1:]):
        same = left[s] == right[s]
        rows = np.arange(s, e)
        a, b = (rows, rows) if same else (rows[own[s:e] == left[s]], rows[own[s:e] == right[s]])
        for x in a:
            others = b[(parts[b] != parts[x]) & ((b > x) | (not same))]
            others = others[100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])]
            others = others[(low[others] == low[x]).sum(axis=1) >= least]
            if len(others):
                others = others[bands[x][(bands[others] == bands[x]).argmax(axis=1)] == key[s]]
            if len(others):
                yield x, others


def _active(least: int, percent: int):
    """(key, id) of the rows that have a candidate in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped_rows(batches):
            found = np.zeros(table.num_rows, bool)
            for x, others in _candidates(table, bounds, least, percent):
                found[x] = found[others] = True
            yield from table.select(["key", "id"]).filter(pa.array(found)).to_batches()

    return run


def _across(least: int, percent: int):
    """Links between components, verified on full sets inside each unit; each merge of two components is given once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped_rows(batches):
            ids, parts = table.column("id").to_numpy(), table.column("part").to_numpy()
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
            merged, found = {}, []

            def root(part: int) -> int:
                while part in merged:
                    part = merged[part]
                return part

            for x, others in _candidates(table, bounds, least, percent):
                others = others[np.array([root(p) != root(parts[x]) for p in parts[others]])]
                if not len(others):
                    continue
                lengths = np.array([len(sets[y]) for y in others])
                all_of = np.concatenate([sets[y] for y in others])
                place = np.minimum(np.searchsorted(sets[x], all_of), len(sets[x]) - 1)
                both = np.add.reduceat((sets[x][place] == all_of).astype(np.int64), np.cumsum(lengths) - lengths)
                for y in others[100 * both >= percent * (lengths + len(sets[x]) - both)]:
                    mine, other = root(parts[x]), root(parts[y])
                    if mine != other:
                        merged[max(mine, other)] = min(mine, other)
                        found.append((ids[x], ids[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def near_duplicate_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                             percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS_PER_BAND, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Two documents are linked when their sets of distinct word shingles have 100 * intersection >=
    ``percent`` * union. Documents with equal sets form a class and only its smallest id goes on; the
    others take its component at the end, so copies, however many, are no links of the star steps. The
    classes' minima are cut into bands; classes that share a band are candidates, checked on their
    minima and then exactly on their full sets. Each bucket is first verified against its smallest
    id. Pairs of different components that still share a bucket are then verified inside blocks of
    the bucket, each pair in one place, and only what merges components leaves a task. So a bucket
    has no cap, no link between components is left out and pairs never become rows. With 36 bands of 6 a pair at exactly 0.8 is missed with a chance of 2e-5.

    Texts without words (null or blank) have an empty set and link with nothing. Rows with a null id
    link with nothing, have a null component and are kept. Rows that share an id are one node. Word
    and shingle hashes have 64 bits. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = stage_table(texts.mapInArrow(_describe(shingle_words, bands, rows), "id long, n_shingles long, p1 long, p2 long, bands array<long>, low binary"), "minima")
    able = described.where("n_shingles > 0 and id is not null")
    classes = stage_table(able.groupBy("p1", "p2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "text-classes")
    copies = stage_table(lookup_join(able.select("id", "p1", "p2", "n_shingles"), classes.where("copies > 1"), ["p1", "p2", "n_shingles"]).where("id <> rep").select("id", "rep"), "copies")
    again = stage_table(able.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")
    tied = lookup_join(copies, again, ["id"], "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = able.join(classes.select(F.col("rep").alias("id"), "p1", "p2", "n_shingles"), ["id", "p1", "p2", "n_shingles"], "left_semi").dropDuplicates(["id", "p1", "p2"])
    buckets = reps.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("key", "first")
    members = stage_table(lookup_join(buckets, shared, ["key"]), "band-members")
    lows = stage_table(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "n_shingles", "bands", "low"), "minima-of-members")
    sets = stage_table(lookup_join(texts, lows.select("id").distinct(), ["id"], "left_semi").mapInArrow(_sets(shingle_words), "id long, shingles binary"), "shingle-sets")
    least = least_agreement(percent, bands * rows)

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"))
        return full.mapInArrow(_confirm(percent), "a long, b long")

    stars = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    likely = (stars.join(lows.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a")
              .join(lows.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b").mapInArrow(_agreeing(least), "a long, b long"))
    parts = stage_table(connected_components(confirmed(likely).union(tied)), "near-parts")
    placed = members.select("key", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("part").alias("__least"), F.max("part").alias("__most")).where("__least <> __most").select("key")
    left = lookup_join(placed, mixed, ["key"], "left_semi").join(lows, "id")
    active = paired_blocks(left, "id", block_rows).mapInArrow(_active(least, percent), "key long, id long").distinct()
    active = stage_table(active.join(left, ["key", "id"]), "across-candidates")
    more = stage_table(paired_blocks(active.join(sets, "id"), "id", block_rows).mapInArrow(_across(least, percent), "a long, b long"), "across-links")
    if not more.isEmpty():
        parts = connected_components(more.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    followed = lookup_join(lookup_join(copies, again, ["id"], "left_anti"), parts.withColumnRenamed("node", "rep"), ["rep"], "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = described.select("id", "n_shingles").join(parts.withColumnRenamed("node", "id").unionByName(followed), "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
                      F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies (that of the smallest id).

    Of rows with the same id one stays; rows with a null id all stay.
    """
    found = near_duplicate_documents(docs, id_col, **options).where("kept").select(F.col(id_col).alias("__kept")).where("__kept is not null").distinct()
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(found, named[id_col].cast("long") == F.col("__kept"), "left_semi")
    once = kept.withColumn("__nth", F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(options.get("text_col", "text"))))).where("__nth = 1").drop("__nth")
    return once.unionByName(docs.where(F.col(id_col).isNull()))
