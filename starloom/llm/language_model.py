"""Interpolated modified Kneser-Ney n-gram model, counted by Spark and kept as sorted hash arrays."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.storage import local_path, open_seekable, publish
from starloom.llm.words import WordHashes, mix
from starloom.plans.session import fresh_path, stage_table

ORDER = 2
SHARD_BYTES = 32 << 20
_CHUNK_TOKENS = 2_000_000
_LARGE = 255
_WORD_BITS = np.uint64((1 << 48) - 1)
_BEGIN, _END = np.uint64(1), np.uint64(2)
_ADD = 0.1


def _tokens(known: WordHashes, text: str | None) -> np.ndarray:
    """48-bit word hashes of a text and one end."""
    return np.append(known.of(text) & _WORD_BITS, _END)


def _contexts(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For orders 2..n, the hash of the words before each token of a text, filled up with begins."""
    filled = np.concatenate([np.full(order - 1, _BEGIN, np.uint64), tokens])
    out, state = [], np.zeros(len(tokens), np.uint64)
    for back in range(1, order):
        state = mix(state * np.uint64(0x9E3779B97F4A7C15) + filled[order - 1 - back:len(filled) - back])
        out.append(state)
    return out


def _entry_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) ^ mix(word))


def _grouped(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with equal first two columns (context and word) summed; sorted by them."""
    order = np.lexsort((columns[1], columns[0]))
    columns, counts = [c[order] for c in columns], counts[order]
    new = np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]) if len(counts) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], (np.add.reduceat(counts, starts) if len(starts) else counts)


def _pack_words(words: np.ndarray) -> bytes:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8")


_PIECE = "level int, shard int, contexts binary, runs binary, words binary, lower binary, counts binary"


def _pieces(level: int, columns: list[np.ndarray], counts: np.ndarray, shards: int) -> Iterator[dict]:
    """Sorted entries cut by shard: contexts once with their run lengths, 6-byte words, counts.

    Level 1 has no context and is cut by word, any other level by context.
    """
    by = columns[0] if level > 1 else mix(columns[1])
    at = (by % np.uint64(shards)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(shards + 1))
    for shard in range(shards):
        rows = order[edges[shard]:edges[shard + 1]]
        if len(rows):
            contexts, runs = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            if level > 1:
                own = columns[0][rows]
                starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                contexts, runs = own[starts], np.diff(np.append(starts, len(own))).astype(np.uint32)
            lower = b"".join(c[rows].tobytes() for c in columns[2:])
            yield {"level": level, "shard": shard, "contexts": contexts.tobytes(), "runs": runs.tobytes(), "words": _pack_words(columns[1][rows]),
                   "lower": lower, "counts": _narrow(counts[rows]).tobytes()}


def _read_pieces(level: int, pieces: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of one shard, summed over the pieces."""
    parts = []
    for p in pieces.itertuples():
        words = _unpack_words(p.words)
        contexts = np.repeat(np.frombuffer(p.contexts, np.uint64), np.frombuffer(p.runs, np.uint32)) if level > 1 else np.zeros(len(words), np.uint64)
        lower = np.frombuffer(p.lower, np.uint64).reshape(-1, len(words)) if len(p.lower) else np.zeros((0, len(words)), np.uint64)
        parts.append(([contexts, words, *lower], np.frombuffer(p.counts, np.uint32 if len(p.counts) == 4 * len(words) else np.int64).astype(np.int64)))
    return _grouped([np.concatenate(c) for c in zip(*(x[0] for x in parts))], np.concatenate([x[1] for x in parts]))


def _count(order: int, shards: int):
    """n-gram counts of a task's texts, summed over some millions of tokens at a time.

    Level ``order`` has the n-grams, level 0 the single words (for the base score); levels between
    are continuation counts and come from the level above.
    """

    def flush(texts: list[np.ndarray]) -> Iterator[dict]:
        if order > 1:
            levels = [np.concatenate(c) for c in zip(*(_contexts(t, order) for t in texts))]
            columns = [levels[-1], np.concatenate(texts), *levels[:-1][::-1]]
            yield from _pieces(order, *_grouped(columns, np.ones(len(columns[1]), np.int64)), shards)
        words, counts = np.unique(np.concatenate(texts), return_counts=True)
        for piece in _pieces(1, [np.zeros(0), words], counts, shards):
            yield piece | {"level": 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.append(_tokens(known, text))
                size += len(waiting[-1])
                if size >= _CHUNK_TOKENS:
                    yield from map(_row, flush(waiting))
                    waiting, size = [], 0
        if waiting:
            yield from map(_row, flush(waiting))

    return run


def _row(piece: dict) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece.values(), kinds)], names=list(piece))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


_SUMMARY = _PIECE + ", entries long, total long, n1 long, n2 long, n3 long, n4 long"


def _merge(folder: str, level: int, shards: int):
    """Sums one shard of a level, writes its arrays, and gives what the next lower level counts.

    The plain word counts that travel along (level 0) are only summed. Counts take a byte; those
    from 255 on stand in an array of their own.
    """

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        shard, summary = int(pieces["shard"].iloc[0]), [0] * 6
        if pieces["level"].iloc[0] == 0:
            (_, words), counts = _read_pieces(1, pieces)
            rows = [p | {"level": 0} for p in _pieces(1, [words, words], counts, shards)]
        else:
            columns, counts = _read_pieces(level, pieces)
            starts = np.concatenate([[0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1])
            stats = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts > 2)]
            _write(folder, f"{level}-{shard}-contexts", columns[0][starts])
            _write(folder, f"{level}-{shard}-stats", _narrow(np.stack(stats, axis=1)))
            keys = _entry_keys(columns[0], columns[1])
            sort = np.argsort(keys)
            large = sort[counts[sort] >= _LARGE]
            _write(folder, f"{level}-{shard}-keys", keys[sort])
            _write(folder, f"{level}-{shard}-counts", np.minimum(counts[sort], _LARGE).astype(np.uint8))
            _write(folder, f"{level}-{shard}-large-keys", keys[large])
            _write(folder, f"{level}-{shard}-large-counts", counts[large])
            del keys, sort
            summary = [len(counts), int(counts.sum()), *_counts_of_counts(counts)]
            lower = [columns[2], columns[1], *columns[3:]] if level > 2 else [np.zeros(len(counts), np.uint64), columns[1]]
            rows = list(_pieces(level - 1, *_grouped(lower, np.ones(len(counts), np.int64)), shards))
        return pd.DataFrame([[*p.values(), *(summary if not i else [0] * 6)] for i, p in enumerate(rows)], columns=[x.split()[0] for x in _SUMMARY.split(", ")])

    return run


def _narrow(values: np.ndarray) -> np.ndarray:
    """In 4 bytes each where they fit; the reader tells by the file's size."""
    return values.astype(np.uint32) if not values.size or values.max() < 1 << 32 else values


def _merge_words(folder: str):
    """Sums one shard of the single words: continuation counts of level 1 beside the plain counts of level 0."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        shard = int(pieces["shard"].iloc[0])
        (_, words), plain = _read_pieces(1, pieces[pieces["level"] == 0])
        above = pieces[pieces["level"] == 1]
        after = plain
        if len(above):
            (_, again), found = _read_pieces(1, above)
            after = np.zeros(len(words), np.int64)
            after[np.searchsorted(words, again)] = found
        _write(folder, f"1-{shard}-keys", words)
        _write(folder, f"1-{shard}-counts", _narrow(np.stack([after, plain], axis=1)))
        return pd.DataFrame([[len(words), int(plain.sum()), int(after.sum()), *_counts_of_counts(after), int((after > 2).sum())]], columns=["words", "tokens", "total", "n1", "n2", "n3", "n4", "many"])

    return run


def _write(folder: str, name: str, values: np.ndarray) -> None:
    publish(f"{folder}/{name}", lambda stream: stream.write(memoryview(np.ascontiguousarray(values)).cast("B") if values.size else b""))


def _map(folder: str, name: str, kind, rows: int | None = None, width: int = 1) -> np.ndarray:
    """A file of the model, mapped into memory; from a remote store, by way of an unlinked local copy.

    With ``rows`` given the values are unsigned of 4 bytes or signed of 8, whichever the size tells.
    """
    path, file = local_path(f"{folder}/{name}"), None
    if path is None:
        file = tempfile.TemporaryFile()
        with open_seekable(f"{folder}/{name}") as source:
            while data := source.read(1 << 24):
                file.write(data)
        file.flush()
    elif os.path.exists(path):
        file = open(path, "rb")
    if file is not None:
        size = os.fstat(file.fileno()).st_size
        if size:
            kind = kind if rows is None else np.uint32 if size == 4 * rows * width else np.int64
            out = np.memmap(file, kind, "r")
            return out.reshape(-1, width) if width > 1 else out
    return np.zeros((0, width) if width > 1 else 0, kind or np.int64)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and over 2 from the counts of counts; 0.5, 1 and 1.5 where these are too few."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    out = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return out if all(0 <= d <= k for k, d in zip((1, 2, 3), out)) else (0.5, 1.0, 1.5)


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    order: int
    shards: int
    tokens: int = 0
    words: int = 0
    discount: dict[int, tuple[float, float, float]] | None = None
    total: int = 0
    many: tuple[int, int, int] = (0, 0, 0)

    def _discounted(self, level: int, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - np.array((0.0, *self.discount[level]))[np.minimum(counts, 3)], 0.0)

    def open(self) -> "Model":
        """Map all arrays; pages are read when they are looked at and shared by the workers of a machine."""
        self.arrays = {}
        for shard in range(self.shards):
            words = _map(self.folder, f"1-{shard}-keys", np.uint64)
            self.arrays[1, shard] = (words, _map(self.folder, f"1-{shard}-counts", None, len(words), 2))
            for level in range(2, self.order + 1):
                keys, contexts, large = (_map(self.folder, f"{level}-{shard}-{x}", np.uint64) for x in ("keys", "contexts", "large-keys"))
                self.arrays[level, shard] = (keys, _map(self.folder, f"{level}-{shard}-counts", np.uint8), contexts, _map(self.folder, f"{level}-{shard}-stats", None, len(contexts), 4),
                                             large, _map(self.folder, f"{level}-{shard}-large-counts", np.int64))
        return self

    def _find(self, level: int, by: np.ndarray, keys: np.ndarray, which: int, width: int) -> np.ndarray:
        """Values of keys (zeros where unknown) in the shard that ``by`` names; keys are looked up in sorted order."""
        out = np.zeros((len(keys), width), np.int64)
        at = (by % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((keys, at))
        edges = np.searchsorted(at[order], np.arange(self.shards + 1))
        for shard in range(self.shards):
            rows = order[edges[shard]:edges[shard + 1]]
            have = self.arrays[level, shard][which]
            if len(rows) and len(have):
                place = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                hit = have[place] == keys[rows]
                out[rows[hit]] = self.arrays[level, shard][which + 1][place[hit]].reshape(-1, width)
        return out

    def word_scores(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability at level 1 and plain count of distinct words."""
        after, plain = self._find(1, mix(words), words, 0, 2).T
        rest = sum(d * n for d, n in zip(self.discount[1], self.many))
        if not self.total:
            return np.full(len(words), 1.0 / (self.words + 1)), plain
        return (self._discounted(1, after) + rest / (self.words + 1)) / self.total, plain

    def probabilities(self, tokens: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability and plain count of each token after its contexts."""
        words, back = np.unique(tokens, return_inverse=True)
        p, plain = self.word_scores(words)
        p = p[back]
        for level, context in zip(range(2, self.order + 1), contexts):
            keys = _entry_keys(context, tokens)
            _, first, same = np.unique(keys, return_index=True, return_inverse=True)
            counts = self._find(level, context[first], keys[first], 0, 1)[:, 0]
            many = first[counts == _LARGE]
            counts[counts == _LARGE] = self._find(level, context[many], keys[many], 4, 1)[:, 0]
            counts = counts[same]
            _, first, same = np.unique(context, return_index=True, return_inverse=True)
            seen, *few = self._find(level, context[first], context[first], 2, 4)[same].T
            rest = sum(d * n for d, n in zip(self.discount[level], few))
            p = np.where(seen > 0, (self._discounted(level, counts) + rest * p) / np.maximum(seen, 1), p)
        return p, plain[back]


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count ``docs`` and write the model below the shared folder.

    Tasks sum the n-grams of some millions of tokens, cut them by shard and send each shard as one
    row of packed arrays. Shards grow in number with the texts, so a task that merges one has a
    bounded amount; a word a third of all texts long is still one entry of each piece. Lower levels
    count the distinct words before an n-gram, from the merged level above. Words are known by 48
    and n-grams by 64 bits. No count is cut off.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(fresh_path(docs.sparkSession, "ngram-model"), order, max(1, -(-size // shard_bytes)))
    model.discount, here = {}, texts.mapInArrow(_count(order, model.shards), _PIECE)
    for level in range(order, 1, -1):
        # numbered, so that a task merges about one shard however many there are
        done = stage_table(here.repartition(2 * model.shards, "level", "shard").groupBy("level", "shard").applyInPandas(_merge(model.folder, level, model.shards), _SUMMARY), f"ngram-level-{level}")
        n = done.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4")]).first()
        model.discount[level] = discounts([x or 0 for x in n])
        here = done.select(*[x.split()[0] for x in _PIECE.split(", ")])
    sums = stage_table(here.repartition(2 * model.shards, "shard").groupBy("shard").applyInPandas(_merge_words(model.folder), "words long, tokens long, total long, n1 long, n2 long, n3 long, n4 long, many long"), "ngram-words")
    r = sums.agg(*[F.sum(c).alias(c) for c in sums.columns]).first()
    model.words, model.tokens, model.total = r.words or 0, r.tokens or 0, r.total or 0
    model.discount[1], model.many = discounts([r[f"n{k}"] or 0 for k in (1, 2, 3, 4)]), (r.n1 or 0, r.n2 or 0, r.many or 0)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, opened = WordHashes(), None
        for batch in batches:
            opened = opened or model.open()
            texts = [_tokens(known, t) for t in batch.column("text").to_pylist()]
            out = []
            for group in _portions(texts):
                starts = np.concatenate([[0], np.cumsum([len(t) for t in group])[:-1]])
                contexts = [np.concatenate(c) for c in zip(*(_contexts(t, model.order) for t in group))]
                p, plain = opened.probabilities(np.concatenate(group), contexts)
                base = np.log10((plain + _ADD) / (model.tokens + _ADD * (model.words + 1)))
                out.append([np.add.reduceat(x, starts) for x in (np.log10(p), base, (plain > 0).astype(np.int64))])
            score, base, known_tokens = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array([len(t) for t in texts], pa.int64()), pa.array(known_tokens, pa.int64()), pa.array([model.tokens] * len(texts), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _portions(texts: list[np.ndarray], tokens: int = 500_000) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= tokens:
            yield group
            group, size = [], 0
    if group:
        yield group


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Train on the rows that are not ``held_out`` and score all: id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability of the whole text and its end).

    A null text is the empty text, of one token. A null ``held_out`` counts as not held out. Repeated rows are counted and scored as often as
    they stand. With nothing to learn from every word has the same probability, and the base score is 0 for every token. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = train(rows.where(~F.col("held_out")), "text", order)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
