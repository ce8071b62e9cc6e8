"""Language identification by string kernels: blended n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 14
LONGEST = 4
TEXTS_PER_LANGUAGE = 1000
LANDMARKS_PER_LANGUAGE = 100
RIDGE = 1e-2
UNKNOWN = "und"
_SHARPNESS = 4.0
_BATCH = 256


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(text: str | None) -> np.ndarray | None:
    """Which of the ``WIDTH`` hashed spectra of 1 to LONGEST characters a text holds; None without a letter.

    Letters are lower case; everything else is a blank, of which one stands between and around words.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    out, grams = np.zeros(WIDTH, bool), np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        grams = grams[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
        mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out[(mixed ^ (mixed >> np.uint32(13))) % np.uint32(WIDTH)] = True
    return out


@dataclass
class KernelModel:
    """One linear form per language over the landmarks' kernel values, folded into the spectra."""

    languages: list[str]
    forms: np.ndarray

    def outputs(self, rows: np.ndarray) -> np.ndarray:
        """One-versus-rest outputs of a batch of presence rows: one matrix product."""
        rows = rows.astype(np.float32)
        return rows @ self.forms / np.sqrt(rows.sum(axis=1, keepdims=True))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel: shared spectra over the root of the product of both sizes."""
    return a @ b.T / np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32)


def fit(packed: np.ndarray, languages: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression in the Nyström space of the first texts of each language, from packed presence bits.

    The kernel is linear in the spectra, so landmarks, whitening and weights fold into one matrix of
    spectra by languages; scoring a batch is a single product, equal to going by way of the landmarks.
    """
    names, which = sorted(set(languages)), np.array(languages)
    marks = unpacked(np.concatenate([packed[which == n][:landmarks_per_language] for n in names]))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    space = np.concatenate([kernel(unpacked(packed[s:s + _BATCH]), marks) @ whiten for s in range(0, len(packed), _BATCH)])
    target = np.where(which[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(space.T @ space + ridge * len(packed) * np.eye(space.shape[1]), space.T @ target)
    scaled = whiten @ weights / np.sqrt(marks.sum(axis=1, keepdims=True))
    return KernelModel(names, (marks.T @ scaled.astype(np.float32)).astype(np.float32))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [presence(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array([None if r is None else np.packbits(r).tobytes() for r in rows], pa.binary())], names=["place", "lang", "bits"])


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts_per_language: int = TEXTS_PER_LANGUAGE) -> KernelModel | None:
    """Fit on at most ``texts_per_language`` labelled rows of each language, those of the smallest hashes of id and text.

    That bound holds what reaches the driver: two kilobytes a text. Rows are taken below a hash that
    a fifth more than the bound are expected under, so nothing is ranked or joined, whatever the
    share of a language; rows with the same id and text teach once. None without labelled texts that have letters.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    hashed = named.withColumn("place", F.xxhash64("id", "text"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()  # a row for each language, of which the model holds a column
    if not sizes:
        return None
    shares = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 1.2 * texts_per_language / max(1, r["n"])))])
    picked = hashed.where(F.shiftrightunsigned("place", 11).cast("double") / (1 << 53) < F.element_at(shares, F.col("lang"))).dropDuplicates(["lang", "place"])
    rows = picked.select("place", "lang", "text").mapInArrow(_spectra, "place long, lang string, bits binary").where("bits is not null").orderBy("lang", F.shiftrightunsigned("place", 11), "place").collect()
    rows = [r for _, own in groupby(rows, key=lambda r: r.lang) for r in islice(own, texts_per_language)]
    if not rows:
        return None
    packed = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(packed, [r.lang for r in rows])


def predict(model: KernelModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, by batched products."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    for start in range(0, len(texts), _BATCH):
        found = [(k, row) for k, t in enumerate(texts[start:start + _BATCH], start) if (row := presence(t)) is not None]
        if found:
            out = _SHARPNESS * model.outputs(np.stack([r for _, r in found])).astype(np.float64)
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            for (k, _), best, score in zip(found, out.argmax(axis=1), out.max(axis=1)):
                names[k], scores[k] = model.languages[best], float(score)
    return names, scores


def _predicted(model: KernelModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score (0 to 1) of every document.

    The model learns from rows that are not ``held_out`` and have a language and an id; whole texts are
    read. A text that is null or has no letter is ``und`` with score 0, as is everything where there
    is nothing to learn from. Ties go to the first language in order. Repeated rows are predicted each; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    flagged = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    model = train(flagged.where("not held_out"), "id", "text", "lang")
    return flagged.select("id", "held_out", "text").mapInArrow(_predicted(model), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _known_only(model: KernelModel | None, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            known = [presence(t) is not None for t in texts] if model is None else [n != UNKNOWN for n in predict(model, texts)[0]]
            yield batch.filter(pa.array(known, pa.bool_()))

    return run


def keep_known_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that are ``und``, having no letter, with all their columns.

    Where there is nothing to learn from, documents with letters stay as well.
    """
    model = train(docs.where(~F.coalesce(held_out, F.lit(False))), id_col, text_col, lang_col)
    return docs.mapInArrow(_known_only(model, text_col), docs.schema)
