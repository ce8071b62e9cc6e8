"""The composite text normaliser and the lemma lookup job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.functions.fixed_values import SENTIMENT_WORDS, review_stop_words
from starloom.functions.stemming import stem_text, stem_word, stem_words
from starloom.operators.relational import drop_columns, drop_empty, drop_nulls, duplicate_columns
from starloom.plans.session import stage_table
from starloom.plans.sizing import fits_broadcast, lookup_join, materialized

#: Rows and bytes of a lemma table that each Python worker may hold.
WORKER_ROWS, WORKER_BYTES = 500_000, 32 * 1024 * 1024

Step = Callable[[Column], Column]


def _switch(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toBoolean)


class TextNormalizer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Clean text columns in place, in one projection.

    Fixed order: custom steps, lower case, line breaks, HTML, accents, contractions, special
    characters, letter/digit mixtures, stop words, custom steps, stemming. All steps but
    stemming are JVM expressions.
    """

    toLowercase = _switch("toLowercase", "lower-case the text")
    removeNewlines = _switch("removeNewlines", "delete line breaks")
    removeHtmlTags = _switch("removeHtmlTags", "strip HTML")
    removeAccentedChars = _switch("removeAccentedChars", "fold accents to ASCII")
    expandContractions = _switch("expandContractions", "expand contractions")
    wholeWordContractions = _switch("wholeWordContractions", "expand contractions only as whole words")
    removeSpecialChars = _switch("removeSpecialChars", "keep letters, digits and blanks")
    removeAlphanumericWords = _switch("removeAlphanumericWords", "drop letter/digit mixtures and numbers")
    removeStopWords = _switch("removeStopWords", "drop stop words")
    stemText = _switch("stemText", "stem words")
    keptStopWords = Param(Params._dummy(), "keptStopWords", "stop words that stay", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, toLowercase=True, removeNewlines=True, removeHtmlTags=True,
                 removeAccentedChars=True, expandContractions=True, wholeWordContractions=False,
                 removeSpecialChars=True, removeAlphanumericWords=True, removeStopWords=True, stemText=False,
                 keptStopWords=None, before=None, after=None):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        # custom Column -> Column steps are code, not parameters, and are not persisted
        self.before: Sequence[Step] = kwargs.pop("before", None) or (tx.remove_media_tags, tx.remove_http_links)
        self.after: Sequence[Step] = kwargs.pop("after", None) or ()
        self._setDefault(toLowercase=True, removeNewlines=True, removeHtmlTags=True, removeAccentedChars=True,
                         expandContractions=True, wholeWordContractions=False, removeSpecialChars=True,
                         removeAlphanumericWords=True, removeStopWords=True, stemText=False,
                         keptStopWords=list(SENTIMENT_WORDS))
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def steps(self) -> list[Step]:
        """The enabled steps in order."""
        def on(param: Param, step: Step) -> list[Step]:
            return [step] if self.getOrDefault(param) else []

        stops = review_stop_words(self.getOrDefault(self.keptStopWords))
        whole = self.getOrDefault(self.wholeWordContractions)
        return [
            *self.before,
            *on(self.toLowercase, tx.make_lowercase),
            *on(self.removeNewlines, tx.remove_newlines),
            *on(self.removeHtmlTags, tx.remove_html_tags),
            *on(self.removeAccentedChars, tx.remove_accented_chars),
            *on(self.expandContractions, lambda c: tx.expand_contractions(c, whole_words=whole)),
            *on(self.removeSpecialChars, tx.remove_special_chars),
            *on(self.removeAlphanumericWords, tx.remove_alphanumeric_words),
            *on(self.removeStopWords, lambda c: tx.remove_stop_words(c, stops)),
            *self.after,
            *on(self.stemText, stem_text),
        ]

    def normalize(self, text: Column | str) -> Column:
        """The whole chain as one column expression."""
        out = F.col(text) if isinstance(text, str) else text
        for step in self.steps():
            out = step(out)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Apply the steps to every input column, each step as its own projection.

        Several steps mention their input twice (guards); stacking projections lets Catalyst
        keep one evaluation of each step instead of inlining the whole chain into every guard.
        """
        out = dataset
        for step in self.steps():
            out = out.withColumns({c: step(F.col(c)) for c in self.getInputCols()})
        return out


def preprocess_reviews(df: DataFrame, text_columns: Sequence[str], drop: Sequence[str] = (), keep_original: bool = False,
                       normalizer: TextNormalizer | None = None, key: str | None = None, forms: DataFrame | None = None) -> DataFrame:
    """Drop columns, drop rows with nulls, optionally keep the raw text, clean, drop emptied rows.

    ``forms`` (form, lemma) adds lemmas as the last step, for training texts; it needs the row ``key``.
    With a key, stemming runs over the distinct words of the cleaned texts.
    """
    out = drop_columns(df, drop) if drop else df
    out = drop_nulls(out)
    if keep_original:
        out = duplicate_columns(out, text_columns)
    normalizer = (normalizer or TextNormalizer()).copy()
    by_words = key is not None and normalizer.getOrDefault(normalizer.stemText)
    normalizer._set(inputCols=list(text_columns), **({"stemText": False} if by_words else {}))
    out = drop_empty(normalizer.transform(out), text_columns)
    if forms is not None and key is None:
        raise ValueError("lemmas need the key of a row")
    for column in text_columns if by_words or forms is not None else ():
        if by_words:
            out = stem_documents(out, key, column)
        if forms is not None:
            out = lemmatize(out, key, column, forms)
    return out


def _replace_tokens(df: DataFrame, key: str, text: str, tokens: Column, forms: DataFrame) -> DataFrame:
    """Every token's lemma from a (form, lemma) table, or itself, joined by blanks.

    Only tokens travel through the lookup (broadcast when the measured table is small, salted
    shuffle otherwise); a text is put together again under its own key.
    """
    looked_up = lookup_join(df.select(key, F.posexplode(tokens).alias("pos", "form")), forms.select("form", "lemma"), ["form"], "left")
    joined = looked_up.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "form").alias("word")))), lambda s: s["word"]), " ").alias("__text"))
    return (df.join(joined, key, "left").withColumn(text, F.coalesce("__text", F.when(F.col(text).isNotNull(), "")))
            .drop("__text"))


def _one_row_a_key(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty()


def _replaced(tokens: Column, load: Callable[[], Callable[[str], str]]) -> Column:
    """Tokens joined by blanks, each distinct one of a batch replaced once; no token is shuffled."""
    @F.arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        replace, flat = load(), lists.flatten().dictionary_encode()
        words = pa.array([replace(w) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        rows = pa.LargeListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), ends])), words)
        return pc.if_else(lists.is_valid(), pc.binary_join(rows, " "), pa.scalar(None, pa.string()))

    return joined(tokens)


def lemmatize(df: DataFrame, key: str, text: str, forms: DataFrame) -> DataFrame:
    """Replace every token by its lemma from a (form, lemma) table; unknown forms stay.

    A table that is measured small goes to the workers and texts stay where they are.
    """
    df, forms = stage_table(df, "texts"), materialized(forms.select("form", "lemma"))
    if fits_broadcast(forms, WORKER_ROWS, WORKER_BYTES) and _one_row_a_key(df, key):
        pairs = [tuple(r) for r in forms.where("form IS NOT NULL").collect()]
        table = {form: lemma for form, lemma in pairs if lemma is not None}
        if len({form for form, _ in pairs}) == len(pairs):
            sent = df.sparkSession.sparkContext.broadcast(table)
            return df.withColumn(text, _replaced(tx.word_punct_tokens(text), lambda: lambda w, known=sent.value: known.get(w, w)))
    return _replace_tokens(df, key, text, tx.word_punct_tokens(text), forms)


def stem_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Stem every blank-separated word; each distinct word of a batch of texts is stemmed once."""
    words, df = tx.blank_tokens(text), stage_table(df, "texts")
    if _one_row_a_key(df, key):
        return df.withColumn(text, _replaced(words, lambda: stem_word))
    forms = stem_words(df.select(F.explode(F.array_distinct(words)).alias("form")).distinct()).where("form <> lemma")
    return _replace_tokens(df, key, text, words, forms)
