"""Benchmark passages in documents: a prefix-filtered join of windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_DOC = ["__id", "__text"]


def _words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with only A-Z made lower case.

    One translation and a split at single spaces, which take a fraction of a regular expression's time.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def _hashes(words: Column) -> Column:
    """Hash of every word, in order."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: Column, size: int) -> Column:
    """Hashes of every run of ``size`` words, in order, from those of the words."""
    out = hashes
    for k in range(1, size):
        later = F.slice(hashes, F.lit(k + 1), F.greatest(F.size(hashes) - k, F.lit(0)))
        out = F.zip_with(out, later, lambda x, y: F.xxhash64(x, y))
    return F.slice(out, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0)))


def _placed_shingles(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """(document, n_words, k, pos, shingle) of the ``wanted`` shingles in ``docs``, of all ``sizes`` in one pass over the texts.

    The words are hashed in a projection of their own: inside the generator they would be hashed again
    for every use, and their array would be copied into every row that leaves it.
    """
    hashed = docs.select(*_keys(id_col, text_col), _hashes(_words(F.col(text_col))).alias("hashes"))
    runs = F.concat(F.array().cast("array<long>"), *[_shingles(F.col("hashes"), n) for n in sizes])
    placed = hashed.select(*_DOC, F.size("hashes").alias("n_words"), "hashes").select(*_DOC, "n_words", F.posexplode(runs).alias("at", "shingle"))
    found = lookup_join(placed, wanted, ["shingle"], "left_semi")
    k, pos, before = F.lit(0), F.col("at"), F.lit(0)
    for n in sizes:  # each size's runs follow those of the sizes before it
        k = F.when(F.col("at") >= before, n).otherwise(k)
        pos = F.when(F.col("at") >= before, F.col("at") - before).otherwise(pos)
        before = before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    return found.select(*_DOC, "n_words", k.alias("k"), pos.alias("pos"), "shingle")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window_words: int, shingle_words: int) -> DataFrame:
    """(window, item, length, k, shingles): the distinct windows of every item, k words to a shingle."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _words(F.col(text_col)).alias("words"))
    sized = items.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window_words)))
    starts = sized.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    windows = starts.select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("words")).distinct()
    k = F.least(F.col("length"), F.lit(shingle_words))
    by_size = [F.when(k == n, _shingles(_hashes(F.col("words")), n)) for n in range(1, shingle_words + 1)]
    return windows.select(F.xxhash64("item", "words").alias("window"), "item", "length", k.alias("k"), F.coalesce(*by_size).alias("shingles"))


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__id"), F.xxhash64(id_col, text_col).alias("__text")]


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                           item_text_col: str = "text", window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window_words`` consecutive words of an item, or the whole of a shorter one. Document
    words inside any occurrence of a window are hit. Windows are sets of word shingles; containment
    of the whole window needs its rarest shingle, so only that one (the prefix of the set ordered by
    document frequency) is joined; its place must leave room for the window in the document; the
    other shingles are then looked up at their exact places, all of them for an occurrence.

    Only shingles of the benchmark leave the documents' scan, through a join that broadcasts the
    benchmark's shingles when measured small and is salted otherwise. Null texts have no words and
    no hits; items without words have no window; items with a null id are ignored. Rows that
    share id and text are equal; rows with a null id are reported by their own text. An empty
    benchmark leaves every document clean. Shingle hashes have 64 bits.
    """
    hit = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window_words, shingle_words)
    out = docs.select(F.col(id_col), *_keys(id_col, text_col), F.size(_words(F.col(text_col))).cast("long").alias("n_words")).join(hit, _DOC, "left")
    count = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col(id_col), "n_words", count.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort(listed), ","), 256).alias("items_sha256"), (count > 0).alias("contaminated"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window_words: int, shingle_words: int) -> DataFrame:
    """n_hit and the items of every document that holds a window, under the document's key."""
    windows = stage_table(benchmark_windows(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text_col, window_words, shingle_words), "windows")
    parts = windows.select("window", "item", "length", "k", F.posexplode("shingles").alias("offset", "shingle"))
    sizes = [r.k for r in windows.select("k").distinct().orderBy("k").collect()]  # at most shingle_words values
    found = _placed_shingles(docs, id_col, text_col, sizes, parts.select("shingle").distinct())
    hits = stage_table(found.distinct(), "benchmark-shingles")
    rarity = parts.join(hits.groupBy("k", "shingle").agg(F.count("*").alias("n")), ["k", "shingle"], "left")
    first = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "offset")
    anchors = rarity.withColumn("__nth", F.row_number().over(first)).where("__nth = 1 and n is not null").select("window", "length", "k", "offset", "shingle")
    starts = lookup_join(hits, anchors, ["k", "shingle"])
    starts = starts.withColumn("start", F.col("pos") - F.col("offset")).where("start >= 0 and start + length <= n_words")
    checks = lookup_join(starts.select(*_DOC, "start", "window", "length"), parts.select("window", "k", "offset", "shingle"), ["window"])
    checks = checks.select(*_DOC, "start", "window", "length", "k", (F.col("start") + F.col("offset")).alias("pos"), "shingle")
    matched = checks.join(hits.select(*_DOC, "k", "pos", "shingle"), [*_DOC, "k", "pos", "shingle"], "left_semi")
    occurrences = stage_table(matched.groupBy(*_DOC, "start", "window", "length", "k").agg(F.count("*").alias("n"))
                              .where("n = length - k + 1").select(*_DOC, "start", "window", "length"), "occurrences")
    spans = occurrences.groupBy(*_DOC, "start").agg(F.max("length").alias("length"))
    hit = spans.select(*_DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*_DOC).agg(F.count("*").alias("n_hit"))
    items = lookup_join(occurrences.select(*_DOC, "window").distinct(), windows.select("window", "item"), ["window"])
    items = items.groupBy(*_DOC).agg(F.collect_set("item").alias("items"))
    return hit.join(items, _DOC)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns pass through."""
    hit = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window_words, shingle_words).select(*_DOC)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # the caller's columns may have the helpers' names
    return lookup_join(docs.select(row, *_keys(id_col, text_col)), hit, _DOC, "left_anti").select("__row.*")
