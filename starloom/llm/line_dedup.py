"""Cross-site boilerplate lines, found by the spread of each line over distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.plans.session import stage_table
from starloom.plans.sizing import lookup_join

MIN_SITES = 5
SKETCH_BITS = 12
_LINE = ["h1", "h2"]
_ROW = ["__order", "__row"]


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Name a row by its id (null ids sort last) and its text; equal rows share their fate."""
    return docs.withColumns({"__order": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__row": F.xxhash64(F.col(id_col), F.col(text_col))})


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: its document, its site, its place and a 128-bit hash of the trimmed line."""
    rows = _row_key(docs, id_col, text_col).select(*_ROW, F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _trimmed("line")).where("line <> ''")
    return rows.select(*_ROW, "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(h1, h2, first_order, first_pos) of the lines that stand on ``min_sites`` distinct sites or more.

    Each line hash has a HyperLogLog sketch of its sites; sketches are built map-side and merged by
    the aggregation, so a line on a third of all rows costs one sketch per task. A relative error of
    1.04 / sqrt(2^bits) decides the lines clearly above or below; those within four errors (at
    least one site) of the threshold are counted exactly. Null sites count as no site.
    """
    slack = max(1.0, 4 * 1.04 * min_sites / (1 << sketch_bits) ** 0.5)
    spread = lines.groupBy(*_LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(sketch_bits))).alias("sites"), F.count("*").alias("n"),
        F.min(F.struct("__order", "pos")).alias("first"))
    spread = stage_table(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - slack))
                         .select(*_LINE, "sites", F.col("first.__order").alias("first_order"), F.col("first.pos").alias("first_pos")), "line-spread")
    clear = spread.where(F.col("sites") > min_sites + slack)
    near = spread.where(F.col("sites") <= min_sites + slack)
    exact = lookup_join(lines.select(*_LINE, "site"), near.select(*_LINE), _LINE, "left_semi").groupBy(*_LINE).agg(F.count_distinct("site").alias("exact"))
    kept = near.join(exact.where(F.col("exact") >= min_sites), _LINE, "left_semi")
    return clear.union(kept).drop("sites")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` with clean_text, n_lines (non-blank lines) and n_removed.

    A line (trimmed of spaces, tabs and carriage returns) found on ``min_sites`` sites is boilerplate.
    Its first occurrence, by document id and then by place, stays, so nothing that the corpus says is
    lost; every other occurrence goes, at any length of text. Blank lines stay and never count. A null text gives a null clean_text and no
    lines; rows with a null id come last in the order; equal rows are treated alike; an empty table
    gives an empty result; other columns pass through, but for those named like the three new ones.

    Lines are hashed once into a staged table without their text. Document texts are shuffled once,
    by document, to take out the listed places.
    """
    lines = stage_table(line_table(docs, id_col, text_col, site_col), "lines")
    found = boilerplate_lines(lines, min_sites, sketch_bits)
    hits = lookup_join(lines.select(*_ROW, "pos", *_LINE), found, _LINE)
    hits = hits.where((F.col("__order") != F.col("first_order")) | (F.col("pos") != F.col("first_pos")))
    removed = hits.groupBy(*_ROW).agg(F.collect_set("pos").alias("__removed"))
    parts = F.split(text_col, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__removed"))
    clean = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n"))
    joined = _row_key(docs, id_col, text_col).join(removed, _ROW, "left")
    others = [c for c in docs.columns if c not in ("clean_text", "n_lines", "n_removed")]
    return joined.select(*others, clean.alias("clean_text"),
                         F.coalesce(F.size(F.filter(parts, lambda x: _trimmed(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", **options) -> DataFrame:
    """``docs`` without boilerplate lines; a document that had lines and lost all of them goes."""
    rest = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*rest).alias("__doc"), F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__doc_text"), F.col(site_col).alias("__doc_site"))
    done = remove_boilerplate(packed, "__doc_id", "__doc_text", "__doc_site", **options).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return done.select(*[F.col("clean_text").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns])
