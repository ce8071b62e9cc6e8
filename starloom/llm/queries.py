"""The operators of this package over the given tables, next to SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.batches import prepare
from starloom.llm.best_fit import pack_best_fit
from starloom.llm.decontaminate import contaminated_documents
from starloom.llm.embedding_dedup import near_duplicate_vectors
from starloom.llm.hard_negatives import hard_negatives
from starloom.llm.html_extract import extract_main_text
from starloom.llm.language_id import identify_languages
from starloom.llm.language_model import score_documents
from starloom.llm.line_dedup import MIN_SITES, remove_boilerplate
from starloom.llm.minhash import near_duplicate_documents
from starloom.llm.packing import pack_documents
from starloom.llm.quality import score_quality
from starloom.llm.warc import round_trip
from starloom.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(parts: int, remainder: int) -> Column:
    """Whether the CRC-32 of the document id, written as text, leaves ``remainder``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder


@query("op1_line_dedup", rf"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, i - 1 AS pos, parts[i] AS line, trim(parts[i], chr(32) || chr(9) || chr(13)) AS norm FROM parts, unnest(range(1, len(parts) + 1)) AS t(i)),
spread AS (SELECT norm, min({{'d': doc_id, 'p': pos}}) AS first FROM lines WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT l.*, s.norm IS NOT NULL AND NOT (l.doc_id = s.first.d AND l.pos = s.first.p) AS gone FROM lines l LEFT JOIN spread s ON l.norm = s.norm)
SELECT doc_id, any_value(source) AS source, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean_text,
  count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_boilerplate(table(spark, folder, "documents")).select("doc_id", "source", "clean_text", "n_lines", "n_removed")


@query("op2_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node)
SELECT v.vec_id, CAST((SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = v.vec_id""")
def embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op3_minhash_dedup", r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id""")
def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_documents(table(spark, folder, "documents"), shingle_words=4)


@query("op4_decontaminate", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
places AS (SELECT doc_id, i AS pos, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM words, (SELECT DISTINCT size FROM windows) z, unnest(range(1, len(w) - size + 2)) AS t(i)),
found AS (SELECT doc_id, pos, p.size, item FROM places p JOIN windows USING (size, s)),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM found, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), fold_of(10, 0))


@query("op6_warc")
def warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


@query("op9_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), fold_of(4, 2))


@query("op10_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(table(spark, folder, "documents"), fold_of(5, 0))


@query("op11_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10""")
def hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


@query("op13_best_fit")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_best_fit(table(spark, folder, "documents"))
