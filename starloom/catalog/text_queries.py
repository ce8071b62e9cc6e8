"""Text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import query, texts
from starloom.functions import text as tx
from starloom.functions.fixed_values import CONTRACTIONS, ENGLISH_STOP_WORDS, review_stop_words
from starloom.operators.normalizer import TextNormalizer, lemmatize, preprocess_reviews, stem_documents
from starloom.operators.stats import top_per_group

# The given texts hold few apostrophes, tags or links, so some queries plant them with a fixed rule.
_TAGGED = "'[[VIDEOID:' || doc_id || ']] ' || replace(replace(text, ' the ', ' [[ASIN:x1]] '), ' de ', ' http://a.b/c?d=e ')"


def _tagged(df):
    body = F.replace(F.replace("text", F.lit(" the "), F.lit(" [[ASIN:x1]] ")), F.lit(" de "), F.lit(" http://a.b/c?d=e "))
    return df.withColumn("text", F.concat(F.lit("[[VIDEOID:"), "doc_id", F.lit("]] "), body))


_QUOTED = """replace(replace(replace(replace(replace(text, ' the ', ' can''t '), ' de ', ' She''d''ve '), ' and ', ' don’t '),
             ' in ', ' GONNA '), 'THE', 'the''yO''CLOCK')"""


def _quoted(df):
    body = F.col("text")
    for old, new in ((" the ", " can't "), (" de ", " She'd've "), (" and ", " don’t "), (" in ", " GONNA "),
                     ("THE", "the'yO'CLOCK")):
        body = F.replace(body, F.lit(old), F.lit(new))
    return df.withColumn("text", body)


def _digest(df, key, value):
    """Whole texts are compared through their digest and length."""
    return df.select(key, F.md5(value).alias("digest"), F.length(value).cast("long").alias("chars"))


def _digest_sql(key, value, source):
    return f"SELECT {key}, md5({value}) AS digest, length({value}) AS chars FROM {source}"


def _squeeze_sql(text):
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _newlines_sql(text):
    return _squeeze_sql(f"replace(replace({text}, chr(10), ''), chr(13), '')")


def _specials_sql(text):
    return _newlines_sql(f"regexp_replace({text}, '[^a-zA-Z0-9\\s]', ' ', 'g')")


def _mixed_sql(text):
    return _squeeze_sql(f"regexp_replace({text}, '\\s*([a-z]+\\d+\\w*|\\d+[a-z]+\\w*|\\d{{2,}})', '', 'gi')")


def _ascii_sql(text):
    return f"regexp_replace(strip_accents({text}), '[^\\x00-\\x7F]', '', 'g')"


def _html_sql(text):
    body = text
    for pattern in ("<!--.*?-->", "<script\\b[^>]*>.*?</script\\s*>", "<style\\b[^>]*>.*?</style\\s*>"):
        body = f"regexp_replace({body}, '(?is){pattern}', '', 'g')"
    body = f"regexp_replace({body}, '</?[a-zA-Z][^>]*>|<[!?][^>]*>', '', 'g')"
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        body = f"replace({body}, '&{name};', '{char}')"
    return body


def _sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORD_PUNCT_SQL = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"


def _stops_sql(text, words):
    return (f"array_to_string(list_filter(regexp_extract_all({text}, '{_WORD_PUNCT_SQL}'), "
            f"lambda x: NOT list_contains({_sql_list(words)}, x)), ' ')")


def _map_sql(mapping):
    return "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v + "'" for k, v in mapping.items()) + "}"


def _rewrite_sql(text, pattern, render):
    """One pass over matches: split, extract, render, zip back together."""
    return (f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), "
            f"regexp_extract_all({text}, '{pattern}')), lambda z: z[1] || coalesce({render('z[2]')}, '')), '')")


def _contractions_sql(text):
    pattern = "(?i)(?:" + "|".join(k.replace("'", "''") for k in CONTRACTIONS) + ")"
    table_sql = _map_sql(CONTRACTIONS)
    rewritten = _rewrite_sql(text, pattern, lambda hit: f"{hit}[1] || substr({table_sql}[lower({hit})], 2)")
    return f"replace({rewritten}, '''', '')"


def _contractions_words_sql(text):
    """Complete runs of letters, digits and apostrophes looked up as a whole."""
    table_sql = _map_sql(CONTRACTIONS)
    rewritten = _rewrite_sql(text, "[a-zA-Z0-9_'']+", lambda hit: (
        f"coalesce({hit}[1] || substr({table_sql}[lower({hit})], 2), {hit})"))
    return f"replace({rewritten}, '''', '')"


@query("t1_lowercase", _digest_sql("doc_id", "lower(text)", "documents"))
def lowercase(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.make_lowercase("text"))


@query("t2_remove_newlines", _digest_sql("doc_id", _newlines_sql("text"), "documents"))
def newlines(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.remove_newlines("text"))


@query("t3_remove_html", _digest_sql("page_id", _html_sql("html"), "pages"))
def html(spark, folder):
    return _digest(texts(spark, folder, "pages", "page_id"), "page_id", tx.remove_html_tags("html"))


@query("t4_remove_accents", _digest_sql("doc_id", _ascii_sql("text"), "documents"))
def accents(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.remove_accented_chars("text"))


@query("t5_expand_contractions", _digest_sql("doc_id", _contractions_sql("text"),
                                             f"(SELECT doc_id, {_QUOTED} AS text FROM documents)"))
def contractions(spark, folder):
    return _digest(_quoted(texts(spark, folder, "documents", "doc_id")), "doc_id", tx.expand_contractions("text"))


@query("t5_expand_contractions_whole_words", _digest_sql(
    "doc_id", _contractions_words_sql("text"), f"(SELECT doc_id, {_QUOTED} AS text FROM documents)"))
def contractions_whole_words(spark, folder):
    return _digest(_quoted(texts(spark, folder, "documents", "doc_id")), "doc_id", tx.expand_contractions("text", whole_words=True))


@query("t6_remove_special_chars", _digest_sql("doc_id", _specials_sql("text"), "documents"))
def specials(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.remove_special_chars("text"))


@query("t7_remove_alphanumeric_words", _digest_sql("page_id", _mixed_sql(_specials_sql("html")), "pages"))
def alphanumerics(spark, folder):
    return _digest(texts(spark, folder, "pages", "page_id"), "page_id", tx.remove_alphanumeric_words(tx.remove_special_chars("html")))


@query("t8_remove_media_tags", _digest_sql(
    "doc_id", _squeeze_sql("regexp_replace(text, '\\[\\[.*?\\]\\]', ' ', 'g')"),
    f"(SELECT doc_id, {_TAGGED} AS text FROM documents)"))
def media_tags(spark, folder):
    return _digest(_tagged(texts(spark, folder, "documents", "doc_id")), "doc_id", tx.remove_media_tags("text"))


@query("t9_remove_links", _digest_sql(
    "doc_id", "regexp_replace(text, '(http[s]{0,1}:\\S+)', '', 'g')",
    f"(SELECT doc_id, {_TAGGED} AS text FROM documents)"))
def links(spark, folder):
    return _digest(_tagged(texts(spark, folder, "documents", "doc_id")), "doc_id", tx.remove_http_links("text"))


@query("t10_tokenize", f"""
    SELECT lang, token, count(*) AS n FROM (
      SELECT lang, unnest(regexp_extract_all(text, '{_WORD_PUNCT_SQL}')) AS token FROM documents) GROUP BY ALL""")
def tokenize(spark, folder):
    return (texts(spark, folder, "documents", "doc_id").select("lang", F.explode(tx.word_punct_tokens("text")).alias("token"))
            .groupBy("lang", "token").agg(F.count("*").alias("n")))


@query("t11_remove_stop_words", _digest_sql("doc_id", _stops_sql("lower(text)", review_stop_words()), "documents"))
def stop_words(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.remove_stop_words(F.lower("text")))


@query("t11_remove_all_stop_words", _digest_sql("doc_id", _stops_sql("lower(text)", ENGLISH_STOP_WORDS), "documents"))
def all_stop_words(spark, folder):
    return _digest(texts(spark, folder, "documents", "doc_id"), "doc_id", tx.remove_stop_words(F.lower("text"), ENGLISH_STOP_WORDS))


# Word and stem pairs of the published algorithm, stemmed together with the corpus.
_STEM_PAIRS = [("caresses", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
               ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
               ("vietnamization", "vietnam"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("formalize", "formal"), ("hopefulness", "hope"),
               ("revival", "reviv"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("rate", "rate"), ("controll", "control")]


@query("t12_stem", f"""
    SELECT -1 AS doc_id, CAST({len(_STEM_PAIRS)} AS BIGINT) AS words, '{" ".join(s for _, s in _STEM_PAIRS)}' AS published, true AS shorter UNION ALL
    SELECT doc_id, len(regexp_extract_all({_specials_sql(_ascii_sql("lower(text)"))}, '\\S+')), NULL, true FROM documents""")
def stems(spark, folder):
    clean = tx.remove_special_chars(tx.remove_accented_chars(F.lower("text")))
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", clean.alias("text"))
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(" ".join(w for w, _ in _STEM_PAIRS)).alias("text"))
    stemmed = stem_documents(docs.unionByName(planted).withColumn("clean", F.col("text")), "doc_id", "text")
    words = F.zip_with(tx.blank_tokens("text"), tx.blank_tokens("clean"), lambda a, b: F.length(a) <= F.length(b) + 1)
    return stemmed.select("doc_id", F.size(tx.blank_tokens("text")).cast("long").alias("words"), F.when(F.col("doc_id") == -1, F.col("text")).alias("published"),
                          F.forall(words, lambda ok: F.coalesce(ok, F.lit(False))).alias("shorter"))


# Lemma table derived from the corpus: every word ending in "s" maps to the word without it.
@query("t13_lemmatize", f"""
    SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '{_WORD_PUNCT_SQL}'),
        lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END), ' ')) AS digest
    FROM documents""")
def lemmas(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", F.lower("text").alias("text"))
    forms = (docs.select(F.explode(F.array_distinct(tx.word_punct_tokens("text"))).alias("form")).distinct()
             .where((F.length("form") > 3) & F.col("form").endswith("s"))
             .select("form", F.substring("form", F.lit(1), F.length("form") - 1).alias("lemma")))
    return lemmatize(docs, "doc_id", "text", forms).select("doc_id", F.md5("text").alias("digest"))


_FOUND_SQL = f"""(SELECT doc_id, regexp_extract_all(flat, '\\s+([a-z]+''[a-z]{{1,2}})\\s+', 1)
      || regexp_extract_all(flat, '\\s+([a-z]+''[a-z]{{1,2}})$', 1) AS found FROM (
      SELECT doc_id, replace(lower(regexp_replace(text, '[\\n\\r\\t]', ' ', 'g')), '’', '''') AS flat
      FROM (SELECT doc_id, {_QUOTED} || ' they''re' AS text FROM documents)))"""


@query("t14_get_contractions", f"SELECT doc_id, len(found) AS n, array_to_string(found, ',') AS found FROM {_FOUND_SQL}")
def found_contractions(spark, folder):
    docs = _quoted(texts(spark, folder, "documents", "doc_id")).withColumn("text", F.concat("text", F.lit(" they're")))
    return docs.select("doc_id", tx.get_contractions("text").alias("found")).select(
        "doc_id", F.size("found").cast("long").alias("n"), F.array_join("found", ",").alias("found"))


@query("t15_word_count", """
    SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, len(string_split(text, ' ')) AS pieces FROM documents""")
def word_counts(spark, folder):
    return texts(spark, folder, "documents", "doc_id").select(
        "doc_id", tx.word_count("text").alias("words"), tx.space_split_count("text").alias("pieces"))


@query("t16_clean_mixed_words", _digest_sql(
    "page_id", "regexp_replace(regexp_replace(html, '\\s+([a-z]+\\d+\\w*|\\d+[a-z]+\\w*)', '', 'g'), '\\s(\\d+)', '', 'g')", "pages"))
def mixed_words(spark, folder):
    return _digest(texts(spark, folder, "pages", "page_id"), "page_id", tx.clean_mixed_words("html"))


def _normal_sql(text, stops):
    step = _squeeze_sql(f"regexp_replace({text}, '\\[\\[.*?\\]\\]', ' ', 'g')")
    step = f"regexp_replace({step}, 'https?:\\S+', '', 'g')"
    step = _ascii_sql(_html_sql(_newlines_sql(f"lower({step})")))
    step = _contractions_sql(step)
    step = _mixed_sql(_specials_sql(step))
    return _stops_sql(step, stops) if stops else step


@query("t17_normalize_documents", f"""
    SELECT doc_id, md5(clean) AS digest, text_length FROM (
      SELECT doc_id, {_normal_sql("text", review_stop_words())} AS clean, length(text) AS text_length
      FROM (SELECT doc_id, {_TAGGED} AS text FROM documents)) WHERE length(clean) > 0""")
def normalize_documents(spark, folder):
    docs = _tagged(texts(spark, folder, "documents", "doc_id").select("doc_id", "lang", "text"))
    clean = preprocess_reviews(docs, ["text"], drop=["lang"], keep_original=True)
    return clean.select("doc_id", F.md5("text").alias("digest"), F.length("text_orig").cast("long").alias("text_length"))


# Lemmas of cleaned words: every word of more than three letters that ends in "s" loses it.
@query("t17_normalize_with_lemmas", f"""
    SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(clean, '{_WORD_PUNCT_SQL}'),
        lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END), ' ')) AS digest
    FROM (SELECT doc_id, {_normal_sql("text", review_stop_words())} AS clean FROM documents WHERE lang IS NOT NULL) WHERE length(clean) > 0""")
def normalize_with_lemmas(spark, folder):
    docs = texts(spark, folder, "documents", "doc_id").select("doc_id", "lang", "text")
    words = preprocess_reviews(docs, ["text"]).select(F.explode(F.array_distinct(tx.word_punct_tokens("text"))).alias("form")).distinct()
    forms = words.where((F.length("form") > 3) & F.col("form").endswith("s")).select("form", F.substring("form", F.lit(1), F.length("form") - 1).alias("lemma"))
    clean = preprocess_reviews(docs, ["text"], key="doc_id", forms=forms)
    return clean.select("doc_id", F.md5("text").alias("digest"))


@query("t17_normalize_pages", f"""
    SELECT page_id, md5({_normal_sql("html", None)}) AS digest FROM pages""")
def normalize_pages(spark, folder):
    normalizer = TextNormalizer(inputCols=["html"], removeStopWords=False)
    return normalizer.transform(texts(spark, folder, "pages", "page_id")).select("page_id", F.md5("html").alias("digest"))


@query("flagship_words_by_language", f"""
    SELECT lang, word, n, rank FROM (
      SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM (
        SELECT lang, word, count(*) AS n FROM (
          SELECT lang, unnest(regexp_extract_all({_mixed_sql(_specials_sql(_ascii_sql("lower(text)")))}, '\\S+')) AS word
          FROM documents) GROUP BY ALL)) WHERE rank <= 25""")
def words_by_language(spark, folder):
    cleaned = tx.remove_alphanumeric_words(tx.remove_special_chars(tx.remove_accented_chars(tx.make_lowercase("text"))))
    counts = (texts(spark, folder, "documents", "doc_id").select("lang", F.explode(tx.blank_tokens(cleaned)).alias("word"))
              .groupBy("lang", "word").agg(F.count("*").alias("n")))
    return top_per_group(counts, ["lang"], [F.desc("n"), F.asc("word")], 25)
