import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from starloom.functions import text as tx
from starloom.functions.fixed_values import CONTRACTIONS, ENGLISH_STOP_WORDS, review_stop_words
from starloom.functions.stemming import stem_text, stem_word
from starloom.operators.normalizer import TextNormalizer, lemmatize, preprocess_reviews, stem_documents


def run(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


CASES = [
    (tx.make_lowercase, "ALLUPPER", "allupper"),
    (tx.remove_special_chars, "aren't", "aren t"),
    (tx.remove_special_chars, "a\nb", "ab"),
    (tx.remove_special_chars, "[Certified] Cable for Phone 5 & 6 by Onyx™ - (2x 1m / 3.2ft Cord) Guarantee!",
     "Certified Cable for Phone 5 6 by Onyx 2x 1m 3 2ft Cord Guarantee"),
    (tx.remove_accented_chars, "souhaité", "souhaite"),
    (tx.remove_newlines, "a\nb\rc", "abc"),
    (tx.remove_media_tags, "[[VIDEOID:e8181b]] This is great [[ASIN:e8]] more text", "This is great more text"),
    (tx.remove_http_links, "use it.<br /><br />http://www.x.com/gp?redirect=true&ref_=cm", "use it.<br /><br />"),
    (tx.remove_http_links, "J.)<br />https://y.be/Z0<br /><br />So that's it!", "J.)<br /> /><br />So that's it!"),
    (tx.remove_alphanumeric_words, "iphone 6s", "iphone"),
    (tx.remove_alphanumeric_words, "iphone a6s", "iphone"),
    (tx.remove_alphanumeric_words, "iphone 6a6s", "iphone"),
    (tx.remove_alphanumeric_words, "iphone s6 6s a6b", "iphone"),
    (tx.remove_alphanumeric_words, "6s iphone", "iphone"),
    (tx.remove_alphanumeric_words, "apple 6s iphone", "apple iphone"),
    (tx.remove_alphanumeric_words, "GSM12345 apple 6s 5 55 iphone zt3500", "apple 5 iphone"),
    (tx.expand_contractions, "can't've she'd GONNA 'cause I'm", "cannotve she would Going to ecause I am"),
    (lambda c: tx.expand_contractions(c, whole_words=True), "can't've Don't xcan't", "cannot have Do not xcant"),
    (tx.remove_html_tags, "<b>x &amp; y</b> &#233;&#x41; &nope;<!-- c --> a < b", "x & y éA &nope; a < b"),
    (tx.remove_html_tags, "<a title=\"x>y\" b='>'>t</a> <i title=\"open>u", "t u"),
    (tx.remove_stop_words, "this is not very good", "not very good"),
    (tx.clean_mixed_words, "a x1 12 b", "a b"),
]


@pytest.mark.parametrize("fn,given,wanted", CASES)
def test_string_pairs(spark, fn, given, wanted):
    assert run(spark, [given], fn) == [wanted]


def test_get_contractions(spark):
    texts = ["no contractions here", "here: blah'blah", "one contractions can't here", "two can't here and couldn't",
             "multiple: aren't blah 3490mak0; ab'dec can't here and couldn't wouldn't", "I’m here and they’re\ngone"]
    assert run(spark, texts, tx.get_contractions) == [
        [], [], ["can't"], ["can't", "couldn't"], ["aren't", "can't", "couldn't", "wouldn't"], ["they're"]]


NASTY = ["", " ", "naïve ﬁx ½ ™ don’t … Ωmega ß Å 東京 ①", "tab\there\x0bthere\x1cx y z", "A1B2 c_3 44 5 x", "she'd've y'all'd've CAN'T",
         "ábc ẛ̣", "emoji 😀 x", "don't'nt gonna gonnawanna"]


def test_accents_match_nfkd(spark):
    wanted = [unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in NASTY]
    assert run(spark, NASTY, tx.remove_accented_chars) == wanted


def test_blanks_match_python_split(spark):
    assert run(spark, NASTY, tx.blank_tokens) == [v.split() for v in NASTY]
    assert run(spark, NASTY, tx.squeeze_blanks) == [" ".join(v.split()) for v in NASTY]
    assert run(spark, NASTY, tx.word_count) == [len(v.split()) for v in NASTY]
    assert run(spark, NASTY, tx.space_split_count) == [len(v.split(" ")) for v in NASTY]


def test_contractions_match_single_pass(spark):
    pattern = re.compile("(" + "|".join(CONTRACTIONS) + ")", re.IGNORECASE)
    wanted = [pattern.sub(lambda m: m.group(0)[0] + CONTRACTIONS[m.group(0).lower()][1:], v).replace("'", "") for v in NASTY]
    assert run(spark, NASTY, tx.expand_contractions) == wanted
    every = [f"x {k} {k.upper()} z{k}" for k in CONTRACTIONS]
    wanted = [pattern.sub(lambda m: m.group(0)[0] + CONTRACTIONS[m.group(0).lower()][1:], v).replace("'", "") for v in every]
    assert run(spark, every, tx.expand_contractions) == wanted


def test_tokens(spark):
    assert run(spark, ["It's 5-star, ok!"], tx.word_punct_tokens) == [["It", "'", "s", "5", "-", "star", ",", "ok", "!"]]
    assert run(spark, ["A be Cée x_1"], tx.count_tokens) == [["be", "cée", "x_1"]]
    assert run(spark, ["a b c"], lambda c: tx.ngrams(tx.blank_tokens(c), 1, 3)) == [["a", "b", "c", "a b", "b c", "a b c"]]
    assert run(spark, ["a"], lambda c: tx.ngrams(tx.blank_tokens(c), 2, 3)) == [[]]


def test_stemming(spark):
    assert run(spark, ["hello running man give sadly"], stem_text) == ["hello run man give sadli"]
    pairs = {"caresses": "caress", "ponies": "poni", "dies": "die", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
             "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
             "relational": "relat", "conditional": "condit", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic",
             "electrical": "electr", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate",
             "controlling": "control", "sky": "sky", "dying": "die"}
    assert {w: stem_word(w) for w in pairs} == pairs


def test_stop_words():
    assert len(ENGLISH_STOP_WORDS) == 179 and len(set(ENGLISH_STOP_WORDS)) == 179
    assert "not" not in review_stop_words() and "the" in review_stop_words()


def test_documents_keep_their_place(spark):
    """With one row a key no token is shuffled; repeated keys and repeated forms give what they gave."""
    df = spark.createDataFrame([(1, "the  cats, running"), (2, None), (3, ""), (4, "Ponies s")], "id int, t string")
    forms = spark.createDataFrame([("cats", "cat"), ("s", None)], "form string, lemma string")
    found = [stem_documents(df, "id", "t"), lemmatize(df, "id", "t", forms)]
    assert all("Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in found)
    assert {r.id: r.t for r in found[0].collect()} == {1: "the cats, run", 2: None, 3: "", 4: "poni s"}
    assert {r.id: r.t for r in found[1].collect()} == {1: "the cat , running", 2: None, 3: "", 4: "Ponies s"}
    twice = lemmatize(df.where("id = 4").unionByName(df.where("id = 4")), "id", "t", forms)
    assert {r.t for r in twice.collect()} == {"Ponies Ponies s s"}
    assert lemmatize(df.where("id = 1"), "id", "t", forms.unionByName(forms)).first().t == "the cat cat , running"


def test_lemmatize(spark):
    df = spark.createDataFrame([(1, "the cats, and dogs"), (2, "xs"), (3, None)], "id int, t string")
    forms = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "form string, lemma string")
    assert {r.id: r.t for r in lemmatize(df, "id", "t", forms).collect()} == {1: "the cat , and dog", 2: "xs", 3: None}


def test_normalizer(spark, tmp_path):
    df = spark.createDataFrame([(1, "Don't buy [[X:1]] the <b>GSM123</b> at http://x.y/z it’s b&aacute;d!", "Ok"), (2, "the", "x"), (3, None, "x"),
                                (4, "fine", None)], "id int, body string, head string")
    rows = preprocess_reviews(df, ["body"], drop=["head"], keep_original=True).collect()
    assert [(r.id, r.body) for r in rows] == [(1, "do not buy bad"), (4, "fine")]
    assert rows[0].body_orig.startswith("Don't buy")
    path = str(tmp_path / "normalizer")
    TextNormalizer(inputCols=["body"], removeStopWords=False, stemText=True).write().overwrite().save(path)
    loaded = TextNormalizer.load(path)
    assert loaded.getInputCols() == ["body"] and not loaded.getOrDefault(loaded.removeStopWords)
    custom = TextNormalizer(inputCols=["body"], before=[lambda c: F.replace(c, F.lit("fine"), F.lit("great"))])
    assert custom.transform(df.where("id = 4")).first().body == "great"
