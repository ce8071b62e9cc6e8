"""The corpus operators against brute force, round trips and the cases that crash careless code."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starloom.llm import decontaminate, embedding_dedup, html_extract, language_id, language_model, line_dedup, minhash, packing, quality, warc
from starloom.llm.components import connected_components
from starloom.llm.storage import open_seekable
from starloom.plans.session import fresh_path

DOC = "doc_id long, text string, lang string, source string, n_words int, component string"
LONG = " ".join(f"w{k}" for k in range(30_000))


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null in every column, empty, blank, long, tied and repeated rows, and columns named like the results."""
    rows = [(1, "One line.\nSame line", "en", "a"), (1, "One line.\nSame line", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n ", "fr", "c"), (5, LONG, "en", "d"),
            (6, "Same line\nother", None, "b"), (None, "Same line", "en", "c"), (7, "Same line", "fr", "d"), (8, "Same line", "fr", "e"), (9, "123 456 !!", "fr", "f"), (10, "Same line\n" + LONG, "fr", None)]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOC)


def by_id(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_line_dedup_counts_sites_and_keeps_the_first(spark, odd):
    out = by_id(line_dedup.remove_boilerplate(odd, min_sites=4), "clean_text", "n_lines", "n_removed")
    assert out[1] == ("One line.\nSame line", 2, 0)
    assert out[6] == ("other", 2, 1) and out[7] == ("", 1, 1) and out[None] == ("", 1, 1) and out[10] == (LONG, 2, 1)
    assert out[2] == (None, 0, 0) and out[3] == ("", 0, 0) and out[4] == (" \t\n ", 0, 0)
    assert not any(n for _, _, n in by_id(line_dedup.remove_boilerplate(odd, min_sites=6), "clean_text", "n_lines", "n_removed").values())
    kept = line_dedup.dedup_lines(odd, min_sites=4)
    assert kept.columns == odd.columns and kept.where("doc_id in (7, 8) or doc_id is null").count() == 0 and kept.count() == odd.count() - 3
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_decides_far_lines_by_sketch_and_near_ones_exactly(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat('s', id) as source", "concat(if(id < 300, 'far\n', ''), if(id < 100, 'near\n', ''), if(id < 99, 'under\n', ''), 'own', id) as text")
    out = by_id(line_dedup.remove_boilerplate(df, min_sites=100), "clean_text")
    assert out[0][0].split("\n") == ["far", "near", "under", "own0"] and out[50][0].split("\n") == ["under", "own50"] and out[350][0] == "own350"


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)] + [(1, 1), (3, None)]
    got = by_id(connected_components(spark.createDataFrame(edges, "a long, b long")), "component", key="node")
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = brute_components({x for e in real for x in e}, real)
    assert {k: v[0] for k, v in got.items()} == want


@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    near = [base[k % 20] + rng.normal(size=64) * s for k, s in zip(range(200), np.tile([0.05, 0.2, 0.35, 0.48], 50))]
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [None] + [1.0] * 63), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 64)]
    out = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=block, pivots=64).collect()
    assert len(out) == len(rows)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in out}
    found = sum(got[k].n_links for k in range(len(x)))
    assert all(got[k].n_links <= link[k].sum() for k in range(len(x))) and found >= 0.97 * link.sum()
    assert all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904)) and got[905].n_links == got[906].n_links == 1 and got[906].component_id == 905
    assert got[500].component_id == 0 and not got[500].kept and got[None].kept and got[None].component_id is None


@pytest.mark.parametrize("pivots", [200, 2000, 6324])
def test_pairs_at_the_threshold_share_a_list_whatever_the_number_of_pivots(pivots):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    points, a, b = unit(rng.normal(size=(pivots, 64))), unit(rng.normal(size=(500, 64))), rng.normal(size=(500, 64))
    b = 0.9 * a + math.sqrt(0.19) * unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    rows = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([1] * 1000), pa.array([*a, *b], pa.list_(pa.float64()))], names=["rep", "copies", "vector"])
    lists = [set(x) for out in embedding_dedup._describe(points, embedding_dedup.nearest_pivots(pivots))([rows]) for x in out.column("lists").to_pylist()]
    assert sum(bool(x & y) for x, y in zip(lists[:500], lists[500:])) >= 0.96 * 500


def test_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_shingles(text, n):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i:i + min(n, len(w))]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


@pytest.mark.parametrize("block", [8, 1024])
def test_minhash_against_brute_force(spark, odd, block):
    rng, texts = random.Random(1), {}
    for g in range(12):
        base = words(g, 60 + 10 * g).split()
        for c in range(30):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts[len(texts) + 100] = " ".join(w)
    df = spark.createDataFrame([(k, v, "en", "a", 1, "x") for k, v in texts.items()], DOC).union(odd)
    out = minhash.near_duplicate_documents(df, shingle_words=4, block_rows=block).collect()
    everything = texts | {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    sets = {k: brute_shingles(v, 4) for k, v in everything.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(ids, links)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == {k: (len(sets[k]), want[k], want[k] == k) for k in ids}
    assert [(r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is None] == [(1, None, True)]
    one = minhash.keep_one_of_each(df, shingle_words=4)
    assert one.columns == df.columns and sorted(r.doc_id or -1 for r in one.collect()) == sorted([-1, *(k for k in ids if want[k] == k)])


def test_decontamination_of_odd_rows_and_short_items(spark, odd):
    item = " ".join(f"w{k}" for k in range(500, 512))
    bench = spark.createDataFrame([(1, item), (2, "other"), (10, "Same LINE!"), (None, "one"), (4, None), (5, " ."), (10, "Same LINE!")], "item_id long, text string")
    out = by_id(decontaminate.contaminated_documents(odd, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

    def sha(*items):
        return hashlib.sha256(",".join(items).encode()).hexdigest()

    assert out[1] == (4, 2, 1, sha("10"), True) and out[6] == (3, 3, 2, sha("10", "2"), True) and out[2] == (0, 0, 0, sha(), False)
    assert out[5] == (30_000, 12, 1, sha("1"), True) and out[10] == (30_002, 14, 2, sha("1", "10"), True) and out[None][1:3] == (2, 1)
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 9]
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count() and decontaminate.contaminated_documents(odd.limit(0), bench).count() == 0


def brute_kneser_ney(texts, order):
    """log10 probability of a text by the definition, over plain dictionaries."""
    begin, end = "<s>", "</s>"

    def grams(text, n):
        w = [begin] * (order - 1) + text + [end]
        return [tuple(w[i - n + 1:i + 1]) for i in range(order - 1, len(w))]

    counts = {order: Counter(g for t in texts for g in grams(t, order))}
    plain = Counter(g[0] for t in texts for g in grams(t, 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {n: language_model.discounts([sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    after = {n: defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            after[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(plain) + 1)
        seen = after[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        c = counts[n].get(gram, 0)
        return (max(c - (0, *disc[n])[min(c, 3)], 0) + sum(disc[n][min(x, 3) - 1] for x in seen) * p(gram[1:])) / sum(seen)

    return lambda text: sum(math.log10(p(g)) for g in grams(text, order)), plain


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_the_definition(spark, order, monkeypatch):
    monkeypatch.setattr(language_model.train, "__defaults__", ("text", order, 1500))
    rows = [(k, words(k % 17, 5 + k)) for k in range(60)] + [(60, None), (61, ""), (62, "Never seen"), (63, "alpha1 " * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_documents(df, F.col("doc_id") % 5 == 2, order=order).collect()}
    split = {k: (t or "").lower().split() for k, t in rows}
    score, plain = brute_kneser_ney([w for k, w in split.items() if k % 5 != 2], order)
    total, size = sum(plain.values()), len(plain)
    for k, w in split.items():
        r = got[k]
        tokens = [*w, "</s>"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k % 5 == 2, len(tokens), sum(t in plain for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((plain[t] + 0.1) / (total + 0.1 * (size + 1))) for t in tokens), rel=1e-9)
        assert r.score == pytest.approx(score(w), rel=1e-9)


def test_counts_over_four_bytes_stay_whole():
    words, counts = np.array([5, 9], np.uint64), np.array([(1 << 32) + 7, 3])
    pieces = pd.DataFrame(list(language_model._pieces(1, [words, words], counts, 1)) * 2)
    (_, again), total = language_model._read_pieces(1, pieces)
    assert again.tolist() == [5, 9] and total.tolist() == [(1 << 33) + 14, 6]


def test_language_model_without_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in language_model.score_documents(df, F.lit(True)).collect())
    assert language_model.score_documents(df.limit(0), F.lit(False)).count() == 0


def test_archives_give_back_every_payload(spark):
    html = {1: "<p>a</p>", 2: "<p>a</p>", 3: None, 4: "", 5: "é\U0001f600" * 40_000, 6: "<p>a</p>", 7: "tail"}
    rows = [(k, f"http://h/{k}?q=é x" if k != 4 else None, v, "extra") for k, v in html.items()] + [(None, "u", "<p>a</p>", "extra"), (7, "http://h/7?q=é x", "tail", "extra")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").repartition(3)
    index = warc.write_archives(pages, fresh_path(spark, "warc-test"), frame_bytes=64, bundle_bytes=200)
    got = warc.read_archives(index).collect()
    assert len(got) == len(rows)
    newest = {1: 6, 2: 6, 3: 4}
    for r in got:
        payload = (html.get(r.page_id, "<p>a</p>") or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert r.refers_to == newest.get(r.page_id) and r.record_type == ("revisit" if r.page_id in newest else "response") and bytes(r.payload) == (b"" if r.page_id in newest else payload)
    place = index.where("page_id = 5").first()
    with open_seekable(place.bundle) as stream:
        fields, block = warc.parse(warc.BundleReader(stream).frame(place.frame)[place.offset:place.offset + place.length])
    assert block == html[5].encode() and fields["X-Page-ID"] == "5"
    assert warc.round_trip(pages.limit(0)).count() == 0
    apart = {r.page_id: r.record_type for r in warc.round_trip(pages, min_revisit_bytes=9).collect()}
    assert set(apart.values()) == {"response"}


def test_packing_is_a_partition_of_all_ids(spark, odd):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    df = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(5)
    pieces = packing.pack_documents(df, sequence_tokens=256).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    for doc, text in texts.items():
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled))) and all(filled[s] == 256 for s in range(len(filled) - 1))
    assert packing.pack_documents(odd.limit(0)).count() == 0 and packing.pack_documents(odd).where("start = 0").count() == odd.count()


def test_chunk_encoder_equals_the_tokenizer():
    encoder, rng = packing.ChunkEncoder(None, 2), random.Random(2)
    signs = [chr(c) for c in (*range(0x180), 0x2028, 0x3A3, 0x130, 0x1E9E, 0x301, 0x660, 0x4E2D, 0x1F600, 0xFB01, 0x212B, 0x24F, 0x250)] + ["'s", "'LL", "<|endoftext|>", " ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy</div><article><header><h1>Head &amp; more</h1></header>{body}
<form><label>Mail</label><input></form><aside>Side</aside><section id="comments"><p>First!</p></section></article><div id="sidebar">Links</div><footer>&copy; me</footer></body></html>"""


def test_extraction_of_articles_and_odd_pages(spark):
    body = "<p>One  two&nbsp;<b>th</b>ree<br>four<p>Five &lt;six&gt; a &lt b<ul><li>x<li>y</ul><div class='ad'>no</div><p>last"
    want = "Head & more One two three four Five <six> a < b x y last"
    pages = [(1, "http://a.b/1", PAGE.format(body=body)), (2, "http://a.b/2", PAGE.format(body="<p>" + LONG)), (3, "http://a.b/3", None), (4, None, "<p>plain<nav>menu</nav>"), (5, "http://c/", ""), (6, "http://c/", "just < text"),
             (None, "http://a.b/4", PAGE.format(body="")), (7, "http://a.b/7", "<body><div>no article here</div><nav>x</nav></body>"), (1, "http://a.b/1", PAGE.format(body=body)), (8, "http://d/", "<div>" * 3000 + "deep"),
             (9, "http://e/", "<main><div>m</div></main><div>out</div><script>never closed <p>x"), (10, "http://e/", "<a href='x>y'>quoted</a><a href=\"open>text")]
    out = html_extract.extract_main_text(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(pages) and got[1] == want and got[2] == f"Head & more {LONG}" and got[3] == "" and got[4] == "plain" and got[5] == "" and got[6] == "just < text"
    assert got[None] == "Head & more" and got[7] == "no article here" and got[8] == "deep" and got[9] == "m" and all(r.n_chars == len(r.text) for r in out)
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_align_optional_and_repeated_groups(spark):
    write = lambda slots: html_extract._write_items([(g, r, False) for g, r in html_extract.fold(slots)[0]])
    wrapper = html_extract._read_items(html_extract.infer([write(["h", "p", "p", "f"]), write(["h", "p", "f"]), write(["h", "x", "p", "f"])]))
    assert wrapper == [(("h",), False, False), (("x",), False, True), (("p",), True, False), (("f",), False, False)]
    streams = spark.createDataFrame([("h", write(["a|0", *[f"s{k}|3"], "z|-"]), 1) for k in range(30)], "host string, stream string, pages long")
    one = html_extract.infer_wrappers(streams, merged_streams=4).collect()
    assert len(one) == 1 and all(f"s{k}|3" in one[0].wrapper for k in range(30))


def test_texts_that_pages_without_names_repeat_are_template(spark):
    frame = "<div><div>Site of things</div><ul><li>Home<li>News{extra}</ul></div><div><h1>Title {k}</h1>{note}<p>First of {k}<p>Second of {k}</div><div>All rights reserved</div>"
    pages = [(k, f"http://plain/{k}", frame.format(k=k, extra="<li>Shop" if k % 2 else "", note="<p>Please log in" if k > 2 else "")) for k in range(6)]
    pages += [(10 + k, "http://plain/5", pages[5][2]) for k in range(8)]
    pages += [(20 + k, f"http://named/{k}", f"<div>Site</div><div>by {k}</div><article><h1>Title {k}</h1><p>Text {k}<p>Share this</article>") for k in range(10)]
    pages += [(30, "http://named/x", "<div>other</div><article><p>Share this</article>"), (40, "http://few/1", "<div>same</div><p>one"), (41, "http://few/2", "<div>same</div><p>two")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title {k} {'Please log in ' if k > 2 else ''}First of {k} Second of {k}" for k in range(6)) and all(got[10 + k] == got[5] for k in range(8))
    assert all(got[20 + k] == f"Title {k} Text {k} Share this" for k in range(10)) and got[30] == "Share this" and got[40] == "one"


@pytest.mark.parametrize("pages", [2, 3, 9, 10])
@pytest.mark.parametrize("page,want", [
    ("<div class='content'><h1>Title {k}</h1><h2>Summary</h2><p>Text {k}</p><h2>Method</h2><p>More {k}</p></div>", "Title {k} Summary Text {k} Method More {k}"),
    ("<div>Site</div><div><h1>Title {k}</h1><h2>Summary</h2><p>Text {k}</p></div><div>The end</div>", "Title {k} Summary Text {k}"),
    ("<div>Site</div><article><h1>Title {k}</h1><h2>Summary</h2><p>Text {k}</p><p>Thanks</p></article>", "Title {k} Summary Text {k} Thanks"),
    ("<div>Site</div><main><h1>Title {k}</h1><article><p>Body {k}</p></article></main>", "Title {k} Body {k}")])
def test_article_text_does_not_depend_on_the_number_of_pages(spark, pages, page, want):
    rows = [(k, f"http://h/{k}", page.format(k=k)) for k in range(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want.format(k=k) for k in range(pages)}


def test_decontamination_keeps_columns_named_like_its_helpers(spark):
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, text, 7, "a", "r"), (2, "clean", 8, "b", "s"), (None, None, 9, "c", "t")], "doc_id long, text string, __id int, __text string, __row string")
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert kept.columns == docs.columns and {r["__id"] for r in kept.collect()} == {8, 9}


def test_decontamination_splits_a_text_once_for_items_of_all_sizes(spark, monkeypatch):
    odd_chars = "".join(map(chr, [*range(0x250), 0x2028, 0x212A, 0x10400, 0x1F600]))
    body = "A b\u00c9 c\x00d  E1-f g\th i J k l m n\u00a0o b\u00c9 c d"
    texts = [body, odd_chars, "d", "c D", "D c d", "c", "", None, " \x00 ", f"{odd_chars} {body} {odd_chars}", "x " * 40 + "c d " * 3, words(1, 300), words(1, 300) + " D"]
    items = ["d", "C d", "b\u00c9 C d", "k l m n\u00a0o", body, words(1, 40), odd_chars, " ", None, "D"]
    split, calls = decontaminate._words, []
    monkeypatch.setattr(decontaminate, "_words", lambda text: calls.append(1) or split(text))
    docs, bench = spark.createDataFrame(enumerate(texts), "doc_id long, text string"), spark.createDataFrame(enumerate(items), "item_id long, text string")
    out = decontaminate.contaminated_documents(docs, bench)
    assert len(calls) == 3 and "regexp" not in out._jdf.queryExecution().toString()  # of items, for runs, for n_words
    got = by_id(out, "n_words", "n_hit", "n_items", "items_sha256")

    def plain(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    for k, text in enumerate(texts):
        w, hit, named = plain(text), set(), set()
        for item, i in ((str(n), plain(t)) for n, t in enumerate(items)):
            size = min(len(i), 10)
            windows = {tuple(i[j:j + size]) for j in range(len(i) - size + 1)} if i else set()
            starts = [j for j in range(len(w) - size + 1) if tuple(w[j:j + size]) in windows]
            hit.update(j + n for j in starts for n in range(size))
            named.update([item] * bool(starts))
        assert got[k] == (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()), k


@pytest.mark.parametrize("start,end", [("<article class='post comments-open'>", "</article>"), ("<div id='content' class='no-sidebar'>", "</div>"), ("<main class='has-banner'>", "</main>"),
                                       ("<div class='entry-content share'>", "</div>"), ("<div class='with-footer'>", "</div>"), ("<div class='post-123 has_ads'>", "</div>"), ("<article id=related>", "</article>")])
def test_names_of_states_do_not_hide_the_text(start, end):
    found = html_extract.text_blocks(f"<div class='site-footer'>foot</div><ul class='nav-links'><li>link</ul><div id='sidebar2'>side</div><div class='ad-300x250'>ad</div>{start}<p>text</p><div class='comment-list'>no</div><div class='cookie_notice'>no</div>{end}")
    assert [t for s, t in found if s[-1] != "-"] == ["text"]


def test_quality_learns_from_labels_only_and_scores_all(spark):
    rows = [(k, words(k, 80) + "." if k % 3 else " ".join(w.upper() + "!!" for w in words(k, 80).split())) for k in range(240)] + [(900, None), (901, ""), (None, "text"), (902, LONG)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(240)] + [(None, 1), (5, None), (6, 9)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels, F.col("doc_id") % 4 == 2).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.predicted == (r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 240)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(docs, labels.where("quality = 0"), F.lit(False)).collect()} == {0.0}
    assert quality.score_quality(docs.limit(0), labels, F.lit(False)).count() == 0


def test_discriminant_scores_are_density_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, quality.FEATURES)) + 1e6, rng.normal(size=(70, quality.FEATURES)) * 2 + 1e6 + 3
    moments = [(k, len(v), v.mean(axis=0), (v - v.mean(axis=0)).T @ (v - v.mean(axis=0))) for k, v in enumerate((x, y))]
    model = quality.fit(moments)
    z = (x[:5] - model.centre) / model.scale
    density = [-0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(f @ f.T), z - m) - 0.5 * np.linalg.slogdet(f @ f.T)[1] for m, f in zip(model.means, model.factors)]
    assert model.scores(x[:5]) == pytest.approx(1 / (1 + np.exp(density[0] - density[1] - np.log(70 / 50))))


def test_languages_of_held_out_and_odd_rows(spark, odd):
    speech = {"en": "the of and to in that was with thing", "de": "der die und nicht über straße schön ein", "fr": "le la les été où ça être une"}
    rng = random.Random(4)
    rows = [(100 + k, " ".join(rng.choices(speech[lang].split(), k=15)), lang, "s", 1, "x") for k, lang in enumerate(list(speech) * 40)]
    df = spark.createDataFrame(rows, DOC).union(odd.where("doc_id in (2, 3, 4, 9) or doc_id is null"))
    out = by_id(language_id.identify_languages(df, F.col("doc_id") % 5 == 0), "held_out", "lang_pred", "score")
    assert all(out[r[0]][1] == r[2] and 0.5 < out[r[0]][2] <= 1 for r in rows)
    assert all(out[k][1:] == ("und", 0.0) for k in (2, 3, 4, 9)) and out[None][1] in speech
    kept = language_id.keep_known_languages(df, F.col("doc_id") % 5 == 0)
    assert kept.columns == df.columns and kept.count() == len(rows) + 1
    nothing = language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and language_id.identify_languages(df.limit(0), F.lit(False)).count() == 0


def test_documents_with_letters_stay_where_no_language_can_be_learnt(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_known_languages(docs, F.lit(False)).collect()) == [1, 4]


def test_folded_product_equals_the_way_by_landmarks():
    texts = [words(k, 30) if k % 2 else words(k, 30).replace("a", "ö") for k in range(40)]
    rows = np.stack([language_id.presence(t) for t in texts])
    langs = ["x" if k % 2 else "y" for k in range(40)]
    model = language_id.fit(np.packbits(rows, axis=1), langs, landmarks_per_language=20)
    full = rows.astype(np.float64)
    marks = np.concatenate([full[1::2][:20], full[0::2][:20]])
    space = language_id.kernel(full, marks) @ np.linalg.pinv(language_id.kernel(marks, marks))
    inner = language_id.kernel(full, marks)
    alpha = np.linalg.lstsq(inner, model.outputs(rows), rcond=None)[0]
    assert np.allclose(inner @ alpha, model.outputs(rows), atol=1e-3) and space.shape == inner.shape
    assert all(model.languages[b] == lang for b, lang in zip(model.outputs(rows).argmax(axis=1), langs))


def test_texts_that_teach_a_language_are_bounded_and_repeated_rows_teach_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda packed, languages: seen.append(Counter(languages)))
    many = [(k, words(k, 5), "en") for k in range(400)] + [(7, "the same row", "fr")] * 400 + [(8, "one", "de"), (9, "none", None), (None, "no id", "de"), (10, "123", "it")]
    language_id.train(spark.createDataFrame(many, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 50)
    assert seen[0] == {"en": 50, "fr": 1, "de": 1}


def test_copies_follow_their_class_and_a_repeated_id_ties_two(spark):
    a, near, b = words(1, 60), words(1, 60) + " tail", words(2, 60)
    rows = [(9, a), (5, a), (7, a), (3, near), (8, b), (4, b), (8, a), (6, words(3, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.near_duplicate_documents(df), "component_id", "kept") == {k: (3, k == 3) for k in (3, 4, 5, 7, 8, 9)} | {6: (6, True)}
    assert minhash.near_duplicate_documents(df).count() == len(rows)
