"""The registered corpus queries against their SQL, and the pipeline against a plain reading of its stages."""

from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from starloom.llm import line_dedup
from starloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_every_numbered_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_equals_a_plain_reading(spark):
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {k: v for k, v in docs.items() if any(c.isalpha() for c in v[1])}
    sites, first = defaultdict(set), {}
    for k in sorted(docs):
        for pos, line in enumerate(docs[k][1].split("\n")):
            if norm := line.strip(" \t\r"):
                sites[norm].add(docs[k][0])
                first.setdefault(norm, (k, pos))
    texts = {}
    for k, (_, text) in docs.items():
        lines = text.split("\n")
        gone = [len(sites[n]) >= line_dedup.MIN_SITES and first[n] != (k, pos) if (n := x.strip(" \t\r")) else False for pos, x in enumerate(lines)]
        if not any(gone) or sum(gone) < sum(bool(x.strip(" \t\r")) for x in lines):
            texts[k] = "\n".join(x for x, g in zip(lines, gone) if not g)
    lower = {k: "".join(c.lower() if "A" <= c <= "Z" else c for c in t) for k, t in texts.items()}
    sets = {k: {tuple(w[i:i + min(5, len(w))]) for i in range(max(len(w) - 5, 0) + 1)} if (w := t.split()) else set() for k, t in lower.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x

    def plain(t):
        return "".join(c if c.isascii() and (c.isdigit() or "a" <= c <= "z") or not c.isascii() else " " for c in t).split(" ")

    windows = set()
    for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall():
        w = [x for x in plain(t.lower()) if x]
        windows |= {tuple(w[i:i + min(10, len(w))]) for i in range(max(len(w) - 10, 0) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    want = set()
    for k in ids:
        w = [x for x in plain(lower[k]) if x]
        if find(k) == k and not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.add(k)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())
