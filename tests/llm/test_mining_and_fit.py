"""Whitening, hard-negative mining and best-fit packing against brute force, and the token encoder against its tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from starloom.llm import hard_negatives, tokens, whitening
from starloom.llm.best_fit import RULES, Capacities, best_fit, pack_best_fit

NAN, INF = float("nan"), float("inf")


# -- tokens ------------------------------------------------------------------------------------


@pytest.mark.parametrize("segment", [7, 64, 4 << 20])
def test_batch_encoder_equals_the_tokenizer(monkeypatch, segment):
    monkeypatch.setattr(tokens, "_SEGMENT_BYTES", segment)
    rng = random.Random(5)
    signs = [chr(c) for c in (*range(0x180), 0x2028, 0x3A3, 0x130, 0x1E9E, 0x301, 0x660, 0x4E2D, 0x1F600, 0xFB01, 0x212B, 0x24F, 0x250)]
    signs += ["'s", "'LL", "<|endoftext|>", "<|", " ", "\n", "×", "÷"] + list(" abCDÀàÉé7") * 12
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(2000)] + [None, "", " "]
    encoder = tokens.BatchEncoder(None, 2)
    ids, counts = encoder.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == [*encoder.chunks.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], repr(text)
    part, sizes = encoder.encode(pa.array(texts).slice(100, 50))
    assert (part == ids[ends[99]:ends[149]]).all() and (sizes == counts[100:150]).all()
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


# -- best fit ----------------------------------------------------------------------------------


def unrolled(plan):
    """Sequence -> [(offset, length)], and how many pieces of each length the plan places, by consecutive ranks."""
    held, ranks = defaultdict(list), defaultdict(list)
    for p in plan:
        ranks[p.length] += range(p.first, p.first + p.count)
        for k in range(p.count):
            held[p.sequence + k].append((p.offset, p.length))
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    return held, {k: len(r) for k, r in ranks.items()}


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("capacities", [Capacities(100), Capacities(100, documents=3), Capacities(100, attention=3000), Capacities(100, 2, 5200)])
def test_every_constraint_holds_and_few_sequences_are_used(rule, capacities):
    rng = random.Random(4)
    sizes = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(3000))
    held, placed = unrolled(best_fit(sizes, capacities, rule=rule))
    assert placed == dict(sizes) and sorted(held) == list(range(len(held)))
    most = capacities.vector()
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100 and len(pieces) <= most[1] and (len(pieces) == 1 or sum(n * n for _, n in pieces) <= most[2])
    bound = max(-(-sum(k * n for k, n in sizes.items()) // most[0]), -(-sum(sizes.values()) // most[1]), -(-sum(min(k * k, most[2]) * n for k, n in sizes.items()) // most[2]))
    assert len(held) <= 1.35 * bound and (capacities != Capacities(100) or len(held) <= bound + 1)


def one_by_one(lengths, full, weights):
    """Best-fit decreasing, a piece at a time over all open sequences."""
    bins = []
    for n in sorted(lengths, reverse=True):
        item = (n, 1, n * n)
        rooms = [b for b in bins if all(r >= i for r, i in zip(b, item))]
        best = min(rooms, key=lambda b: sum(w * ((r - i) / f) ** 2 for w, r, i, f in zip(weights, b, item, full)), default=None)
        if best is None:
            bins.append(best := list(full))
        best[:] = [r - i for r, i in zip(best, item)]
    return len(bins)


def test_equal_pieces_together_need_no_more_sequences_than_one_by_one():
    for seed in range(12):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
        for caps in (Capacities(60), Capacities(60, 4, 2400)):
            weights = (1.0, 0.1, 0.1)
            got = len(unrolled(best_fit(Counter(lengths), caps, weights))[0])
            assert got <= one_by_one(lengths, caps.vector(), weights) + 1


def test_an_unknown_rule_is_refused_and_oversized_pieces_stand_alone():
    with pytest.raises(ValueError):
        best_fit({3: 1}, rule="worst")
    held, _ = unrolled(best_fit({90: 3, 10: 3}, Capacities(100, attention=5000)))
    assert sorted(sorted(n for _, n in v) for v in held.values())[-3:] == [[90]] * 3
    assert best_fit({}) == []


def test_pack_best_fit_places_all_ids_once(spark):
    rows = [(1, "One line.\nSame line"), (1, "One line.\nSame line"), (2, None), (3, ""), (4, " \t\n "), (5, " ".join(f"w{k}" for k in range(9000))), (None, "Same line"), (6, "x " * 63), (7, "y " * 64), (8, "z " * 20)]
    rows += [(k, "word " * (k % 41)) for k in range(10, 160)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, length int, sequence_id string").repartition(5)
    out = pack_best_fit(df, capacities=Capacities(64)).collect()
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[doc, k // 64, k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for p, n in v if p < o) for v in held.values() for o, _ in v)
    assert all(sum(n for _, n in v) <= 64 for v in held.values()) and len(held) <= -(-sum(r.length for r in out) // 64) + 1
    assert pack_best_fit(df.limit(0)).count() == 0


# -- whitening ---------------------------------------------------------------------------------


def brute_whitening(x, k):
    n = len(x)
    mean = [sum(int(v) for v in col) / n for col in x.T]
    centred = x - np.array([sum(int(v) for v in col) // n for col in x.T]) - np.array([sum(int(v) for v in col) % n / n for col in x.T])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    sums = [sum(int(v) for v in col) for col in x.T]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert len(mean) == x.shape[1]
    return centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum(), deviation


@pytest.mark.parametrize("condition", [1.0, 1e-4])
def test_whitening_against_eigenvectors(spark, condition):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(700, 12)) * np.geomspace(40, 40 * condition, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    data = data.astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(data)]
    odd = [(9000, None), (9001, []), (9002, [NAN] * 12), (9003, [None] + [1.0] * 11), (9004, [INF] * 12), (9005, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, n int, component int").repartition(6)
    out = whitening.whiten(df, components=8).collect()
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    white, share, deviation = brute_whitening(x, 8)
    got, extra = np.zeros((700, 8)), {}
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        extra[r.component] = r.explained
        assert r.n == 700 and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-8
    assert len(out) == 700 * 8 and np.allclose([extra[k + 1] for k in range(8)], share, rtol=1e-9)
    got *= np.sign((got * white).sum(axis=0))
    assert np.abs(got - white).max() < 1e-6


def test_whitening_of_flat_and_few_vectors(spark):
    def run(rows, **kw):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **kw).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]) == []
    out = run([(1, [0.0, 5.0, 1.0]), (2, [1.0, 5.0, 2.0]), (2, [1.0, 5.0, 2.0]), (None, [4.0, 5.0, 5.0])])  # the third dimension follows the first
    assert {r.component for r in out} == {1} and len(out) == 4 and all(r.identity_error < 1e-9 and abs(r.explained - 1) < 1e-9 for r in out)
    assert abs(sum(r.whitened for r in out)) < 1e-9
    wide = run([(k, [float(k % 3 == j) for j in range(40)]) for k in range(9)])
    assert {r.component for r in wide} == {1, 2}
    far = run([(1, [1e10]), (2, [-1e10]), (3, [0.0])])
    assert all(r.deviation is None for r in far if r.vec_id < 3) and {r.deviation for r in far if r.vec_id == 3} == {0}


def test_forward_substitution_equals_the_inverse():
    rng = np.random.default_rng(1)
    lower = np.tril(rng.normal(size=(75, 75))) + 9 * np.eye(75)
    b = rng.normal(size=(75, 20))
    assert np.allclose(lower @ whitening._forward(lower, b), b)


# -- hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, every, positives=5, negatives=10):
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, _, v in rows}
    label = {i: c for i, c, _ in rows}
    out = set()
    for a in x:
        if a % every:
            continue
        score = {b: int(x[a] @ x[b]) for b in x if b != a}
        ranked = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in ranked if label[b] == label[a]][:positives]:
            hit = [b for b in ranked if label[b] != label[a] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:negatives]
            out |= {(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(hit)}
    return out


@pytest.mark.parametrize("clusters, unit, stripe, spread", [(1, 1000, 10_000, 1.0), (9, 40, 300, 1.0), (None, 16, 200, 0.1)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, clusters, unit, stripe, spread):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 128)
    monkeypatch.setattr(hard_negatives, "_BLOCK_SCORES", 4096)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    data = (centres[rng.integers(0, 12, 900)] * (1 - spread) + rng.normal(size=(900, 16)) * spread).astype(np.float32)
    data[100:160] = data[100]  # one common vector, so ties by id
    data[200] = 0
    rows = [(k, int(rng.integers(0, 4)), [float(v) for v in r]) for k, r in enumerate(data)]
    odd = [(7000, 1, None), (7010, None, rows[0][2]), (7020, 1, [NAN] * 16), (7030, 1, [None] * 16), (7040, 1, []), (7050, 1, [1.0]), (None, 1, rows[0][2]), (7060, 1, [1e30] * 16), rows[5], (5, 99, rows[6][2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, label int, embedding array<float>, rank int, id int").repartition(7)
    out = hard_negatives.hard_negatives(df, anchor_every=10, clusters=clusters, unit_anchors=unit, stripe_rows=stripe).collect()
    assert {tuple(r) for r in out} == brute_negatives(rows, 10) and len(out) == len({tuple(r) for r in out})


def test_walks_stop_early_on_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    x = np.floor(256 * (np.repeat(centres, 500, axis=0) + rng.normal(size=(4000, 8)) * 0.02))
    met = []

    class Counted(hard_negatives._Walk):
        def _score(self, members, ids, labels, rows):
            met.append(len(members) * len(ids))
            super()._score(members, ids, labels, rows)

    ids, labels = np.arange(4000), rng.integers(0, 5, 4000)
    asked = np.arange(0, 4000, 100)
    walk = Counted(ids[asked], labels[asked], x[asked], np.repeat(np.arange(8), 5), centres, 5, True, np.full((40, 1), -np.inf), np.full((40, 1), np.inf))
    walk.meet(ids, labels, x)
    assert sum(met) < 0.3 * 40 * 4000


def test_hard_negatives_of_empty_and_lonely_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], kind)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0]), (2, 2, [1.0])], kind)).count() == 0
