import itertools

import numpy as np
import pytest
from pyspark.sql import types as T

from starloom.sources.repair import align, repair_lines
from starloom.sources.tables import read_tolerant

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("stars", T.IntegerType()),
                       T.StructField("vine", T.StringType()), T.StructField("body", T.StringType()), T.StructField("day", T.DateType())])
PATTERNS = {"vine": "[YN]"}


def _every_way(fits, texts, parts):
    """All alignments as spans with their edits, by trying every cut."""
    found = []
    for cuts in itertools.combinations_with_replacement(range(parts + 1), len(texts) - 1):
        spans = list(zip((0, *cuts), (*cuts, parts)))
        if all(e - s <= 1 or t for (s, e), t in zip(spans, texts)) and all(fits[j][i] for j, (s, e) in enumerate(spans) for i in range(s, e)):
            found.append((sum(1 if e == s else e - s - 1 for s, e in spans), spans))
    return found


@pytest.mark.parametrize("seed", range(60))
def test_alignment_equals_trying_every_cut(seed):
    rng = np.random.default_rng(seed)
    fields, parts = int(rng.integers(1, 6)), int(rng.integers(1, 7))
    texts = [bool(b) for b in rng.random(fields) < 0.5]
    fits = [[bool(b) for b in rng.random(parts) < 0.7] for _ in range(fields)]
    ways = _every_way(fits, texts, parts)
    spans, edits, count = align(fits, texts, parts, 9)
    if not ways:
        assert spans is None and count == 0
        return
    least = min(ways)[0]
    best = [s for e, s in ways if e == least]
    assert edits == least and min(2, len(best)) == count and spans in best


def test_planted_tabs_are_restored_or_listed(spark, tmp_path):
    good = "1\tA title\t5\tN\tSome body\t2015-01-02"
    cases = {
        good: None,
        "2\tA\ttitle\t5\tN\tSome body\t2015-01-02": (2, "A\ttitle", 5, "N", "Some body", 1),
        "3\tA title\t5\tN\tSome\tbody\there\t2015-01-02": (3, "A title", 5, "N", "Some\tbody\there", 2),
        "4\tA title\tN\tSome body\t2015-01-02": (4, "A title", None, "N", "Some body", 1),
        "5\t5\tN\tSome body\t2015-01-02": "ambiguous",
        "6\tA title\t5\tNSome body\t2015-01-02": (6, "A title", 5, None, "NSome body", 1),
        "x7\tA title\t5\tN\tSome body\t2015-01-02": "no alignment",
        "8" + "\t" * 5000: "no alignment",
        "": "no alignment",
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "lines.txt").write_text("\n".join(cases) + "\n")
    rows, bad = read_tolerant(spark, str(tmp_path / "in"), SCHEMA)
    fixed, rest = repair_lines(bad, SCHEMA, patterns=PATTERNS)
    assert [r.id for r in rows.collect()] == [1]
    assert {tuple(r)[:5] + (r.edits,) for r in fixed.collect()} == {c for c in cases.values() if isinstance(c, tuple)}
    assert {r.line: r.reason for r in rest.collect()} == {k: c for k, c in cases.items() if isinstance(c, str)}


def test_null_lines_extra_columns_and_empty_tables(spark):
    lines = spark.createDataFrame([(None, 1), ("1\tt\t5\tN\tb\textra\t2015-01-02", 2)], "line string, __parts int")
    fixed, rest = repair_lines(lines, SCHEMA, patterns=PATTERNS)
    assert [r.body for r in fixed.collect()] == ["b\textra"] and [tuple(r) for r in rest.collect()] == [(None, "null")]
    fixed, rest = repair_lines(lines.limit(0), SCHEMA)
    assert fixed.count() == 0 and rest.count() == 0
