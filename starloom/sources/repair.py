"""Repair of delimited lines whose fields were split or lost.

A malformed line is aligned to the schema by a small dynamic programme over its parts: a text field
may hold further parts (a stray separator), a field may be absent (a lost one). The alignment of fewest
such edits is taken if it is the only one; all other lines are listed with the reason.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_EDITS = 3
_FAR = 1 << 20


def _fits(parts: str, field: T.StructField, pattern: str | None) -> Column:
    """For each part whether it can be the field: by its type and pattern, or because it is empty."""
    def fit(part: Column) -> Column:
        ok = F.lit(True) if isinstance(field.dataType, T.StringType) else part.try_cast(field.dataType).isNotNull()
        return (part == "") | (ok if pattern is None else ok & part.rlike(f"^(?:{pattern})$"))

    return F.transform(parts, fit)


def align(fits: list[list[bool]], texts: list[bool], parts: int, most: int) -> tuple[list[tuple[int, int]] | None, int, int]:
    """Parts (start, end) of each field by the fewest edits, the edits, and how many ways there are (2: several).

    ``fits[j][i]`` tells whether part i can be in field j; only ``texts`` take more than one part.
    """
    fields = len(texts)
    if abs(parts - fields) > most:
        return None, _FAR, 0
    # (edits, ways, first part) of the first j fields over the first i parts
    best = [[(_FAR, 0, 0)] * (parts + 1) for _ in range(fields + 1)]
    best[0][0] = (0, 1, 0)
    for j in range(fields):
        for end in range(parts + 1):
            found = [(best[j][end][0] + 1, best[j][end][1], end)] if best[j][end][1] else []
            start = end - 1
            while start >= 0 and fits[j][start] and (start == end - 1 or texts[j]):
                edits, ways, _ = best[j][start]
                if ways:
                    found.append((edits + end - start - 1, ways, start))
                start -= 1
            if found:
                least = min(found)[0]
                level = [f for f in found if f[0] == least]
                best[j + 1][end] = (least, min(2, sum(f[1] for f in level)), level[0][2])
    edits, ways, _ = best[fields][parts]
    if not ways or edits > most:
        return None, edits, 0
    spans, end = [], parts
    for j in range(fields, 0, -1):
        start = best[j][end][2]
        spans.append((start, end))
        end = start
    return spans[::-1], edits, ways


def repair_lines(lines: DataFrame, schema: T.StructType, sep: str = "\t", patterns: Mapping[str, str] | None = None, most_edits: int = MOST_EDITS,
                 line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Typed rows (with ``edits``) of the lines that can be restored in one way, and (line, reason) of the rest.

    Give it the lines that ``read_tolerant`` sets aside. Fields of the schema are checked by their type and by
    ``patterns`` (regular expressions of single parts); an absent or empty typed field is null, and so is an absent text. A stray
    separator stays in the text it was in. Reasons: 'ambiguous' (several alignments of as few edits),
    'no alignment' (none within ``most_edits``, or only by separators both added and lost). Null lines are listed with the reason 'null'. Every line is in exactly one of the two tables.
    """
    patterns, texts, width = patterns or {}, [isinstance(f.dataType, T.StringType) for f in schema], len(schema)

    @F.pandas_udf("struct<edits int, ways int, fields array<string>>")
    def aligned(parts: pd.Series, fits: pd.Series) -> pd.DataFrame:
        out = []
        for own, fit in zip(parts, fits):
            own = [] if own is None else own
            spans, edits, ways = align(fit, texts, len(own), most_edits) if len(own) else (None, _FAR, 0)
            ways = ways if edits == abs(len(own) - width) else 0  # a line that both gained and lost parts is guesswork
            out.append((edits, ways, [sep.join(own[a:b]) if b > a else None for a, b in spans] if ways == 1 else None))
        return pd.DataFrame(out, columns=["edits", "ways", "fields"])

    parts = F.split(F.col("__line"), f"\\Q{sep}\\E", -1)
    # a line far from the schema's width is listed without looking at its parts
    near = F.when(F.abs(F.size(parts) - width) <= most_edits, parts).otherwise(F.array().cast("array<string>"))
    checks = F.array(*[_fits("__parts", f, patterns.get(f.name)) for f in schema])
    looked = lines.select(F.col(line_col).alias("__line")).withColumn("__parts", near).withColumn("__a", aligned("__parts", checks))
    one = (F.col("__a.ways") == 1) & F.col("__line").isNotNull()
    fields = F.col("__a.fields")
    typed = [F.get(fields, F.lit(i)).alias(f.name) if texts[i] else F.get(fields, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    reason = F.when(F.col("__line").isNull(), "null").when(F.col("__a.ways") > 1, "ambiguous").otherwise("no alignment")
    return (looked.where(one).select(*typed, F.col("__a.edits").alias("edits")),
            looked.where(~one).select(F.col("__line").alias("line"), reason.alias("reason")))
