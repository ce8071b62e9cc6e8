"""Rows of files by their place: line numbers and quoted records of splittable text, without sorting.

A scan hands out byte ranges of files, and the rows of a range in the order of the file. What a row
must know of the rows before it is summed up per range, in one small row each: their number, or the
parity of their quotes. Running sums of these over (file, start of range) then place every row of
a second scan. No row body is shuffled but those of records that cross the border of a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.plans.session import cut_lineage
from starloom.plans.sizing import fits_broadcast, lookup_join

_RANGE = ["__file", "__start"]
_PARTITIONS = "spark.sql.files.minPartitionNum"


def _above() -> WindowSpec:
    """The earlier ranges of a file."""
    return Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)


def _placed(scan: DataFrame) -> DataFrame:
    """A file scan with each row's file, range and running id (rows of a range have consecutive ones).

    The number of cores has a part in how files are cut; it is held fast for the session, so that both
    scans see the same ranges where executors come and go between them.
    """
    spark = scan.sparkSession
    if spark.conf.get(_PARTITIONS, None) is None:
        spark.conf.set(_PARTITIONS, spark.sparkContext.defaultParallelism)
    return scan.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()})


def number_file_rows(scan: DataFrame, name: str = "line_no", across: bool = False) -> DataFrame:
    """``scan``, straight from a file reader, with the 1-based number of each row in its file.

    ``across`` numbers on over all files, by path. The scan is read twice; between the two one row a
    byte range is shuffled. A header and blank lines that the reader skips are not counted.
    """
    placed = _placed(scan)
    ranges = placed.groupBy(*_RANGE).agg(F.count("*").alias("__rows"), F.min("__id").alias("__first"))
    ranges = cut_lineage(ranges.withColumn("__above", F.coalesce(F.sum("__rows").over(_above()), F.lit(0))))
    if across:
        earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
        files = ranges.groupBy("__file").agg(F.sum("__rows").alias("__all"))  # one row a file
        files = files.select("__file", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__files_above"))
        ranges = ranges.join(files, "__file").withColumn("__above", F.col("__above") + F.col("__files_above"))
    found = lookup_join(placed, ranges.select(*_RANGE, "__first", "__above"), _RANGE)
    return found.select(*scan.columns, (F.col("__above") + F.col("__id") - F.col("__first") + 1).alias(name))


def sample_file_rows(scan: DataFrame, rate: int, across: bool = False) -> DataFrame:
    """Rows ``rate``, 2 ``rate``, ... of each file of a scan, or of all files in turn; rate 0 keeps all."""
    return scan if rate == 0 else number_file_rows(scan, "__line", across).where(F.col("__line") % rate == 0).drop("__line")


def file_line_range(scan: DataFrame, first: int, last: int, name: str = "line_no", across: bool = False) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based, inclusive) of each file of a scan, or of all files in turn."""
    return number_file_rows(scan, name, across).where(F.col(name).between(first, last))


# -- quoted records ----------------------------------------------------------------------------

_EDGES = "__file string, __start long, __first long, __rows long, __parity long, __to_odd long, __past_even long, __past_odd long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where the byte range changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("__start").to_numpy()
        files = batch.column("__file").dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield (batch.column("__file")[a].as_py(), int(starts[a])), batch.slice(a, b - a)


def _range_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: its first id and number of lines, the parity of its quotes, the number of its
    lines up to the first with odd parity (0: none), and of those after the last with even, and odd, parity."""
    names = [c.split()[0] for c in _EDGES.split(", ")]
    now, held = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), *(pa.array([v], pa.int64()) for v in (now[1], *held))], names=names)

    for key, part in _runs(batches):
        if key != now:
            if now is not None:
                yield row()
            now, held = key, [int(part.column("__id")[0].as_py()), 0, 0, 0, 0, 0]
        first, rows, parity, to_odd, past_even, past_odd = held
        after = (part.column("__quotes").to_numpy().cumsum() + parity) & 1
        odd, even = np.flatnonzero(after == 1), np.flatnonzero(after == 0)
        held = [first, rows + len(after), int(after[-1]), to_odd or (rows + int(odd[0]) + 1 if len(odd) else 0),
                len(after) - 1 - int(even[-1]) if len(even) else past_even + len(after), len(after) - 1 - int(odd[-1]) if len(odd) else past_odd + len(after)]
    if now is not None:
        yield row()


def _joined_lines(quote: str):
    """Lines of whole records, in order, as records; every range begins and ends between two records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rest, fresh = None, None, True
        for key, part in _runs(batches):
            if key != now:
                now, rest, fresh = key, None, True
            lines = part.column("value") if rest is None else pa.concat_arrays([rest, part.column("value")])
            after = pc.count_substring(lines, quote).to_numpy().cumsum() & 1
            ends = np.flatnonzero(after == 0) + 1
            whole = int(ends[-1]) if len(ends) else 0
            rest = lines.slice(whole) if whole < len(lines) else None
            if not whole:
                continue
            records = lines.slice(0, whole)
            if len(ends) < whole:
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), records), "\n")
            first = np.zeros(len(records), bool)
            first[0], fresh = fresh, False
            yield pa.RecordBatch.from_arrays([records, pa.array([key[0]] * len(records)), pa.array(np.full(len(records), key[1])), pa.array(first)], names=["value", *_RANGE, "__leads"])

    return run


def quoted_records(spark: SparkSession, path: str, quote: str = '"', header: bool = False) -> DataFrame:
    """Records (``value``) of text whose quoted fields may hold line breaks, from splittable ranges.

    First scan: each byte range gives the number of its lines, the parity of its quotes, and where the
    first and last records may be cut, whichever parity the range begins with. The running sum of the parities
    tells which one holds, hence which lines at its borders belong to records that cross them.
    Second scan: inside a range the lines of a record are joined; only the crossing lines are
    shuffled, to the range in which their record begins. Quotes inside fields are doubled and such
    fields quoted, as ``write_csv`` writes them. Blank records are left out, and with ``header`` the
    first record of each file. A quote left open runs to the end of its file.
    """
    lines = _placed(spark.read.option("lineSep", "\n").text(path)).select("value", *_RANGE, "__id")
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    edges = lines.select(*_RANGE, "__id", quotes.cast("long").alias("__quotes")).mapInArrow(_range_edges, _EDGES)
    begun_odd = F.coalesce(F.sum("__parity").over(_above()), F.lit(0)) % 2 == 1
    edges = edges.withColumns({"__odd": begun_odd, "__top": F.row_number().over(Window.partitionBy("__file").orderBy("__start")) == 1})
    heads = F.when(F.col("__odd"), F.when(F.col("__to_odd") > 0, F.col("__to_odd")).otherwise(F.col("__rows"))).otherwise(0)
    tails = F.when(~F.col("__odd"), F.col("__past_even")).when(F.col("__to_odd") > 0, F.col("__past_odd")).otherwise(0)
    edges = edges.withColumn("__head", heads).withColumn("__tail", tails)
    opened = F.last(F.when(F.col("__tail") > 0, F.col("__start")), ignorenulls=True).over(_above())
    edges = cut_lineage(edges.select(*_RANGE, "__first", "__rows", "__head", "__tail", "__top", opened.alias("__opened")))

    if fits_broadcast(edges):
        found = lines.join(F.broadcast(edges), _RANGE)  # keeps the lines of a range in order
    else:
        found = lines.join(edges, _RANGE).repartition(*_RANGE).sortWithinPartitions(*_RANGE, "__id")
    place = F.col("__id") - F.col("__first")
    in_head, in_tail = place < F.col("__head"), place >= F.col("__rows") - F.col("__tail")
    inside = found.where(~in_head & ~in_tail).mapInArrow(_joined_lines(quote), "value string, __file string, __start long, __leads boolean")
    crossing = found.where(in_head | in_tail).withColumn("__record", F.when(in_head, F.col("__opened")).otherwise(F.col("__start")))
    leads = F.bool_or(F.col("__top") & in_tail & (place == 0))
    crossing = crossing.groupBy("__file", "__record").agg(F.array_sort(F.collect_list(F.struct("__start", "__id", "value"))).alias("pieces"), leads.alias("__leads"))
    if header:
        top = edges.where("__top and __tail < __rows").select(*_RANGE, F.lit(True).alias("__is_top"))  # one row a file
        inside = lookup_join(inside, top, _RANGE, "left").where(~(F.col("__leads") & F.coalesce("__is_top", F.lit(False))))
        crossing = crossing.where(~F.col("__leads"))
    both = inside.select("value").unionByName(crossing.select(F.array_join("pieces.value", "\n").alias("value")))
    return both.withColumn("value", F.regexp_replace("value", "\r$", "")).where("value <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Comma-separated records with doubled quotes and line breaks in fields, read by as many tasks as the bytes ask for.

    Gives the rows of the reader's own ``multiLine`` scan, which takes a task a file.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "dateFormat": date_format}
    return quoted_records(spark, path, header=header).select(F.from_csv("value", columns, options).alias("__r")).select("__r.*")
