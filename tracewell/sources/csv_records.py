"""CSV records out of split files, stitched by quote parity.

A quoted value may hold line breaks, so a line of a file need not be a record, and a reader that
must see whole records cannot split a file. Here files are read as lines, in byte ranges:

1. Quotes are counted per range. The sum over the ranges before, which is one row per range, says
   whether a range begins inside of a quoted value.
2. Each range is read from that state on. A line at whose end no quote is open ends a record;
   lines inside of an open quote are joined. Only what hangs over the ends of a range
   (at most one piece at either end) travels, and is joined with the pieces of its neighbours.

A table without such a line is left to the ordinary reader, which splits it as well.

Values are quoted by `"`, doubled inside; a quote elsewhere in an unquoted value would turn the
parity, and a file that ends inside of a quote is one malformed record more. Lines end in
LF or CRLF; line breaks inside of quotes stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a piece of text is to its range.
WHOLE, END, BEGIN, MIDDLE = 0, 1, 2, 3
RANGE = ["file", "start"]
PIECE = "value string, file string, start bigint, piece int"
NAMES = ["value", "file", "start", "piece"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def range_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Per range: its quotes, the lines after which a quote may be open, and the CRs inside of lines."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))
    breaks = F.length("value") - F.length(F.replace("value", F.lit("\r"))) - F.endswith("value", F.lit("\r")).cast("int")
    return (
        _lines(spark, path).select(*RANGE, quotes.alias("quotes"), breaks.alias("breaks"))
        .groupBy(*RANGE)
        .agg(F.sum("quotes").alias("quotes"), F.sum(F.col("quotes") % 2).alias("odd"), F.sum("breaks").alias("breaks"))
    )


def open_ranges(ranges: DataFrame) -> DataFrame:
    """The ranges that begin inside of a quoted value. One row per range comes in, so one task per file is enough."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*RANGE, (F.sum("quotes").over(before) % 2 == 1).alias("open")).where("open")


class _Range:
    """The lines of one range so far."""

    def __init__(self, key: tuple[str, int], opened: bool, header: bool):
        self.key, self.inside, self.continued = key, opened, opened
        self.held: list[str] = []
        self.first = key[1] == 0
        self.header = header and self.first

    def take(self, values: pa.Array) -> tuple[list[str], list[int]]:
        """Records that end in these lines."""
        parity = (np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) + self.inside) % 2
        ends = np.flatnonzero(parity == 0)
        records, pieces, begin = [], [], 0
        lines = values.to_pylist()
        if len(ends) == len(lines) and not self.held and not self.continued:
            records, pieces = lines, [WHOLE] * len(lines)
        else:
            for end in ends.tolist():
                records.append("\n".join([*self.held, *lines[begin:end + 1]]))
                pieces.append(END if self.continued else WHOLE)
                self.held, self.continued, begin = [], False, end + 1
            self.held += lines[begin:]
        self.inside = bool(parity[-1])
        if self.first and records:
            records[0] = records[0].removeprefix("﻿")
            if self.header:
                records, pieces = records[1:], pieces[1:]
            self.first = False
        return records, pieces

    def rest(self) -> tuple[list[str], list[int]]:
        if not self.held and not self.continued:
            return [], []
        return ["\n".join(self.held)], [MIDDLE if self.continued else BEGIN]


def _batch(records: list[str], pieces: list[int], key: tuple[str, int]) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.array(records, pa.string()), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(pieces, pa.int32())]
    return pa.record_batch(columns, NAMES)


def _stitch(header: bool):
    def run(batches):
        now: _Range | None = None
        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            # lines of one range follow each other
            key = pc.dictionary_encode(files).indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(starts) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
                if a == b:
                    continue
                own = (files[a].as_py(), int(starts[a]))
                if now is None or now.key != own:
                    if now is not None:
                        yield _batch(*now.rest(), now.key)
                    now = _Range(own, bool(batch.column("open")[a].as_py()), header)
                yield _batch(*now.take(batch.column("value").slice(a, b - a)), own)
        if now is not None:
            yield _batch(*now.rest(), now.key)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces at the ends of ranges as records. At most two pieces per range come in."""
    in_file = Window.partitionBy("file").orderBy("start", "piece")
    begun = F.last(F.when(F.col("piece") == BEGIN, F.col("start")), ignorenulls=True).over(in_file)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"])
    return (
        pieces.withColumn("begun", begun).groupBy("file", "begun").agg(F.array_join(parts, "\n").alias("value"))
        .select("value")
    )


def records(spark: SparkSession, path: str, ranges: DataFrame, header: bool = True) -> DataFrame:
    """(value) with one record in each row; blank lines are none."""
    opened = open_ranges(ranges)
    lines = _lines(spark, path).join(F.broadcast(opened), RANGE, "left")
    pieces = lines.mapInArrow(_stitch(header), PIECE)
    whole = pieces.where(F.col("piece") == WHOLE).select("value")
    both = whole.unionAll(_joined(pieces.where(F.col("piece") != WHOLE)))
    return both.select(F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
