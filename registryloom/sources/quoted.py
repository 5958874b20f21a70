"""Delimited files with line breaks in quoted cells, read by byte range.

A reader that splits a file cannot tell whether a line break ends a row. Here the quotes of each
byte range are counted first; sums over the ranges before it tell whether a range begins inside a
cell. Each range then puts its own rows together, and rows that cross its edges meet as at most two
pieces a range. No file is read by one task, and no line is moved that lies in one range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Byte ranges of which what is known is broadcast; with more it is joined by shuffle.
MAX_BROADCAST_RANGES = 200_000
#: A piece of a row: all of it, its end, its beginning, what lies between; and of a file's first row
#: all of it or its beginning.
WHOLE, END, BEGIN, MIDDLE, HEADER, HEADER_BEGIN = range(6)
_AT = ["file", "start"]
_OPEN, _NUMBER = "open", "number"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: the lines of each byte range in order, by the range's file and offset."""
    text = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return text.select(*place, F.col("value").alias("line"))


def _open_ranges(lines: DataFrame, quote: str) -> DataFrame:
    """``file, start, open``: whether each byte range begins inside a quoted cell."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    counts = lines.groupBy(*_AT).agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return counts.select(*_AT, inside.alias(_OPEN))


class _Range:
    """Puts the lines of one byte range together to rows, over as many batches as hold them."""

    def __init__(self, place: tuple[str, int], is_open: bool, quote: str):
        self.place, self.quote = place, quote
        self.quotes = int(is_open)
        self.begun_before = is_open
        self.first = place[1] == 0
        self.held: list[str] = []

    def add(self, lines: pa.Array) -> tuple[list[int], list[str]]:
        """Kinds and texts of the rows that end in these lines."""
        lines = lines.fill_null("")
        total = self.quotes + np.cumsum(pc.count_substring(lines, self.quote).to_numpy(zero_copy_only=False))
        self.quotes = int(total[-1])
        ends = np.flatnonzero(total % 2 == 0)
        texts, begin, values = [], 0, lines.to_pylist()
        for end in ends.tolist():
            if begin == end and not self.held:
                texts.append(values[end])
            else:
                texts.append("\n".join([*self.held, *values[begin : end + 1]]))
                self.held = []
            begin = end + 1
        self.held += values[begin:]
        kinds = [WHOLE] * len(texts)
        if texts and self.begun_before:
            kinds[0], self.begun_before = END, False
        elif texts and self.first:
            kinds[0] = HEADER
        self.first &= not texts
        return kinds, texts

    def rest(self) -> tuple[list[int], list[str]]:
        """What the range leaves open."""
        if not self.held:
            return [], []
        begin = HEADER_BEGIN if self.first else BEGIN
        return [MIDDLE if self.begun_before else begin], ["\n".join(self.held)]


def _pieces(lines: DataFrame, quote: str) -> DataFrame:
    """``file, start, kind, text`` from lines that know whether their range begins in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: _Range, found: tuple[list[int], list[str]]) -> pa.RecordBatch:
            kinds, texts = found
            place = [pa.array([x] * len(texts), t) for x, t in zip(held.place, (pa.string(), pa.int64()))]
            columns = [*place, pa.array(kinds, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*_AT, "kind", "text"])

        held = None
        for batch in batches:
            files, starts = (batch.column(c) for c in _AT)
            keys = np.stack([files.dictionary_encode().indices.to_numpy(), starts.to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                place = files[a].as_py(), starts[a].as_py()
                if held is None or held.place != place:
                    if held is not None:
                        yield made(held, held.rest())
                    held = _Range(place, batch.column(_OPEN)[a].as_py(), quote)
                yield made(held, held.add(batch.column("line").slice(a, b - a)))
        if held is not None:
            yield made(held, held.rest())

    return lines.mapInArrow(run, "file string, start bigint, kind int, text string")


def _joined(pieces: DataFrame) -> DataFrame:
    """``kind, text`` of rows whose pieces lie in several ranges: each goes to where it begins."""
    upto = Window.partitionBy("file").orderBy("start", "kind")
    begins = F.col("kind").isin(BEGIN, HEADER_BEGIN)
    begun = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(upto)
    owned = pieces.withColumn("owner", F.coalesce(begun, F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    rows = owned.groupBy("file", "owner").agg(parts.alias("parts"))
    kind = F.when(F.col("parts")[0]["kind"] == HEADER_BEGIN, HEADER).otherwise(WHOLE)
    return rows.select("file", kind.alias("kind"), F.array_join(F.col("parts.text"), "\n").alias("text"))


def read_quoted(
    spark: SparkSession, path: str, columns: Sequence[str], quote: str = '"', options: dict[str, str] | None = None
) -> DataFrame:
    """The rows of delimited files with a header, as text columns, each file in many tasks.

    Quotes must be balanced, as every writer leaves them: a quote always opens or closes a cell or
    is one of two. Lines end with a line feed, with or without a carriage return before it. Every
    file's header must name ``columns``; another one is an error. ``options`` go to the parser.
    """
    lines = _lines(spark, path)
    known = _open_ranges(lines, quote)
    # The plan alone tells how many ranges there are, about: a few a task. Most begin outside a cell.
    if lines.rdd.getNumPartitions() <= MAX_BROADCAST_RANGES:
        placed = lines.join(F.broadcast(known.filter(_OPEN)), _AT, "left").fillna(False, [_OPEN])
    else:
        numbered = lines.withColumn(_NUMBER, F.monotonically_increasing_id())
        placed = numbered.join(known, _AT).sortWithinPartitions(*_AT, _NUMBER).drop(_NUMBER)
    pieces = _pieces(placed, quote)
    apart = F.col("kind").isin(END, BEGIN, MIDDLE, HEADER_BEGIN)
    rows = pieces.filter(~apart).select("file", "kind", "text").unionByName(_joined(pieces.filter(apart)))
    text = F.regexp_replace("text", "\r$", "")
    rows = rows.withColumn("text", text).filter(F.length("text") > 0)
    schema = ", ".join(f"`c{i}` string" for i in range(len(columns)))
    parse = {"multiLine": "true", "escape": quote, "quote": quote, **(options or {})}
    plain = F.when(F.col("kind") == HEADER, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    row = F.from_csv(plain, F.lit(schema), parse)
    cells = [F.col(f"row.c{i}") for i in range(len(columns))]
    named = F.array(*[F.coalesce(c, F.lit("")) for c in cells]) == F.array(*[F.lit(n) for n in columns])
    odd = F.raise_error(F.concat(F.lit("the header is not as expected in "), F.col("file")))
    parsed = rows.select("file", "kind", row.alias("row"))
    kept = F.when(F.col("kind") == WHOLE, True).when(named, False).otherwise(odd.cast("boolean"))
    return parsed.filter(kept).select(*[c.alias(n) for c, n in zip(cells, columns)])
