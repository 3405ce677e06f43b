"""Problem 3: rows that fail to parse, separated with their reason while the valid rows load.

Delimited text: `assemble_records` puts physical lines together to records by their quotes, in windows over
bounded chunks of lines, so that one large file isn't one task; `read_delimited` then parses each record with the
strict csv reader inside mapInArrow. Structural failures (quoting, column count) are caught before any typed field is
built, then each field's own. Both kinds of outcome leave in one stream: either reason_code is null and the
record's columns are set, or reason_code says which check failed first and they are null.

Pages are HTML, which the csv module can't read (over a page it finds broken quoting or a wrong column count,
whatever the page holds), so `parse_or_reject` takes `functions.html` in its place, a reader of the same kind: quotes
decide where a tag ends, an unclosed quote swallows what follows up to the next one, structure comes before types.

Defined cases
- null page: html_error. Empty or blank page, or bytes that are no text: no_article. Null url: no_listing_id.
- a value too large for its column is a reason: overflow_<column>.
- null line: null_record. A quote that is never closed runs on until quotes balance again or, where the caller says how
  records begin, to the next line that begins so; what it swallowed comes out as one reject with its whole text. A record of
  over MOST_LINES lines comes out in pieces of so many, each bad_quoting.
- repeated rows each come out; other columns pass through under their own names, clashing ones are refused.
- an empty table gives an empty result. Very long pages and records are read whole.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

REASON = "reason_code"


class Overflow(Exception):
    """A value too large for its column."""


_WHOLE = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15}


def _decimal(kind: T.DecimalType) -> Callable[[Any], Decimal]:
    unit, most = Decimal(1).scaleb(-kind.scale), kind.precision - kind.scale

    def fit(value: Any) -> Decimal:
        try:
            value = Decimal(value).quantize(unit, rounding=ROUND_HALF_UP)
        except InvalidOperation:
            raise Overflow from None
        if not value.is_finite() or value.adjusted() >= most:
            raise Overflow
        return value

    return fit


def _whole(bits: int) -> Callable[[Any], int]:
    most = 1 << bits

    def fit(value: int) -> int:
        if not -most <= value < most:
            raise Overflow
        return value

    return fit


def fitter(record: T.StructType) -> Callable[[tuple[str | None, dict | None]], tuple[str | None, dict | None]]:
    """What rounds the values of a parser's outcome to their columns, or rejects it by the first that doesn't fit."""
    fits = [(f.name, _decimal(f.dataType) if isinstance(f.dataType, T.DecimalType) else _whole(_WHOLE[type(f.dataType)])) for f in record.fields if isinstance(f.dataType, (T.DecimalType, *_WHOLE))]

    def fitted(outcome: tuple[str | None, dict | None]) -> tuple[str | None, dict | None]:
        found = outcome[1]
        if found is None:
            return outcome
        for name, fit in fits:
            if (value := found.get(name)) is not None:
                try:
                    found[name] = fit(value)
                except Overflow:
                    return f"overflow_{name}", None
        return outcome

    return fitted


def parse_or_reject(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], parser: Callable[..., tuple[str | None, dict | None]], record: T.StructType) -> DataFrame:
    """keep, reason_code and the record's columns for every row of df; parser(*inputs) gives (code, None) or
    (None, record). keep and the record must not share names."""
    if clash := {*keep, REASON} & {*record.names}:
        raise ValueError(f"columns to keep clash with the record's: {sorted(clash)}")
    kept = T.StructType([df.schema[c] for c in keep])
    out = T.StructType([*kept.fields, T.StructField(REASON, T.StringType()), *record.fields])
    arrow, fitted = to_arrow_schema(out), fitter(record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fitted(parser(*values)) for values in zip(*(batch.column(f"__in{i}").to_pylist() for i in range(len(inputs))))]
            columns = [batch.column(c) for c in keep] + [pa.array([r[0] for r in rows], pa.string())]
            for f in record.fields:
                values = [None if r[1] is None else r[1].get(f.name) for r in rows]
                columns.append(pa.array(values, arrow.field(f.name).type))
            yield pa.RecordBatch.from_arrays([a.cast(arrow.field(i).type) for i, a in enumerate(columns)], schema=arrow)

    picked = df.select(*keep, *[df[c].alias(f"__in{i}") for i, c in enumerate(inputs)])
    return picked.mapInArrow(run, out)


def delimited_parser(names: Sequence[str], convert: dict[str, Callable[[str], Any]], delimiter: str = ",") -> Callable[[str | None], tuple[str | None, dict | None]]:
    """A parser of one assembled delimited record by the strict csv reader. Codes: null_record, bad_quoting,
    column_count, invalid_<column>. An empty field is null; it isn't converted."""

    def parse(text: str | None) -> tuple[str | None, dict | None]:
        if text is None:
            return "null_record", None
        try:
            rows = list(csv.reader([text], delimiter=delimiter, strict=True))
        except csv.Error:
            return "bad_quoting", None
        if len(rows) != 1 or len(rows[0]) != len(names):
            return "column_count", None
        out: dict[str, Any] = {}
        for name, field in zip(names, rows[0]):
            try:
                out[name] = None if field == "" else convert.get(name, str)(field)
            except (ValueError, ArithmeticError):
                return f"invalid_{name}", None
        return None, out

    return parse


#: Lines of one file that one task looks through, and lines of a record at most.
CHUNK, MOST_LINES = 50_000, 10_000


def _carried(lines: DataFrame, name: str, value: Column, how: Callable[[Any], Column], inclusive: bool) -> DataFrame:
    """lines with name: how (sum or max) over value of the lines before in the file, with inclusive of the line itself too.
    Each chunk is looked through by itself; what the chunks before it make is one row a chunk."""
    inside = Window.partitionBy("source", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = lines.withColumn("__v", value)
    chunks = rows.groupBy("source", "chunk").agg(how("__v").alias("__c"))
    before = chunks.select("source", "chunk", how("__c").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    both = rows.withColumn("__w", how("__v").over(inside)).join(before, ["source", "chunk"])
    whole = F.coalesce("__w", F.lit(0)) + F.coalesce("__b", F.lit(0)) if how is F.sum else F.greatest("__w", "__b")
    return both.withColumn(name, whole).drop("__v", "__w", "__b")


def assemble_records(lines: DataFrame, source: str, line: str, text: str, begins: str | None = None) -> DataFrame:
    """source, first_line, lines, record: the records of delimited files, put together from their lines by quotes.

    line numbers the lines of a source in order (gaps do no harm). begins: a pattern of lines that begin a record
    whatever quote is open before them."""
    given = lines.select(F.col(source).alias("source"), F.col(line).cast("long").alias("line"), F.col(text).alias("text")).where("source is not null and line is not null")
    given = given.withColumn("chunk", F.expr(f"line div {CHUNK}"))
    quotes = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")))
    run = _carried(given, "run", quotes.cast("long"), F.sum, inclusive=False)
    sure = F.coalesce(F.rlike("text", F.lit(begins)), F.lit(False)) if begins else F.lit(False)
    based = _carried(run, "base", F.when(sure, F.col("run")), F.max, inclusive=True)
    closed = (F.col("run") - F.coalesce("base", F.lit(0))) % 2 == 0
    placed = _carried(based, "first_line", F.when(closed | sure | F.col("text").isNull(), F.col("line")), F.max, inclusive=True)
    # in windows, not by line numbers, since those may have gaps
    nth = F.row_number().over(Window.partitionBy("source", "first_line", "chunk").orderBy("line")) - 1
    pieces = placed.withColumn("piece", F.col("chunk") * 1_000_000 + F.floor(nth / MOST_LINES)).groupBy("source", "first_line", "piece").agg(
        F.count(F.lit(1)).cast("int").alias("lines"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"), F.min("line").alias("at")
    )
    return _joined(pieces)


def _joined(pieces: DataFrame) -> DataFrame:
    """The pieces of a record that a chunk's border or MOST_LINES cut, put together again as long as they are few lines."""
    text = F.when((F.size("l") == 1) & F.col("l")[0]["text"].isNull(), F.lit(None)).otherwise(F.array_join(F.transform("l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"))
    size = F.sum("lines").over(Window.partitionBy("source", "first_line"))
    cut = pieces.withColumn("size", size).withColumn("alone", F.when(F.col("size") > MOST_LINES, F.col("piece")).otherwise(F.lit(-1)))
    whole = cut.groupBy("source", "first_line", "alone").agg(F.sum("lines").cast("int").alias("lines"), F.flatten(F.sort_array(F.collect_list("l"))).alias("l"), F.min("at").alias("at"))
    return whole.select("source", F.col("at").alias("first_line"), "lines", text.alias("record"))


def read_delimited(lines: DataFrame, line: str, keep: Sequence[str], record: T.StructType, convert: dict[str, Callable[[str], Any]], delimiter: str = ",") -> DataFrame:
    """`parse_or_reject` for records of delimited text, one to a row of lines (see `assemble_records`)."""
    return parse_or_reject(lines, keep, [line], delimited_parser(record.names, convert, delimiter), record)
