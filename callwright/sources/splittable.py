"""Records of large files that hold one JSON array or quoted CSV, read by many tasks.

Spark's text source splits a file at a separator: ``}`` for JSON (every array element is an object and
ends with one), a line end for CSV.  Whether a separator stands inside a string, and how deep, depends
on all text before it, so the state at the start of each split comes from a parallel prefix:

1. ``_summaries``: each split, read from either string state, gives the state it ends in and how many levels
   it opens; one row for each split;
2. ``_states``: running sums over the splits of a file turn these into the state at each split's start;
3. ``_records``: each split, now with its state, cuts its text into records.  A record that crosses
   splits comes in pieces, at most two for each split; only these are shuffled and put together.

No file is read whole by one task and no text but the crossing pieces is shuffled.  Files are scanned
once for the states and once for each of the two uses of the records (whole ones and pieces).
Memory of a task is one batch and the longest record.  The states are sent to all tasks: one row for each split of
the input.
"""
from __future__ import annotations

import csv
import functools
import io
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL, CLOSING = 0, 1, 2, 3

_SUMMARY_DDL = "path string, start bigint, f0 int, f1 int, d0 bigint, d1 bigint, header string"
_SUMMARY = pa.schema([("path", pa.string()), ("start", pa.int64()), ("f0", pa.int32()), ("f1", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("header", pa.string())])
_RECORD_DDL = "path string, start bigint, part int, pos bigint, opens boolean, text string, cells array<string>"
_RECORD = pa.schema([("path", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("opens", pa.bool_()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])


def _runs(batch: pa.RecordBatch):
    """(first row, last row + 1) of each run of rows of one split."""
    path = batch.column("path").dictionary_encode().indices.to_numpy()
    start = batch.column("start").to_numpy()
    turns = np.flatnonzero((np.diff(path) != 0) | (np.diff(start) != 0)) + 1
    edges = [0, *turns.tolist(), batch.num_rows]
    return zip(edges[:-1], edges[1:])


def _by_split(batches, make):
    """Feeds the rows to one reader for each split; ``make(first row as a dict)`` gives it."""
    key, reader = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        for a, b in _runs(batch):
            first = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "value"}
            if (first["path"], first["start"]) != key:
                if reader:
                    yield from reader.end()
                key, reader = (first["path"], first["start"]), make(first)
            yield from reader.feed(batch.column("value").slice(a, b - a))
    if reader:
        yield from reader.end()


def _table(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# ---------------------------------------------------------------- JSON

_QUOTE, _BACKSLASH = 34, 92


def _outside(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(bytes, whether each lies outside of strings, whether it lies inside, whether the text ends inside); the
    text starts ``inside`` or not.  Quotes themselves are neither."""
    b = np.frombuffer(text, np.uint8)
    quote = b == _QUOTE
    if _BACKSLASH in text:
        at = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(b != _BACKSLASH, at, -1))
        run = at - 1 - np.r_[-1, plain[:-1]]  # backslashes right before each byte
        quote &= run % 2 == 0
    parity = np.cumsum(quote) + inside
    outside = parity % 2 == 0
    return b, outside & ~quote, ~outside & ~quote, not outside[-1] if len(b) else inside


def _levels(b: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Change of depth at each byte."""
    opens, closes = (b == 123) | (b == 91), (b == 125) | (b == 93)
    return (opens & outside).astype(np.int64) - (closes & outside)


class _JsonSummary:
    def __init__(self, row):
        self.key = row["path"], row["start"]
        self.odd, self.depth, self.first = False, [0, 0], ""

    def feed(self, values):
        if self.key[1] == 0 and not self.first:
            self.first = next((v.as_py().strip()[:1] for v in values if v.as_py().strip()), "")
        text = b"".join([v + b"}" for v in values.cast(pa.binary()).to_pylist()])
        b, outside, within, odd = _outside(text, False)
        # of the two readers, the one that is outside of strings now began inside one if the quotes so far are odd
        self.depth[self.odd] += int(_levels(b, outside).sum())
        self.depth[not self.odd] += int(_levels(b, within).sum())
        self.odd ^= bool(odd)
        return iter(())

    def end(self):
        yield from _table([(*self.key, int(self.odd), int(not self.odd), *self.depth, self.first or None)], _SUMMARY)


class _JsonRecords:
    def __init__(self, row):
        self.row, self.inside, self.depth = row, bool(row["inside"]), row["depth"]
        self.held, self.pending, self.at, self.seen = None, b"", row["start"] + (row["start"] > 0), row["start"] == 0
        self.first = row["start"] == 0
        self.read = 0
        self.base = 0 if row["header"] == "{" else 1  # depth behind a record: a file of one object is one record

    def feed(self, values):
        texts = values.cast(pa.binary()).to_pylist()
        self.read += sum(map(len, texts)) + len(texts)
        if self.held is not None:
            texts.insert(0, self.held)
        self.held = texts.pop()  # whether a separator stands behind the file's last text is known at the end only
        yield from self._cut(b"".join([t + b"}" for t in texts]))

    def _cut(self, text: bytes):
        b, outside, _, inside = _outside(text, self.inside)
        depth = self.depth + np.cumsum(_levels(b, outside))
        ends = np.flatnonzero((b == 125) & outside & (depth == self.base)) + 1
        if len(b):
            self.inside, self.depth = bool(inside), int(depth[-1])
        rows, last = [], 0
        for e in ends.tolist():
            record = self.pending + text[last:e]
            rows.append((self.row["path"], self.row["start"], WHOLE if self.seen else HEAD, self.at, self.first, record.decode(), None))
            self.at += len(record)
            self.pending, last, self.seen, self.first = b"", e, True, False
        self.pending += text[last:]
        yield from _table(rows, _RECORD)

    def end(self):
        ended = self.row["start"] == 0 and self.read == self.row["size"]  # a file read from its start shows its last sign
        if not self.row["final"] or ended:
            yield from self._cut(self.held + b"}")
            rest = self.pending
        else:
            yield from self._cut(b"")
            rest = self.pending + self.held
        if rest or self.row["final"]:
            part = CLOSING if self.row["final"] else TAIL
            yield from _table([(self.row["path"], self.row["start"], part, self.at, self.first, rest.decode(), None)], _RECORD)


# ---------------------------------------------------------------- CSV

_CLOSE = re.compile('(?:[^"]++|"")*+"')


def _leaves_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell.  A quote opens a cell only as its first sign."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(',"') + 2
            if at == 1:
                return False
    while True:
        close = _CLOSE.match(line, at)
        if close is None:
            return True
        at = line.find(',"', close.end()) + 2
        if at == 1:
            return False


def _parse(text: str) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    try:
        return list(csv.reader(io.StringIO(text, newline="")))
    except csv.Error:  # a bare carriage return in a cell without quotes
        return list(csv.reader(io.StringIO(re.sub("\r(?!\n)", " ", text), newline="")))


class _CsvSummary:
    def __init__(self, row):
        self.key, self.ends, self.header = (row["path"], row["start"]), [False, True], None

    def feed(self, values):
        if self.header is None:
            self.header = values[0].as_py() if self.key[1] == 0 else ""
        for line in values.to_pylist():
            if '"' in line:
                self.ends = [_leaves_inside(line, s) for s in self.ends]
        return iter(())

    def end(self):
        header = self.header.lstrip("﻿") if self.key[1] == 0 else None
        yield from _table([(*self.key, *map(int, self.ends), 0, 0, header)], _SUMMARY)


class _CsvRecords:
    def __init__(self, row):
        self.row, self.inside = row, bool(row["inside"])
        self.pending, self.at, self.seen = [], row["start"] + (row["start"] > 0), row["start"] == 0
        self.first = row["start"] == 0

    def feed(self, values):
        done, places = [], []
        for line in values.to_pylist():
            self.pending.append(line)
            if '"' in line:
                self.inside = _leaves_inside(line, self.inside)
            if not self.inside:
                record = "\n".join(self.pending)
                self.pending = []
                if not self.seen:
                    yield from _table([self._row(HEAD, record, None)], _RECORD)
                elif self.first:
                    self.first = False  # the header line
                else:
                    done.append(record)
                    places.append(self.at)
                self.seen = True
                self.at += len(record.encode()) + 1
        cells = _parse("\n".join(done) + "\n") if done else []
        if len(cells) != len(done):
            cells = [(_parse(r) or [[]])[0] for r in done]
        path, start = self.row["path"], self.row["start"]
        yield from _table([(path, start, WHOLE, p, False, None, c) for p, c in zip(places, cells) if c], _RECORD)

    def _row(self, part, text, cells):
        return self.row["path"], self.row["start"], part, self.at, self.first, text, cells

    def end(self):
        if self.pending:
            # lines keep their end when more of the record follows; a file that ends inside a cell ends there
            yield from _table([self._row(CLOSING if self.row["final"] else TAIL, "\n".join(self.pending) + ("" if self.row["final"] else "\n"), None)], _RECORD)


# ---------------------------------------------------------------- both


def _states(summaries: DataFrame) -> DataFrame:
    """path, start, inside, depth, final, header: the state at each split's start.

    A split turns (outside, inside) into (f0, f1): it keeps the state, swaps it, or ends in one state whatever
    it began with.  The state is that of the last such split, swapped as often as splits since then swap.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swaps = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")
    s = summaries.withColumns({"upto": F.sum(swaps).over(upto), "swapped": F.coalesce(F.sum(swaps).over(before), F.lit(0))})
    s = s.withColumn("fixed", F.when(F.col("f0") == F.col("f1"), (F.col("f0") + F.col("upto")) % 2))
    s = s.withColumn("inside", ((F.coalesce(F.last("fixed", True).over(before), F.lit(0)) + F.col("swapped")) % 2).cast("int"))
    s = s.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(before), F.lit(0)))
    final = F.lead("start").over(order).isNull()
    return s.select("path", "start", "inside", "depth", final.alias("final"), F.max("header").over(Window.partitionBy("path")).alias("header"))


def _scan(df: DataFrame, reader, ddl: str) -> DataFrame:
    return df.mapInArrow(functools.partial(_by_split, make=reader), ddl)


def _read(spark: SparkSession, root, separator: str, name_glob: str, recursive: bool, summary, records, tell=()) -> tuple[DataFrame, DataFrame]:
    """(records, states); records: path, pos, opens, text or cells, closing.  ``tell``: further columns of the states
    that the records are cut by."""
    source = spark.read.option("lineSep", separator).option("recursiveFileLookup", recursive).option("pathGlobFilter", name_glob).text(root)
    texts = source.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
    states = _states(_scan(texts, summary, _SUMMARY_DDL))
    cut = _scan(texts.join(F.broadcast(states.select("path", "start", "inside", "depth", "final", *tell)), ["path", "start"]), records, _RECORD_DDL)
    # pieces of records that cross splits: a head ends the record that the tails before it began
    pieces = cut.where(F.col("part") != WHOLE)
    begun = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("record", F.coalesce(F.sum((F.col("part") == HEAD).cast("int")).over(begun), F.lit(0)))
    ordered = F.sort_array(F.collect_list(F.struct("start", "part", "text", "pos")))
    joined = numbered.groupBy("path", "record").agg(ordered.alias("p"), F.max("opens").alias("opens"), F.max((F.col("part") == CLOSING)).alias("closing"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    crossing = joined.select("path", F.get("p", F.lit(0))["pos"].alias("pos"), "opens", "closing", text.alias("text"), F.lit(None).cast("array<string>").alias("cells"))
    whole = cut.where(F.col("part") == WHOLE).select("path", "pos", "opens", F.lit(False).alias("closing"), "text", "cells")
    return whole.unionByName(crossing), states


def _file(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def json_elements(spark: SparkSession, root, name_glob: str = "*.json", recursive: bool = True, objects: bool = False) -> DataFrame:
    """(src_file, src_pos, element, error) of files that hold one JSON array of objects each; with ``objects`` also of
    files that hold one object.

    ``element`` is the text of one object; ``error`` says where a file is nothing of the kind: text between elements,
    another top level, a missing end.  ``src_pos`` grows in file order.
    """
    records, states = _read(spark, root, "}", name_glob, recursive, _JsonSummary, _JsonRecords, ("header",))
    blank = "[ \\t\\r\\n]*"
    behind = lambda sign: F.regexp_extract("text", f"^{blank}{sign}{blank}(?s:(\\{{.*))$", 1)
    body = F.when(F.col("opens"), behind("\\[")).otherwise(behind(","))
    # what stands behind the last element: the closing bracket, or the whole of an empty array
    closes = F.col("text").rlike(f"^{blank}\\]{blank}$") & ~F.col("opens") | F.col("text").rlike(f"^{blank}\\[{blank}\\]{blank}$") & F.col("opens")
    if objects:
        alone = F.col("header") == "{"
        records = records.join(F.broadcast(states.where("start = 0").select("path", "header")), "path", "left").withColumn("header", F.coalesce("header", F.lit("")))
        body = F.when(alone & F.col("opens"), behind("")).when(~alone, body).otherwise("")
        closes = F.when(alone, F.col("text").rlike(f"^{blank}$") & ~F.col("opens")).otherwise(closes)
    rows = records.where(~(F.col("closing") & closes)).withColumn("element", F.when(~F.col("closing") & (body != ""), body))
    error = F.when(F.col("element").isNull(), F.lit("not a JSON array of objects"))
    return rows.select(_file(F.col("path")).alias("src_file"), F.col("pos").alias("src_pos"), "element", error.alias("error"))


def csv_records(spark: SparkSession, root, name_glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """(src_file, src_pos, header, cells) of CSV files, each with its own header line.

    Cells are read as Python's ``csv`` reads them: a quote opens a cell only as its first sign and doubles inside.
    Empty lines and lines with more cells than the header go; missing cells are absent.  Names must stand on
    one line; a byte-order mark is dropped; bytes that are not UTF-8 become the replacement character.
    """
    records, states = _read(spark, root, "\n", name_glob, recursive, _CsvSummary, _CsvRecords)

    def parse(batches):
        for batch in batches:
            cells = [c if c is not None else (_parse(t) or [[]])[0] for c, t in zip(batch.column("cells").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("pos"), pa.array(cells, pa.list_(pa.string()))], names=["path", "pos", "cells"])

    whole = records.where("cells is not null").select("path", "pos", "cells")
    crossing = records.where("cells is null and not (opens and pos = 0)").select("path", "pos", "cells", "text").mapInArrow(parse, "path string, pos bigint, cells array<string>")
    return whole.unionByName(crossing).join(F.broadcast(_headers(states)), "path").where("size(cells) > 0 and size(cells) <= size(header)").select(_file(F.col("path")).alias("src_file"), F.col("pos").alias("src_pos"), "header", "cells")


def _headers(states: DataFrame) -> DataFrame:
    """path, header: the names of each file's first line."""

    def parse(batches):
        for batch in batches:
            names = [(_parse(h) or [[]])[0] for h in batch.column("header").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.list_(pa.string()))], names=["path", "header"])

    return states.where("start = 0").select("path", "header").mapInArrow(parse, "path string, header array<string>")
