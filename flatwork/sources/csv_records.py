"""The records of CSV files, found in parallel although quoted cells may hold line breaks.

Spark's text reader deals physical lines out in byte ranges. Whether a range begins inside a quoted cell is
not known there, so its lines are followed under both assumptions at once, and every range gives one small
row: how the quotes stand at its end for either beginning. A scan over these rows decides how each range
began. A range is cut into records as if it began outside of quotes; the few that did not are cut again, and
records that run over range ends are put together from their pieces.

The pieces are stored, because the byte ranges of a later scan may differ. A quote opens a quoted cell only
where the cell begins, a doubled one inside stands for itself, and text after the closing quote belongs to
the cell. Records without any character but blanks are skipped. A quote that is never closed takes the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flatwork.sources.checkpoints import cut_lineage

INSIDE = rb'(?:[^"]|"")*+'
PIECE = "file string, block long, place long, rank long, kind string, text binary, shut boolean, open boolean, closes boolean"


def open_tests(separator: str = ",") -> tuple[re.Pattern, re.Pattern]:
    """Patterns that a whole line matches when a quoted cell is open at its end: for a line that begins outside of
    quotes, and for one that begins inside."""
    s = re.escape(separator.encode())
    cell = rb'(?:"' + INSIDE + rb'"[^' + s + rb']*+|[^"' + s + rb"][^" + s + rb"]*+)?+"
    begun = rb"(?:" + cell + s + rb')*+"' + INSIDE
    return re.compile(begun, re.S), re.compile(INSIDE + rb'(?:"[^' + s + rb"]*+" + s + begun + rb")?", re.S)


def cut_lines(lines: Iterator[bytes], inside: bool, tests: tuple[re.Pattern, re.Pattern]) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the lines up to each record end, and whether the record ends there. Lines that begin inside a
    quoted cell start with the rest of an earlier record."""
    held, state = [], inside
    for line in lines:
        held.append(line)
        if b'"' in line:
            state = tests[state].fullmatch(line) is not None
        if not state:
            yield b"\n".join(held), True
            held = []
    if held:
        yield b"\n".join(held), False


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator]]:
    """Consecutive rows with the same first columns, as (key, rows without it); the rows are to be used up in turn."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(rows, None)

    def run(key):
        nonlocal ahead
        while ahead is not None and ahead[:keys] == key:
            yield ahead[keys:]
            ahead = next(rows, None)

    while ahead is not None:
        key = ahead[:keys]
        yield key, run(key)


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `limit` bytes of text, whose column is the sixth."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"") + 64
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PIECES = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("rank", pa.int64()), ("kind", pa.string()), ("text", pa.binary())]
    + [(n, pa.bool_()) for n in ("shut", "open", "closes")]
)


def _first_cut(separator: str):
    """Each range cut as if it began outside of quotes, and a row about its end under both assumptions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = open_tests(separator)

        def rows():
            for (file, block), lines in _runs(batches, 2):
                other, closes, ended, rank = True, False, True, 0

                def watched():
                    nonlocal other, closes
                    for (line,) in lines:
                        if b'"' in line:
                            other = tests[other].fullmatch(line) is not None
                            closes |= not other
                        yield line

                for place, (text, ended) in enumerate(cut_lines(watched(), False, tests)):
                    yield file, block, place, rank, "record" if ended else "tail", text, None, None, None
                    rank += bool(text.strip())
                yield file, block, None, None, "range", None, not ended, other, closes

        yield from _batches(rows(), _PIECES)

    return run


def _second_cut(separator: str):
    """Ranges that began inside a quoted cell: their pieces joined in order and cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = open_tests(separator)

        def rows():
            for (file, block, opened), pieces in _runs(batches, 3):
                lines = (line for _, text in pieces for line in text.split(b"\n"))
                for place, (text, ended) in enumerate(cut_lines(lines, True, tests)):
                    kind = "head" if place == 0 else "record" if ended else "tail"
                    yield file, block, opened if kind == "head" else block, place, kind, text

        schema = pa.schema([(n, pa.int64() if n in ("block", "opened", "rank") else pa.string()) for n in ("file", "block", "opened", "rank", "kind")] + [("text", pa.binary())])
        yield from _batches(rows(), schema)

    return run


def _ranges(pieces: DataFrame) -> DataFrame:
    """For each range: whether it began inside a quoted cell, and the range in which that cell was opened.

    A range keeps the state, sets it, or turns it round. The state before a range is the one last set, turned
    as often as ranges turned it since.
    """
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    turned = F.sum(F.expr("CAST(shut AND NOT open AS INT)"))
    scan = pieces.where("kind = 'range'").select("file", "block", "shut", "open", "closes").withColumn("turns", turned.over(upto))
    odd = lambda c: F.coalesce(c, F.lit(0)) % 2 == 1
    given = F.when(F.col("shut") == F.col("open"), F.col("shut") != odd(F.col("turns")))
    last = F.coalesce(F.last(given, ignorenulls=True).over(before), F.lit(False))
    scan = scan.withColumn("inside", last != odd(turned.over(before)))
    opens = F.when(F.col("inside"), F.col("open") & F.col("closes")).otherwise(F.col("shut"))
    return scan.withColumn("opened", F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)).select("file", "block", "inside", "opened")


def csv_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The records of the files at a path but for each file's first, the header: one column `record`."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    pieces = cut_lineage(lines.mapInArrow(_first_cut(separator), PIECE))
    # One row for each byte range that began inside a quoted cell.
    inside = cut_lineage(_ranges(pieces)).where("inside").select("file", "block", "opened")
    texts = pieces.where("kind <> 'range'")
    first = texts.join(F.broadcast(inside.select("file", "block")), ["file", "block"], "left_anti")
    again = texts.join(F.broadcast(inside), ["file", "block"]).select("file", "block", "opened", "place", "text")
    again = again.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    again = again.mapInArrow(_second_cut(separator), "file string, block long, opened long, rank long, kind string, text binary")
    cut = first.select("file", "block", F.col("block").alias("opened"), "rank", "kind", "text").unionByName(again)
    parts = cut.where("kind <> 'record'").groupBy("file", "opened").agg(
        F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max(F.when(F.col("kind") == "tail", F.col("rank"))).alias("rank")
    )
    joined = F.concat_ws("\n", F.transform("parts", lambda p: p["text"].cast("string")))
    whole = cut.where("kind = 'record'").select(F.col("block").alias("opened"), "rank", F.col("text").cast("string").alias("record"))
    records = whole.unionByName(parts.select("opened", "rank", joined.alias("record")))
    return records.where("NOT (opened = 0 AND rank = 0) AND NOT record RLIKE '^\\\\s*$'").select(F.regexp_replace("record", r"\r$", "").alias("record"))
