"""Operator 9: SimHash near-duplicates by exact tiled comparison.

A fingerprint has 64 bits: bit b is set where over half of the document's shingle hashes have it. Equal
fingerprints meet in an aggregate; distinct ones are dealt into tiles by the population counts of their
four 16-bit quarters. Two fingerprints at most `radius` bits apart have counts at most `radius` apart in
sum, so all other tile pairs are skipped. The rest is compared by numpy exclusive-or and bit counts, and a
tile pair returns a spanning forest of its links, never the links themselves. Components come from stars.

The class table has at most 17**4 rows, so it may be broadcast; classes of more than TILE fingerprints are
split into tiles. The comparison is exact and thus still quadratic in the distinct fingerprints of a class
and its neighbours; moved bytes shrink with TILE.

Documents without words have the fingerprint zero, linked like any other; null and empty texts are such.
Repeated rows share a fingerprint and a component. A component of rows without doc_id has a null id. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import stored, text_bytes
from flatwork.llm.components import components, merge_labels

SEED = 42
TILE = 4096
ROWS_AT_ONCE = 128
SHINGLES_AT_ONCE = 1 << 16


def text_fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text: ASCII letters lower-cased, words split at ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = iter([b" ".join(parts)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(parts, k, None) for k in range(words))))
        n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for _ in range(0, n, SHINGLES_AT_ONCE):
        hashes = np.array([digest(s, SEED) for s in itertools.islice(shingles, SHINGLES_AT_ONCE)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text column as a long (its bits, two's complement)."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t, words) for t in text_bytes(texts)], pa.int64())

    return run(text.cast("binary"))


def _quarters(fp: Column) -> Column:
    """The four population counts, packed in base 32."""
    parts = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("long") for i in range(4)]
    return sum((p * 32**i for i, p in enumerate(parts[1:], 1)), parts[0])


def _steps(radius: int) -> list[int]:
    """Differences of packed counts that a link can have, each pair of classes once."""
    vectors = [v for v in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, v)) <= radius]
    return sorted(s for v in vectors if (s := sum(x * 32**i for i, x in enumerate(v))) >= 0)


def _compare(radius: int):
    def links(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        labels = np.arange(len(a) + (0 if same else len(b)))
        shift = 0 if same else len(a)
        for at in range(0, len(a), ROWS_AT_ONCE):
            i, j = np.nonzero(np.bitwise_count(a[at : at + ROWS_AT_ONCE, None] ^ b[None, :]) <= radius)
            labels = merge_labels(labels, i + at, j + shift)
        found = np.flatnonzero(labels != np.arange(len(labels)))
        every = a if same else np.concatenate([a, b])
        return every[found], every[labels[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                # numpy counts the bits of a signed number's absolute value, so the bits are taken as unsigned.
                a, b = (batch.column(c)[row].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                x, y = links(a, b, batch.column(2)[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def links(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column fp), tile pair by tile pair."""
    if not 0 <= radius <= 7:
        raise ValueError("The radius lies between 0 and 7.")
    keyed = fingerprints.select("fp", _quarters(F.col("fp")).alias("k"))
    classes = keyed.groupBy("k").agg(F.ceil(F.count("*") / TILE).alias("tiles"))  # 17**4 rows at most
    tiles = (
        keyed.join(F.broadcast(classes), "k")
        .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")))
        .groupBy("k", "t")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = stored(tiles)
    others = classes.select(F.col("k").alias("k2"), F.col("tiles").alias("tiles2"))
    pairs = (
        tiles.select("k", "t", "fps", F.explode(F.array(*[F.lit(s).cast("long") for s in _steps(radius)])).alias("step"))
        .withColumn("k2", F.col("k") + F.col("step"))
        .join(F.broadcast(others), "k2")
        .withColumn("t2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles2") - 1)))
        .where((F.col("k2") > F.col("k")) | (F.col("t2") >= F.col("t")))
        .select("k2", "t2", F.col("fps").alias("a"), ((F.col("k2") == F.col("k")) & (F.col("t2") == F.col("t"))).alias("same"))
    )
    met = pairs.join(tiles.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("fps").alias("b")), ["k2", "t2"])
    return met.select("a", "b", "same").mapInArrow(_compare(radius), "a long, b long")


def _named(rows: DataFrame, first: Column, radius: int) -> DataFrame:
    """fp and first (its minimum in the whole component) of every fingerprint of the rows."""
    distinct = stored(rows.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) and component_id (smallest doc_id reachable by links) of every row."""
    rows = stored(docs.select(col(doc_id).alias("doc_id"), fingerprint(col(text), words).alias("fp")))
    named = _named(rows, F.col("doc_id"), radius)
    return rows.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with the columns of the input: the smallest doc_id, null last, and of rows
    that share it the first by a number that is written with the row."""
    given = F.struct(*[col(c) for c in docs.columns]).alias("row")
    rows = stored(docs.select(given, col(doc_id).alias("doc_id"), fingerprint(col(text), words).alias("fp")).withColumn("number", F.monotonically_increasing_id()), "zstd")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    kept = _named(rows, least, radius).select("first.number").distinct()
    return rows.select("number", "row").join(kept, "number", "left_semi").select("row.*")
