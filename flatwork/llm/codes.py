"""Operator 13: vector codes by product quantisation, with memoised grid cells.

Vectors are cut into consecutive parts, and each part takes the number of the nearest entry of its position's
codebook. All arithmetic is exact: components are whole numbers floor(scale * x), squared distances stay whole,
and ties go to the lower entry.

Which entry is nearest is found by cells: a part vector is hashed by its cell of a coarse grid, and a cell
remembers the entries that no other entry dominates across its box (an entry is dominated when its least
distance to the box is above another one's greatest distance). Only these are then evaluated exactly. The
memory belongs to a task and a round, and starts again when it is full; it changes the time, never the result.

A round of fitting is one pass: tasks assign their rows and give one sum for each entry and component; Spark
adds them, and the driver gets the new codebooks, whose size depends on the length of the vectors alone.

Rows whose vector is null or holds a null or non-finite component are dropped. Zero vectors and repeated rows
or ids count like any others; ids order null last, equal ids by vector. The vector with the smallest id sets the
length; vectors of another length stay, with null code and error, and enter no codebook. Where the length is no
multiple of the number of parts, the first parts are one component longer. With fewer vectors than entries the
codebooks are shorter. An error above the range of long is null;
the sum of an entry's components may have 38 digits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt
from statistics import median_low

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import look_up, stored
from flatwork.llm.vectors import finite, matrices

#: Cells that a task remembers for a part.
MEMORY = 1 << 14
#: Components times entries that a task works on at a time.
BLOCK = 1 << 19

#: parts of entries of components
Books = list[list[list[int]]]


def whole(x: np.ndarray, scale: int, room: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers where all lie below `room`, else as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < room:
        return y.astype(np.int64)
    ratios = [[v.as_integer_ratio() for v in row] for row in x.tolist()]
    return np.array([[n * scale // d for n, d in row] for row in ratios], object)


def bounds(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and where the last one ends."""
    return np.cumsum([0] + [len(p) for p in np.array_split(np.arange(length), parts)]).tolist()


class Nearest:
    """The nearest entry of one codebook, by way of remembered grid cells.

    Vectors and entries are 64-bit integers, or all Python integers where `exact`.
    """

    def __init__(self, book: list[list[int]], exact: bool):
        self.kind = object if exact else np.int64
        self.book = np.array(book, self.kind).reshape(len(book), len(book[0]))
        self.width = grid_width(book)
        self.mix = np.random.default_rng(1).integers(1 << 62, size=len(book[0]), dtype=np.int64) * 2 + 1
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.int64)
        self.cells = np.zeros((0, self.book.shape[1]), self.kind)
        self.masks = np.zeros((0, len(self.book)), bool)

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances for part vectors (a row each)."""
        v = v.astype(self.kind, copy=False)
        allowed = self.allowed(v // self.width)
        rows, entries = np.nonzero(allowed)
        apart = v[rows] - self.book[entries]
        key = (apart * apart).sum(axis=1) * len(self.book) + entries
        counts = allowed.sum(axis=1)
        best = np.minimum.reduceat(key, np.cumsum(counts) - counts)
        return (best % len(self.book)).astype(np.int64), best // len(self.book)

    def allowed(self, cells: np.ndarray) -> np.ndarray:
        """For the cell of each vector, the entries that are not dominated across its box. Where two cells share
        a hash, all entries of the later one are evaluated."""
        if self.kind is object:
            hashes = np.array([hash(tuple(c)) for c in cells.tolist()], np.int64)
        else:
            hashes = (cells * self.mix).sum(axis=1)
        fresh, first = np.unique(hashes, return_index=True)
        if len(self.hashes):
            new = self.hashes[np.searchsorted(self.hashes, fresh).clip(max=len(self.hashes) - 1)] != fresh
            fresh, first = fresh[new], first[new]
        if len(fresh):
            if len(self.hashes) + len(fresh) > MEMORY:
                self.forget()
                fresh, first = np.unique(hashes, return_index=True)
            corners = cells[first]
            order = np.argsort(np.concatenate([self.hashes, fresh]))
            self.hashes = np.concatenate([self.hashes, fresh])[order]
            self.cells = np.concatenate([self.cells, corners])[order]
            self.masks = np.concatenate([self.masks, undominated(corners * self.width, self.width, self.book)])[order]
        slot = np.searchsorted(self.hashes, hashes)
        return self.masks[slot] | (self.cells[slot] != cells).any(axis=1)[:, None]


def room(book: list[list[int]]) -> int:
    """Below this bound 64 bits hold distances times the number of entries; 0 where the entries are above."""
    bound = 1 << max(0, (58 - (len(book[0]) * len(book)).bit_length()) // 2)
    return bound if max((abs(c) for entry in book for c in entry), default=0) < bound else 0


def undominated(low: np.ndarray, width: int, book: np.ndarray) -> np.ndarray:
    """For boxes of whole numbers from `low`, `width` a side: the entries whose least distance to the box is
    not above the smallest of all greatest distances."""
    under = low[:, None, :] - book[None]
    over = -under - (width - 1)
    outside = np.maximum(np.maximum(under, over), 0)
    farthest = np.maximum(np.abs(under), np.abs(over))
    return (outside * outside).sum(axis=2) <= (farthest * farthest).sum(axis=2).min(axis=1)[:, None]


def grid_width(book: list[list[int]]) -> int:
    """Side of a cell: its diagonal is about half the usual distance between neighbouring entries."""
    length = len(book[0])
    apart = [min((d for other in book if (d := sum((a - b) ** 2 for a, b in zip(entry, other)))), default=0) for entry in book]
    return max(1, isqrt(median_low(apart) // max(1, 4 * length)))


def _blocks(batches: Iterator[pa.RecordBatch], at: int, books: Books, scale: int):
    """Row numbers of a batch, the parts' entries and the parts' distances, with the parts themselves."""
    edges = [0]
    for book in books:
        edges.append(edges[-1] + len(book[0]))
    bound = min(room(book) for book in books)
    near = [[Nearest(book, exact) for book in books] for exact in (False, True)] if bound else [[], [Nearest(book, True) for book in books]]
    step = max(1, BLOCK // max(1, edges[-1] * len(books[0])))
    for batch in batches:
        for rows, x in matrices(batch.column(at)):
            if x.shape[1] != edges[-1]:
                yield batch, rows, None, None, None
                continue
            small = np.abs(x).max(axis=1, initial=0) < (bound - 1) / scale
            for exact, group in enumerate((np.flatnonzero(small), np.flatnonzero(~small))):
                for s in range(0, len(group), step):
                    some = group[s : s + step]
                    y = whole(x[some], scale, bound)
                    parts = [y[:, a:b] for a, b in zip(edges, edges[1:])]
                    found = [n(p) for n, p in zip(near[exact], parts)]
                    yield batch, rows[some], parts, [f[0] for f in found], [f[1] for f in found]


def _sums(books: Books, scale: int):
    """For each entry of each part: how many vectors of the task are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = [np.zeros((len(b), len(b[0])), object) for b in books]
        for _, _, parts, codes, _ in _blocks(batches, 0, books, scale):
            for p, (v, code) in enumerate(zip(parts or [], codes or [])):
                order = np.argsort(code, kind="stable")
                present, first, n = np.unique(code[order], return_index=True, return_counts=True)
                counts[p][present] += n
                sums[p][present] += np.add.reduceat(v[order], first, axis=0).astype(object)
        rows = [
            (p, int(e), at, int(counts[p][e]), Decimal(int(total)))
            for p in range(len(books))
            for e in np.flatnonzero(counts[p])
            for at, total in enumerate(sums[p][e])
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "at", "n", "total"])

    return run


def fit(df: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Books:
    """The codebooks: they start as the vectors of the smallest ids, and every round replaces each entry by the
    floor of the mean of the parts that are nearest to it. An entry that none is nearest to stays."""
    kept = df.select(col(vec_id).alias("vec_id"), col(embedding).alias("e")).where(finite(F.col("e")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(1).collect()
    if not first:
        return []
    length = len(first[0]["e"])
    alike = kept.where(F.size("e") == length)
    start = [r["e"] for r in alike.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).collect()]
    x = whole(np.array(start, np.float64).reshape(len(start), length), scale, 1 << 62)
    edges = bounds(length, parts)
    books: Books = [[[int(c) for c in row[a:b]] for row in x] for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        made = alike.select("e").mapInArrow(_sums(books, scale), "part int, entry int, at int, n long, total decimal(38,0)")
        made = made.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in made.collect():
            books[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
    return books


def _code(books: Books, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, _, codes, errors in _blocks(batches, 2, books, scale):
            if codes is None:
                code = error = [None] * len(rows)
            else:
                code = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8).tolist()]
                error = [e if e < 1 << 63 else None for e in map(int, sum(e.astype(object) for e in errors))]
            taken = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def encode(
    df: DataFrame, books: Books, embedding: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: int = 4096
) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error (squared distance) of the kept rows."""
    kept = df.select(col(vec_id).alias("vec_id"), col(label).alias("label"), col(embedding).alias("e")).where(finite(F.col("e")))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:2]]
    if not books:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return kept.mapInArrow(_code(books, scale), ", ".join([*kinds, "code string", "error long"]))


def decode(coded: DataFrame, books: Books, scale: int = 4096) -> DataFrame:
    """Add `decoded`: the entries that the code names, one after another, in the scale of the vectors."""
    table = F.lit([[[float(c) / scale for c in entry] for entry in book] for book in books])
    digits = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    parts = [F.get(F.get(table, F.lit(p)), digits(p)) for p in range(len(books))]
    return coded.withColumn("decoded", F.concat(*parts) if parts else F.lit(None).cast("array<double>"))


def digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error: the errors of all rows with the label, null equal to null."""
    coded = stored(coded)
    by = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    by = stored(by.select("label", F.col("total").try_cast("long").alias("label_error"), "n"))
    return look_up(coded, by, ["label"], "n").drop("n")
