"""Operator 8: removal of repeated passages by a distributed difference-cover suffix sort.

A byte goes when a string of `length` bytes that covers it starts anywhere else too. Suffixes only meet
when their texts can agree, so the work is dealt by content before it is sorted:

1. Every string of `length` bytes has one anchor: its 64-byte gram with the smallest hash, the rightmost of
   equal ones. Equal strings have equal anchors at equal places. Neighbouring strings mostly share their
   anchor, so a document becomes a few context strings, each with its gram's hash (core) and its own hash.
2. A core that occurs once holds no repeat. A context that occurs twice or more is repeated as a whole.
   Both are counted with partial sums before the shuffle, so thousands of copies are one row per task.
3. What is left are distinct contexts that share a core. Each group of them is suffix-sorted by the
   difference cover modulo 3: sort the sampled triples, recurse on their names, merge the remaining
   suffixes, then compare the prefixes of neighbours. Tasks take whole groups, a bounded slice at a time.
4. A core with more than GROUP distinct contexts is too much for one task. Its strings reach either half of their
   slack to the left of the gram or more than half to its right, so they share a longer gram with their equals:
   each context is dealt again by these two, repeated ones are counted, those alone go, and so on. A level
   costs two rows a context; after eight the gram is the string itself.

The input is written once with a number for each row, and rows are told apart by that alone, whatever
their doc_id. Nulls and empty texts have no byte and nothing removed. Repeated rows are copies of each
other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import look_up, slices, stored, text_bytes

GRAM = 64
GROUP = 1024
#: Bytes that are sorted at a time, unless one group alone holds more (GROUP contexts at most).
SORT_BYTES = 1 << 18
#: Layout of `place`: the first start, then the gram's place after it, then the number of starts.
STARTS_BITS = 10


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes."""
    h = np.ndarray(len(b) - 7, "<u8", np.ascontiguousarray(b), strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    size = 8
    while size < GRAM:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (h[size:] ^ (h[size:] >> np.uint64(32)))
        size *= 2
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _rightmost_minimum(h: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest of the top 32 bits of every `window` hashes lies, the rightmost of equal ones."""
    low = np.uint64(0xFFFFFFFF)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size * 2 <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < window:
        m = np.minimum(m[: len(m) - (window - size)], m[window - size :])
    return (low - (m & low)).astype(np.int64)


def contexts(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of every context: text number, first start in the text, place of its gram after that, number of starts,
    core, own hash."""
    sizes = np.array([len(t) for t in texts])
    joined = b"".join(texts)
    none = np.zeros(0, np.int64)
    if sizes.max(initial=0) < length:
        return none, none, none, none, none, none
    b = np.frombuffer(joined, np.uint8)
    anchors = _rightmost_minimum(_gram_hashes(b), length - GRAM + 1)  # of each start in the joined texts
    ends = np.cumsum(sizes)
    number = np.repeat(np.arange(len(texts)), sizes)[: len(anchors)]
    valid = np.arange(len(anchors)) + length <= ends[number]
    starts = np.flatnonzero(valid)
    at = anchors[starts]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    counts = np.diff(first, append=len(at))
    begin, anchor = starts[first], at[first]
    core, own = [], []
    for s, n, p in zip(begin.tolist(), counts.tolist(), anchor.tolist()):
        core.append(xxhash.xxh3_64_intdigest(joined[p : p + GRAM]))
        own.append(xxhash.xxh3_64_intdigest(joined[s : s + n - 1 + length], p - s))
    signed = [np.array(x, np.uint64).view(np.int64) for x in (core, own)]
    of = number[begin]
    return of, begin - (ends - sizes)[of], anchor - begin, counts, *signed


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, texts = batch.column(0), text_bytes(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                of, offset, gram, n, core, own = contexts(texts[a:b], length)
                place = (((offset << STARTS_BITS) | gram) << STARTS_BITS) | n
                arrays = [numbers.take(pa.array(of + a)), *[pa.array(x, pa.int64()) for x in (place, core, own)]]
                yield pa.RecordBatch.from_arrays(arrays, ["number", "place", "core", "own"])

    return run


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by the difference cover modulo 3. Symbols are positive and, times
    the length and squared, fit 63 bits."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    n0, n2 = (n + 2) // 3, n // 3
    x = np.concatenate([s, np.zeros(3, np.int64)])
    one = np.arange(n0) * 3 + 1  # with a start beyond the end where n % 3 == 1
    sample = np.concatenate([one, np.arange(n2) * 3 + 2])
    base = int(s.max()) + 1
    triple = (x[sample] * base + x[np.minimum(sample + 1, n)]) * base + x[np.minimum(sample + 2, n)]
    order = np.argsort(triple, kind="stable")
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.diff(triple[order], prepend=-1) != 0)
    if names[order[-1]] < len(names):
        order = suffix_array(names)
        names[order] = np.arange(1, len(names) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    # Remaining suffixes: first symbol, then the rank of the sampled suffix behind it.
    wide = n + 3
    rest = np.arange(n0) * 3
    key = x[rest] * wide + rank[rest + 1]
    turn = np.argsort(key, kind="stable")
    rest, key = rest[turn], key[turn]
    # Merge: how many sampled suffixes of either kind come before each remaining one.
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(x[ones] * wide + rank[ones + 1], key)
    deep = lambda i: (x[i] * base + x[i + 1]) * wide + rank[i + 2]
    before += np.searchsorted(deep(twos), deep(rest))
    out = np.empty(n, np.int64)
    mine = np.zeros(n, bool)
    mine[before + np.arange(len(rest))] = True
    out[mine], out[~mine] = rest, sorted_sample
    return out


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its strings of `length` bytes also start elsewhere among them."""
    sizes = np.array([len(t) for t in strings])
    joined = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    # Every string ends with a symbol of its own, so no two suffixes are equal.
    k = len(strings)
    symbols = np.insert(joined.astype(np.int64) + k + 1, np.cumsum(sizes), np.arange(1, k + 1))
    order = suffix_array(symbols)
    number = np.repeat(np.arange(k), sizes + 1)
    place = np.arange(len(symbols)) - number  # in the joined strings
    room = (begin + sizes)[number] - place
    order = order[room[order] >= length]
    at = place[order]
    hit = np.zeros(len(joined), bool)
    if len(at) > 1:
        view = np.lib.stride_tricks.sliding_window_view(joined, length)
        for a in range(0, len(at) - 1, 1 << 14):
            left, right = at[a : a + (1 << 14)], at[a + 1 : a + 1 + (1 << 14)]
            left = left[: len(right)]
            same = (joined[left + length - 1] == joined[right + length - 1]) & (joined[left] == joined[right])
            pick = np.flatnonzero(same)
            pick = pick[(view[left[pick]] == view[right[pick]]).all(axis=1)]
            hit[left[pick]] = hit[right[pick]] = True
    return [hit[b : b + n - length + 1] for b, n in zip(begin.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end index of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[0::2], edges[1::2]


SPANS = "number long, first long, last long"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "first", "last"])


def _sort_groups(length: int):
    """Sorted contexts of a task: core, number, start, known, string. Whole cores at a time."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (number, start, known, _), hit in zip(held, repeated_starts([h[3] for h in held], length)):
            if not known:
                rows += [(number, start + a, start + b - 1) for a, b in zip(*(x.tolist() for x in _runs(hit)))]
        return _span_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for core, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if core != last and size > SORT_BYTES:
                    yield solve(held)
                    held, size = [], 0
                last = core
                held.append(tuple(row))
                size += len(row[3])
        if held:
            yield solve(held)

    return run


def dealt_again(crowded: DataFrame, length: int) -> DataFrame:
    """Contexts cut in two by how far their strings reach to the left of the gram, each part with the longer gram
    that its strings share: its hash is the new core. `gram` is its place in the string, `width` its length."""
    half = F.expr(f"({length} - width + 1) DIV 2").cast("int")
    cut = crowded.where(F.col("width") < length).withColumn("half", half)
    first = F.greatest(F.col("gram") - F.col("half") + 1, F.lit(0))  # strings from here on reach less than half
    left = F.struct(
        F.lit(0).alias("skip"), F.least("n", first).alias("n"), (F.col("gram") - F.col("half")).alias("gram"), (F.col("width") + F.col("half")).alias("width")
    )
    right = F.struct(first.alias("skip"), (F.col("n") - first).alias("n"), (F.col("gram") - first).alias("gram"), (F.lit(length + 1) - F.col("half")).alias("width"))
    sides = F.filter(F.array(*[F.struct(F.lit(i).alias("side"), x.alias("x")) for i, x in enumerate((left, right))]), lambda x: x["x"]["n"] > 0)
    parts = cut.select("core", "number", "start", "known", "string", F.explode(sides).alias("p"))
    parts = parts.select(
        "core", "number", (F.col("start") + F.col("p.x.skip")).alias("start"), "known", "p.side", "p.x.n", "p.x.gram", "p.x.width",
        F.substring("string", F.col("p.x.skip") + 1, F.col("p.x.n") + (length - 1)).alias("string"),
    )
    grams = F.xxhash64("core", "side", F.substring("string", F.col("gram") + 1, F.col("width")))
    return parts.withColumn("core", grams).drop("side")


def crowded_cores(level: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts with the number of `members` of their core, dealt again until no core has more than GROUP: the
    contexts to sort, and the spans of those that repeat as a whole on the way."""
    small, spans = [], []
    while True:
        divisible = (F.col("members") > GROUP) & (F.col("width") < length)
        crowded = level.where(divisible)
        small.append(level.where(~divisible))
        if crowded.isEmpty():
            return small, spans
        parts = stored(dealt_again(crowded, length).withColumns({"o1": F.xxhash64("string"), "o2": F.xxhash64(F.lit(1), "string")}), "zstd")
        same = ["core", "o1", "o2", "gram", "n"]
        distinct = parts.groupBy(*same).agg(
            F.count("*").alias("rows"), F.min(F.struct("number", "start")).alias("at"), F.max("known").alias("known"),
            F.first("width").alias("width"), F.first("string").alias("string"),
        )
        distinct = stored(distinct, "zstd")
        often = distinct.where("rows > 1").select(*same)
        whole = parts.where("NOT known").join(often, same)
        spans.append(whole.select("number", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
        sizes = stored(distinct.groupBy("core").agg(F.count("*").alias("members")).where("members > 1"))
        rest = distinct.select("core", "at.number", "at.start", "n", "gram", "width", (F.col("known") | (F.col("rows") > 1)).alias("known"), "string")
        level = stored(look_up(rest, sizes, ["core"], "members"), "zstd")


def _remove(length: int, as_text: bool):
    """What is left of a text and its figures. As text, each kept run is decoded for itself and a letter that a
    cut has halved is dropped; as bytes, the runs are joined as they are."""

    def run(spans: pa.Array, texts: pa.Array) -> pa.Array:
        kept, figures = [], []
        for found, text in zip(spans, text_bytes(texts)):
            if not found.is_valid:
                kept.append(text.decode() if as_text else text)
                figures.append((len(text), 0, 0))
                continue
            first, last = (found.values.field(i).to_numpy() for i in (0, 1))
            edge = np.bincount(first, minlength=len(text) + 1) - np.bincount(last + length, minlength=len(text) + 1)
            gone = np.cumsum(edge)[:-1] > 0
            runs = [text[a:b] for a, b in zip(*(x.tolist() for x in _runs(~gone)))]
            kept.append("".join(r.decode("utf-8", "ignore") for r in runs) if as_text else b"".join(runs))
            figures.append((len(text), int(gone.sum()), len(_runs(gone)[0])))
        columns = [pa.array(kept, pa.string() if as_text else pa.binary()), *[pa.array([f[i] for f in figures], pa.int64()) for i in range(3)]]
        return pa.StructArray.from_arrays(columns, ["kept", "n_bytes", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, keep_columns: bool = False) -> DataFrame:
    """doc_id, kept (remaining bytes, or text), n_bytes, n_removed and n_spans (runs of removed bytes) of every row.

    With `keep_columns` the input's other columns stay as well, as a struct `row`.
    """
    if not GRAM + 8 <= length < GRAM + (1 << STARTS_BITS):
        raise ValueError(f"The length lies between {GRAM + 8} and {GRAM + (1 << STARTS_BITS) - 1}.")
    own_row = [F.struct(*[col(c) for c in docs.columns if c != text]).alias("row")] if keep_columns else []
    texts = stored(docs.select(col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("number"), col(text).alias("text"), *own_row), "zstd")
    anchors = texts.select("number", F.col("text").cast("binary")).mapInArrow(_anchor_rows(length), "number long, place long, core long, own long")

    cores = anchors.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    shared = stored(anchors.join(cores, "core"), "zstd")
    distinct = stored(shared.groupBy("core", "own").agg(F.count("*").alias("n"), F.min(F.struct("number", "place")).alias("at")))

    mask = F.lit((1 << STARTS_BITS) - 1)
    place = {
        "start": F.shiftright("place", 2 * STARTS_BITS),
        "gram": F.shiftright("place", STARTS_BITS).bitwiseAND(mask).cast("int"),
        "n": F.col("place").bitwiseAND(mask).cast("int"),
    }
    whole = shared.join(distinct.where("n > 1").select("core", "own"), ["core", "own"]).withColumns(place)
    whole = whole.select("number", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))

    groups = distinct.groupBy("core").agg(F.count("*").alias("members")).where("members > 1")
    open_ = distinct.join(groups, "core").select("core", "at.number", F.col("at.place").alias("place"), (F.col("n") > 1).alias("known"), "members")
    open_ = open_.withColumns(place)
    wanted = open_.groupBy("number").agg(F.collect_list(F.struct("core", "start", "n", "gram", "known", "members")).alias("wanted"))
    found = texts.select("number", "text").join(wanted, "number").select("number", F.col("text").cast("binary").alias("t"), F.explode("wanted").alias("w"))
    string = F.substring("t", F.col("w.start").cast("int") + 1, F.col("w.n") + (length - 1)).alias("string")
    strings = stored(found.select("w.core", "number", "w.start", "w.n", "w.gram", F.lit(GRAM).alias("width"), "w.known", string, "w.members"), "zstd")

    small, spans = crowded_cores(strings, length)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = reduce(DataFrame.unionByName, [s.select("core", "number", "start", "known", "string") for s in small])
    sorted_ = sorted_.repartition(parts, "core").sortWithinPartitions("core", "number", "start").mapInArrow(_sort_groups(length), SPANS)

    spans = reduce(DataFrame.unionByName, [whole, sorted_, *spans])
    by_row = spans.groupBy("number").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kind = "string" if as_text else "binary"
    cut = F.arrow_udf(_remove(length, as_text), f"struct<kept: {kind}, n_bytes: bigint, n_removed: bigint, n_spans: bigint>").asNondeterministic()
    joined = texts.join(by_row, "number", "left").select("doc_id", *([F.col("row")] if keep_columns else []), cut(F.col("spans"), F.col("text").cast("binary")).alias("r"))
    return joined.select("doc_id", *(["row"] if keep_columns else []), "r.*")
