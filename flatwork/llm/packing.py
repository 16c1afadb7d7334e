"""Operator 5: best-fit packing by exact complements.

Documents become pieces of at most `limit` ids. Only the histogram of piece lengths reaches the driver
(at most `limit` rows). There, from the longest length on, the gap of a sequence is filled exactly by
one, two or three available lengths whose sum is the gap, as often as the counts allow; what has no
exact complement is placed by best fit, longest first. The result is a list of patterns with their
multiplicity, cut into slots (length, ranks, sequence, offset) of a size that depends on `limit` only.
Each piece then finds its slot by its rank among the pieces of its length. Ranks are counted in runs of
rows and summed over runs, so a length that a third of all pieces share is no hot group.

Nulls and empty texts are documents of the end id alone. Repeated rows are packed each for itself. An
empty table gives no rows. Columns with the names of the result are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import slices, stored
from flatwork.llm.tokens import SLICE_LETTERS, encode_texts

LIMIT = 2048
RUN_BITS = 16


def _complement(gap: int, longest: int, n: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap exactly beside `longest`, larger ones first."""
    left = n.copy()
    left[longest] -= 1
    if left[gap] > 0:
        return (gap,)
    have = np.flatnonzero(left[: gap + 1] > 0)[::-1]
    have = have[have > 0]

    def pair(total: int, most: int) -> tuple[int, int] | None:
        first = have[(have <= min(most, total - 1)) & (2 * have >= total)]
        rest = total - first
        found = first[(left[first] > 0) & (left[rest] > 0) & ((rest != first) | (left[first] > 1))]
        return (int(found[0]), int(total - found[0])) if len(found) else None

    if two := pair(gap, gap):
        return two
    for a in have[3 * have >= gap].tolist():
        if a < gap:
            left[a] -= 1
            two = pair(gap - a, a)
            left[a] += 1
            if two:
                return (a, *two)
    return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their multiplicity that use every count exactly once."""
    n = np.zeros(limit + 1, np.int64)
    for length, count in counts.items():
        if not 1 <= length <= limit:
            raise ValueError(f"Length {length} is not between 1 and {limit}.")
        n[length] = count
    patterns: list[tuple[tuple[int, ...], int]] = []
    for longest in range(limit, 0, -1):
        while n[longest] > 0:
            fill = () if longest == limit else _complement(limit - longest, longest, n)
            if fill is None:
                break
            need = Counter((longest, *fill))
            times = min(int(n[x]) // k for x, k in need.items())
            for x, k in need.items():
                n[x] -= times * k
            patterns.append(((longest, *fill), times))
    # Best fit of the rest, longest first: bins of one gap are a class of patterns.
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(limit, 0, -1):
        todo = int(n[length])
        while todo:
            gap = min((g for g in bins if g >= length), default=None)
            if gap is None:
                each = limit // length
                if todo >= each:
                    bins.setdefault(limit - each * length, []).append(((length,) * each, todo // each))
                if todo % each:
                    bins.setdefault(limit - todo % each * length, []).append(((length,) * (todo % each), 1))
                break
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            used = min(times, todo)
            if times > used:
                bins.setdefault(gap, []).append((pattern, times - used))
            bins.setdefault(gap - length, []).append(((*pattern, length), used))
            todo -= used
    return patterns + [p for held in bins.values() for p in held]


def slots(patterns: list[tuple[tuple[int, ...], int]], limit: int = LIMIT) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: sorted by (length, first rank)."""
    taken, rows, sequence = Counter(), [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and packed ids of the pieces of whole texts. Only documents of more
    than `limit` ids are cut, and all their pieces but the first are full. Without `with_ids` the ids stay in the task."""
    end = np.array([end_id], "<u4").tobytes()
    fields = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    if not with_ids:
        del fields["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_LETTERS):
                rows = []
                for d, packed in zip(keys[a:b], encode_texts(tokenizer, texts[a:b])):
                    packed += end
                    n = len(packed) // 4
                    cuts = [0, *range(n % limit or limit, n + 1, limit)]
                    for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        ids = packed[4 * s : 4 * e]
                        rows.append((d, i, s, e - s, zlib.crc32(ids), ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.values())], list(fields))

    picked = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(items: DataFrame, length: str = "length", limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to `limit`."""
    # Stored rows keep their number, and every 2**RUN_BITS consecutive numbers are a run.
    kept = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    rows = stored(items.select(*[col(c) for c in kept], F.monotonically_increasing_id().alias("__row")))
    runs = rows.withColumn("__run", F.shiftright("__row", RUN_BITS))
    by_run = runs.groupBy("__run", col(length).alias("__length")).agg(F.count("*").alias("n"))
    before = W.partitionBy("__length").orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    starts = by_run.select("__run", "__length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # At most `limit` rows reach the driver.
    counts = {r["x"]: r["n"] for r in rows.groupBy(col(length).alias("x")).agg(F.count("*").alias("n")).collect()}
    where = slots(plan(counts, limit), limit)
    scale = max(1, int(where["rank"].max(initial=0)) + 1)
    if scale * (limit + 1) >= 1 << 62:
        raise ValueError("Too many pieces for 64-bit ranks.")

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        x, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        # Ranks beyond the last first rank belong to the last slot of their length.
        at = np.searchsorted(where["length"] * scale + where["rank"], x * scale + np.minimum(r, scale - 1), side="right") - 1
        made = [where["sequence"][at] + r - where["rank"][at], where["offset"][at]]
        return pa.StructArray.from_arrays([pa.array(m, pa.int64()) for m in made], ["sequence_id", "offset"])

    own = F.row_number().over(W.partitionBy("__run", col(length)).orderBy("__row")) - 1
    ranked = (
        runs.withColumn("__own", own)
        .withColumn("__length", col(length))
        .join(starts, ["__run", "__length"])
        .withColumn("__at", place(F.col("__length").cast("long"), (F.col("__before") + F.col("__own")).cast("long")))
    )
    return ranked.select(*[col(c) for c in kept], "__at.sequence_id", "__at.offset")
