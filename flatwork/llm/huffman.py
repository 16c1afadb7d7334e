"""Operator 3: token ids as canonical length-limited Huffman codes, in independent blocks.

Code lengths come from the counts of all ids of the corpus: counted by the task that encodes, summed by
id, and read by the driver as one row per id (bounded by the vocabulary). Package-merge keeps every code within
MAX_BITS, so a table of 2**MAX_BITS entries decodes one id per look-up.

File format: a folder with two Parquet tables. `codebook` (id, n_bits) states the code: canonical codes
follow from the lengths by (length, id). `blocks` holds one row per block of consecutive documents:
block (in order of documents), doc_ids and n_tokens (one entry per document), first_token (ids of all
documents before the block), payload (bits, most significant first) and checkpoints (the bit offset of
every CHECKPOINT_IDS-th id of the block, so decoding can start inside). A block needs nothing but the
codebook.

Nulls and empty texts are documents that hold only the end id. Documents are ordered by doc_id, and
equal doc_ids by a hash of the text; a null doc_id comes first. An empty table gives an empty codebook
and no block. Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import shared_folder, slices, stored
from flatwork.llm.tokens import SLICE_LETTERS, encode_texts

MAX_BITS = 20
BLOCK_IDS = 1 << 18
CHECKPOINT_IDS = 1 << 9


def code_lengths(counts: dict[int, int], max_bits: int = MAX_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code whose codes have at most `max_bits` bits (package-merge)."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) > 1 << max_bits:
        raise ValueError(f"{len(symbols)} ids need codes of more than {max_bits} bits.")
    if len(symbols) < 2:
        return {s: 1 for s in symbols}
    weights = np.array([counts[s] for s in symbols], np.int64)
    # Level by level, pairs of the row below merge with the symbols; 1 marks a pair.
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        rows.append(order >= len(weights))
        ranked = both[order][: len(both) // 2 * 2]
        packages = ranked[0::2] + ranked[1::2]
    lengths, take = np.zeros(len(symbols), np.int64), 2 * len(symbols) - 2
    for row in reversed(rows):
        pairs = int(row[:take].sum())
        lengths[: take - pairs] += 1  # symbols stand in order of weight, so the first ones are taken
        take = 2 * pairs
    return dict(zip(symbols, lengths.tolist()))


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, their lengths and their codes, in canonical order."""
    ids = np.array(sorted(lengths, key=lambda s: (lengths[s], s)), np.int64)
    bits = np.array([lengths[s] for s in ids.tolist()], np.int64)
    top = int(bits.max(initial=1))
    # A code is the sum of the space that the codes before it take.
    codes = (np.cumsum(1 << (top - bits)) - (1 << (top - bits))) >> (top - bits)
    return ids, bits, codes


class Coder:
    """Encodes and decodes ids with one codebook."""

    def __init__(self, lengths: dict[int, int]):
        self.ids, self.bits, self.codes = canonical(lengths)
        # From an id to its row: an id is below the size of the vocabulary.
        self.row = np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        self.row[self.ids] = np.arange(len(self.ids))
        self.top = int(self.bits.max(initial=1))
        self.table = np.repeat(np.arange(len(self.ids), dtype=np.int32), 1 << (self.top - self.bits))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of ids, and the bit offset of every CHECKPOINT_IDS-th."""
        row = self.row[ids]
        bits = self.bits[row]
        ends = np.cumsum(bits)
        starts, total = ends - bits, int(ends[-1]) if len(ends) else 0
        # A code lies in one or two words of 32 bits. Codes share no bit, so sums of the codes that
        # start in a word set its bits; starts ascend, so each word is one stretch of the ids.
        wide = self.codes[row].astype(np.uint64) << (64 - (starts & 31) - bits).astype(np.uint64)
        word = starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(total // 32 + 2, np.uint64)
        if len(first):
            words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT_IDS]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids again: all stretches between checkpoints advance together, one look-up for each id."""
        w = np.frombuffer(payload + bytes(8), np.uint8).astype(np.int64)
        from_byte = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
        place, rows = np.array(checkpoints, np.int64), np.zeros((len(checkpoints), CHECKPOINT_IDS), np.int32)
        last, down, mask = n - (len(place) - 1) * CHECKPOINT_IDS, 32 - self.top, (1 << self.top) - 1
        for k in range(min(n, CHECKPOINT_IDS)):
            if k == last:  # the last stretch is shorter
                place = place[:-1]
            row = self.table[(from_byte[place >> 3] >> (down - (place & 7))) & mask]
            rows[: len(place), k] = row
            place = place + self.bits[row]
        return self.ids[rows.reshape(-1)[:n]]


BLOCK_FIELDS = {
    "place": pa.int64(), "own": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "ids": pa.binary(),
    "counted": pa.list_(pa.int64()), "times": pa.list_(pa.int64()),
}


def _row(*values) -> pa.RecordBatch:
    arrays = [pa.array([v], t) for v, t in zip(values, BLOCK_FIELDS.values())]
    return pa.RecordBatch.from_arrays(arrays, list(BLOCK_FIELDS))


def unpacked(ids: bytes, n: int) -> np.ndarray:
    """The n ids of a block, which take 16 bits each where all of them fit and 32 bits elsewhere."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents in ascending order, encoded by the tokenizers library with the end id appended.

    Rows with a place are blocks of packed ids: part and place (order of the blocks), own (ids before it in its
    part), doc_ids, n_tokens, ids. The others say how often a task met each id: counted, times.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int | None] = []
        held: list[bytes] = []
        place, own, size, total = 0, 0, 0, np.zeros(0, np.int64)

        def block() -> pa.RecordBatch:
            nonlocal total
            ids = np.frombuffer(b"".join(held), "<u4")
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total = more
            packed = ids.astype("<u2") if ids.max() < 1 << 16 else ids
            return _row(place, own, docs, [len(h) // 4 for h in held], packed.tobytes(), None, None)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE_LETTERS):
                for d, packed in zip(keys[a:b], encode_texts(tokenizer, texts[a:b])):
                    docs.append(d)
                    held.append(packed + end)
                    size += len(held[-1]) // 4
                    if size >= block_ids:
                        yield block()
                        docs, held, size, place, own = [], [], 0, place + 1, own + size
        if docs:
            yield block()
        met = np.flatnonzero(total)
        yield _row(None, None, None, None, None, met, total[met])

    # Texts move, not ids: ranges are drawn from a scan without the tokenizer. The hash parts rows that share an id.
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select(col(doc_id).cast("long").alias("d"), col(text).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(parts, "d", "h")
        .sortWithinPartitions("d", "h")
        .select("d", "t")
    )
    lists = "doc_ids array<long>, n_tokens array<long>, ids binary, counted array<long>, times array<long>"
    blocks = ordered.mapInArrow(run, f"place long, own long, {lists}")
    return blocks.withColumn("part", F.spark_partition_id())  # ranges are numbered in the order of their keys


def counts(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs, from the counts of every task. At most one row per id of the vocabulary."""
    met = blocks.where("place IS NULL").select(F.explode(F.arrays_zip("counted", "times")).alias("c"))
    found = met.groupBy(F.col("c.counted").alias("id")).agg(F.sum("c.times").alias("n"))
    return {r["id"]: r["n"] for r in found.collect()}


def write(blocks: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Code blocks of packed ids (see `raw_blocks`, stored) and write them with their codebook."""
    if not 1 <= max_bits <= 25:
        raise ValueError("max_bits lies between 1 and 25.")
    spark = blocks.sparkSession
    lengths = code_lengths(counts(blocks), max_bits)
    blocks = blocks.where("place IS NOT NULL").drop("counted", "times")
    book = [(i, n) for i, n in lengths.items()]
    spark.createDataFrame(book, "id long, n_bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            totals = [sum(sizes) for sizes in batch.column("n_tokens").to_pylist()]
            made = [coder.encode(unpacked(p, n)) for p, n in zip(batch.column("ids").to_pylist(), totals)]
            names = ["block", "first_token", "doc_ids", "n_tokens"]
            values = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + values, [*names, "payload", "checkpoints"])

    # What lies before a range: one row for each task that wrote, so it may be broadcast.
    n = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = blocks.groupBy("part").agg(F.sum(n).alias("n"), F.count("*").alias("b")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("t"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b")
    )
    numbered = blocks.join(F.broadcast(ranges), "part").select(
        (F.col("b") + F.col("place")).alias("block"), (F.col("t") + F.col("own")).alias("first_token"), "doc_ids", "n_tokens", "ids"
    )
    out = "block long, first_token long, doc_ids array<long>, n_tokens array<long>, payload binary, checkpoints array<long>"
    numbered.mapInArrow(code, out).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (packed in 32 bits each;
    left out if not wanted) and their checksum ids_crc32."""
    lengths = {r["id"]: r["n_bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                first, payload = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                sizes, marks = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (2, 4))
                ends = np.cumsum(sizes)
                packed = memoryview(coder.decode(payload, marks, int(ends[-1])).astype("<u4").tobytes())
                values = [packed[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                arrays = [batch.column(1)[row].values, *[pa.array(c, pa.int64()) for c in (first + ends - sizes, sizes)]]
                arrays.append(pa.array([zlib.crc32(v) for v in values], pa.int64()))
                if with_ids:
                    arrays.append(pa.array([bytes(v) for v in values], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    blocks = spark.read.parquet(f"{path}/blocks").select("first_token", "doc_ids", "n_tokens", "payload", "checkpoints")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode whole texts, write the files to `path` (default: a new shared folder), and read them back."""
    path = path or shared_folder(docs.sparkSession)
    write(stored(raw_blocks(docs, tokenizer, end_id, doc_id, text), "zstd"), path)
    return read(docs.sparkSession, path, with_ids)
