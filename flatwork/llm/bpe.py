"""Operator 7: byte-pair encoding and decoding from a vocabulary file, without its library.

A word is a doubly linked list of symbols. A priority queue holds the possible merges by (rank,
place); an entry whose place no longer holds the pair of its rank is stale and is skipped. Cost of a word: n log n
in its symbols, so one word of a million letters is no trap. Texts are normalised whole and cut as arrays, a slice
at a time, so each different word of a slice meets its queue once, if a bounded memory does not know it. Decoding
looks up the vocabulary strings of all ids of a slice at once and joins them.

Nulls and empty texts give no ids and an empty decoded text. Rows, ties and repeats are independent
of each other; other columns pass through, and a column with the name of the result is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import slices
from flatwork.llm.tokens import (
    ASCII_SPACE,
    MEMORY_PIECE_LENGTH,
    MEMORY_WORDS,
    SLICE_LETTERS,
    PieceMemory,
    Words,
    byte_letters,
    narrow,
    packed_ids,
    piece_ids,
    piece_rule,
    words,
)


class Bpe:
    """Encoder and decoder of one vocabulary file of the word kind (words lower-cased, blanks dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or not steps or steps[0]["type"] != "Split":
            raise ValueError("Only byte-level BPE vocabularies that split by one pattern and drop white space are supported.")
        if spec.get("decoder") is not None or piece_rule(spec) is None:
            raise ValueError("This vocabulary file asks for rules that are not supported.")
        self.words = Words(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # A pair of symbols is one integer, and its rank leads to the symbol that it becomes.
        self.wide = max(self.vocab.values(), default=0).bit_length()
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << self.wide | self.vocab[b]] = rank
        self.made = [self.vocab[a + b] for a, b in pairs]
        # The symbols of bytes, from 256 on as the last of a word, and the ranks of pairs of them; -1: none.
        letters = [self.vocab.get(x + end, -1) for end in ("", self.suffix) for x in byte_letters()]
        self.letters = np.array(letters)
        self.letter_ranks = np.array([[-1 if min(a, b) < 0 else self.ranks.get(a << self.wide | b, -1) for b in letters] for a in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        table = [self.strings.get(i) for i in range(max(self.strings, default=-1) + 1)]
        # The strings by their ids, a blank behind each.
        self.table = None if None in table else pa.array([s + " " for s in table], pa.large_string())
        self.known_words: dict[str, bytes] = {}
        self.memory = PieceMemory(self._pieces)
        self.memory_as_written = PieceMemory(self._as_written)

    def merge(self, symbols: list[int], pair: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals; `pair` holds the rank of the pair
        that starts at each place, -1 for none."""
        n, rank_of, made_of, wide = len(symbols), self.ranks.get, self.made, self.wide
        shift = n.bit_length()
        # An entry of the queue is a rank and a place in one integer.
        queue, mask = [r << shift | i for i, r in enumerate(pair) if r >= 0], (1 << shift) - 1
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = pop(queue)
            i = entry & mask
            r = entry >> shift
            if pair[i] != r:
                continue  # stale
            j, made = after[i], made_of[r]
            symbols[i], symbols[j], pair[j] = made, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pair[i] = rank_of(made << wide | symbols[k], -1)
                if r >= 0:
                    push(queue, r << shift | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = rank_of(symbols[h] << wide | made, -1)
                if r >= 0:
                    push(queue, r << shift | h)
        return [s for s in symbols if s >= 0]

    def merged(self, words: list[str]) -> list[bytes]:
        """Packed ids of normal words, none of them empty."""
        if not words:
            return []
        parts = [w.encode() for w in words]
        ends = np.cumsum([len(p) for p in parts])
        letters = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16)
        letters[ends - 1] += 256
        symbols = self.letters[letters]
        if symbols.min(initial=0) < 0:  # letters that the vocabulary doesn't have are dropped
            held = symbols >= 0
            ends = np.cumsum(held)[ends - 1]
            letters, symbols = letters[held], symbols[held]
        ranks = np.append(self.letter_ranks[letters[:-1], letters[1:]], -1)[: len(letters)]
        ranks[ends[ends > 0] - 1] = -1
        symbols, ranks, ends = symbols.tolist(), ranks.tolist(), ends.tolist()
        ids, upto = [], [0]
        for a, b in zip([0] + ends, ends):
            ids += self.merge(symbols[a:b], ranks[a:b])
            upto.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        return [packed[a:b] for a, b in zip(upto, upto[1:])]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of normal pieces."""
        known, found = self.known_words, self.words.found
        if len(known) > MEMORY_WORDS:
            known.clear()
        parts = [found(p.strip(ASCII_SPACE)) for p in pieces]
        fresh = list({w for words in parts for w in words if w not in known})
        own = dict(zip(fresh, self.merged(fresh)))
        out = []
        for words in parts:
            if len(words) == 1:
                out.append(own.get(words[0]) or known.get(words[0], b""))
                continue
            for w in words:
                if w in own and len(w) <= MEMORY_PIECE_LENGTH:
                    known[w] = own[w]
            out.append(b"".join([own[w] if w in own else known[w] for w in words]))
        return out

    def piece(self, piece: str) -> bytes:
        """Packed ids of text without white space, as it is written."""
        parts, at = [], 0
        for m in self.special_pattern.finditer(piece) if self.special_pattern else ():
            parts += [*self.merged(self.words.found(self.words.normal(piece[at : m.start()]))), packed_ids([self.special[m.group()]])]
            at = m.end()
        return b"".join([*parts, *self.merged(self.words.found(self.words.normal(piece[at:])))])

    def _as_written(self, pieces: list[str]) -> list[bytes]:
        special = [any(s in p for s in self.special) for p in pieces]
        rest = iter(self._pieces([self.words.normal(p) for p, own in zip(pieces, special) if not own]))
        return [self.piece(p) if own else next(rest) for p, own in zip(pieces, special)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        special, plain = [], []
        for i, t in enumerate(texts):
            (special if any(s in t for s in self.special) else plain).append(i)
        # White space belongs to no word, so any of it may be a blank.
        normal = [narrow(self.words.normal(texts[i])) for i in plain]
        for i, ids in zip(plain, piece_ids(normal, self.words.marks_apart, self.memory.each)):
            out[i] = ids
        for i, ids in zip(special, self.memory_as_written.joined([words(texts[i]) for i in special])):
            out[i] = ids
        return out

    def decoded(self, packed: list[bytes]) -> list[memoryview]:
        """In UTF-8, the vocabulary strings of ids, a blank between two; an unknown id gives nothing."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        if self.table is None or ids.max(initial=0) >= len(self.table):
            strings = ([s for i in np.frombuffer(p, "<u4").tolist() if (s := self.strings.get(i)) is not None] for p in packed)
            return [memoryview(" ".join(s).encode()) for s in strings]
        if not len(ids):
            return [memoryview(b"")] * len(packed)
        made = self.table.take(pa.array(ids))
        data = memoryview(made.buffers()[2])
        ends = np.cumsum([0] + [len(p) // 4 for p in packed])
        at = np.frombuffer(made.buffers()[1], np.int64)[ends].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]

    def decode(self, packed: bytes) -> str:
        return str(self.decoded([packed])[0], "utf-8")


@functools.lru_cache(maxsize=4)
def model(path: str) -> Bpe:
    """One model for each worker process and vocabulary file."""
    return Bpe(path)


def _sizes(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the packed ids (little-endian unsigned 32-bit integers) of whole texts."""

    def run(texts: pa.Array) -> pa.Array:
        own, made = model(path), []
        for a, b in slices(_sizes(texts), SLICE_LETTERS):  # only a slice of the batch is held as Python strings
            made += own.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
        return pa.array(made, pa.binary())

    # Called non-deterministic, so that a plan that uses the ids twice doesn't encode twice.
    return df.withColumn(out, F.arrow_udf(run, "binary").asNondeterministic()(col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of packed ids; null ids give an empty text."""

    @F.arrow_udf("string")
    def run(packed: pa.Array) -> pa.Array:
        own, made = model(path), []
        for a, b in slices(_sizes(packed)):
            texts = own.decoded([p or b"" for p in packed.slice(a, b - a).to_pylist()])
            made.append(pa.array([str(t, "utf-8") for t in texts], pa.string()))
        return pa.concat_arrays(made) if made else pa.array([], pa.string())

    return df.withColumn(out, run(col(ids)))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode whole texts in one worker pass and add what identifies both: n_tokens, ids_sha256 (of the
    packed ids) and decoded_sha256 (of the decoded text in UTF-8), both as lowercase hex."""

    def run(texts: pa.Array) -> pa.Array:
        own, sizes, ids, decoded = model(path), [], [], []
        for a, b in slices(_sizes(texts), SLICE_LETTERS):
            packed = own.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            sizes += [len(p) // 4 for p in packed]
            ids += [hashlib.sha256(p).hexdigest() for p in packed]
            decoded += [hashlib.sha256(t).hexdigest() for t in own.decoded(packed)]
        columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string").asNondeterministic()(col(text))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return df.withColumn("__made", made).withColumns({n: F.col(f"__made.{n}") for n in names}).drop("__made")
