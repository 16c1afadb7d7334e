"""Token ids of whole texts by the `tokenizers` library, as packed little-endian unsigned 32-bit ids.

A word that comes back a thousand times is encoded once: texts fall into pieces at places where the
tokenizer's own rules never join two sides, the words of new pieces go to the library's model, and a
bounded memory keeps the ids of pieces. Pieces are cut, told apart and put together again as arrays, a
slice of text at a time, so Python meets each different piece of a slice once. Where a tokenizer's rules are not known to allow that, or a
text holds the literal form of a special token, the library gets the whole text.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F

from flatwork.llm.common import slices

#: White space by the Unicode property, which the tokenizers' patterns go by: what is no ASCII, and all of it as a set.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = "\t\n\v\f\r "
SPACE = ASCII_SPACE + WIDE_SPACE
#: What Python's split() takes for white space beyond that.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces that one generation of a worker's memory holds, the words and characters kept, and the letters of the longest piece kept.
MEMORY_PIECES = 200_000
MEMORY_WORDS = 80_000
MEMORY_PIECE_LENGTH = 40
MEMORY_CHARACTERS = 20_000

#: Letters of text that are encoded at a time: more of them hold fewer different pieces each.
SLICE_LETTERS = 1 << 22

#: Fixed value: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Fixed value: the pattern of the word-level pre-tokenizer.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A word with the blank before it, or a run of white space up to its last one: no pre-token of the
#: byte-level rule crosses these borders.
_BYTE_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
_WORD_PIECES = re.compile(f"[^{SPACE}]+")
_IS_SPACE = np.isin(np.arange(256), list(ASCII_SPACE.encode()))
_IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_IS_MARK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)]) & ~_IS_SPACE
_WIDE_SPACE = re.compile(f"[{WIDE_SPACE}]")


def default_path(name: str) -> str:
    """The place of a public vocabulary file, looked up only when no path is given."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str]:
    return _WORD_PIECES.findall(text) if NOT_SPACE.search(text) else text.split()


def narrow(text: str) -> str:
    """The text with a blank for each white space beyond ASCII."""
    return text if text.isascii() else _WIDE_SPACE.sub(" ", text)


def piece_starts(data: np.ndarray, first: np.ndarray, end: np.ndarray, marks: bool) -> np.ndarray:
    """Where the pieces of texts start: UTF-8 `data` with the bounds of each text that is not empty. All white space is ASCII.

    A piece is a word with the blank before it, or a run of white space up to its last one. With `marks`, for rules
    whose pre-tokens never go on from a letter to a mark or figure, a piece ends there too (not behind every letter:
    ASCII and À to ÿ, before ASCII).
    """
    space = _IS_SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[first], after[end - 1] = False, True
    # A run of white space begins one, so does its last byte before a word, and a word after other white space than a blank.
    starts = space & ~(before & after)
    starts[1:] |= ~space[1:] & before[1:] & (data[:-1] != ord(" "))
    if marks:
        letter = _IS_LETTER[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # × and ÷ are no letters
        letter[latin] = (data[latin] != 0x97) & (data[latin] != 0xB7)
        starts[1:] |= _IS_MARK[data[1:]] & letter[:-1]
    starts[first] = True
    return np.flatnonzero(starts)


def piece_rule(spec: dict) -> Callable[[str], list[str]] | None:
    """How a text may be cut before it is encoded, or None."""
    normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return _BYTE_PIECES.findall
    kinds = [n["type"] for n in (normal or {}).get("normalizers", ())]
    steps = pre.get("pretokenizers") or [{}]
    if set(kinds) <= {"NFC", "Replace", "Lowercase"} and steps[0].get("behavior") == "Removed" and steps[0].get("invert"):
        return words
    return None


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others follow from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def ascii_rule(pattern: str) -> re.Pattern:
    """The same pattern of letters and numbers where all characters are ASCII: no Unicode properties are looked up."""
    for name, letters in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9")):
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m.group().replace(name, letters), pattern).replace(name, f"[{letters}]")
    return re.compile(pattern, re.ASCII)


class _Spellings(dict):
    """The letters of a byte-level vocabulary that stand for a character."""

    def __init__(self):
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, character: str) -> str:
        if len(self) > MEMORY_CHARACTERS:
            self.clear()
        made = self[character] = character.encode().decode("latin-1").translate(self.letters)
        return made


class Words:
    """The words of a piece, in the letters of a byte-level vocabulary, as a vocabulary file asks for them."""

    def __init__(self, spec: dict):
        kinds = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", ())}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = steps[0]["pattern"]["Regex"] if steps else BYTE_LEVEL
        self.marks_apart = pattern in (BYTE_LEVEL, WORD_LEVEL)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.ascii_pattern = ascii_rule(pattern) if self.marks_apart else self.pattern
        self.spellings = _Spellings()

    def normal(self, text: str) -> str:
        """A text or piece as the normalizer leaves it, but for white space. Not to be applied twice."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # Letter by letter: a sigma at the end of a word has no form of its own.
            text = text.replace("Σ", "σ").lower()
        return text

    def found(self, piece: str) -> Sequence[str]:
        """The words of a normal piece."""
        if self.marks_apart:
            # Most pieces are one word, perhaps with a mark behind it.
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                return (piece,)
            if body[-1:] in (",", ".") and body[:-1].isalpha():
                return piece[:-1], piece[-1]
        return (self.ascii_pattern if piece.isascii() else self.pattern).findall(piece)

    def spelled(self, word: str) -> str:
        """A word in the letters of the vocabulary."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self.spellings[" "])
        return "".join(map(self.spellings.__getitem__, word))


class PieceMemory:
    """Packed ids of pieces in two generations: when the young one is full it becomes the old one, and a
    piece that is asked for again moves back. So frequent pieces stay, and memory is bounded."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pieces: int | None = None):
        self.encode = encode
        self.pieces = pieces or MEMORY_PIECES
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def each(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of different pieces."""
        out = list(map(self.young.get, pieces))
        at = [i for i, ids in enumerate(out) if ids is None]
        asked = [pieces[i] for i in at]
        found = list(map(self.old.get, asked))
        fresh = iter(self.encode([p for p, ids in zip(asked, found) if ids is None]))
        for i, p, ids in zip(at, asked, found):
            out[i] = ids = next(fresh) if ids is None else ids
            if len(p) <= MEMORY_PIECE_LENGTH:
                self.young[p] = ids
        self._turn()
        return out

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are given as pieces."""
        young, old = self.young, self.old
        new = set().union(*texts).difference(young)
        back = [p for p in new if p in old]
        young.update((p, old[p]) for p in back)
        fresh = list(new.difference(back))
        young.update(zip(fresh, self.encode(fresh)))
        out = [b"".join(map(young.__getitem__, pieces)) for pieces in texts]
        for p in fresh:
            if len(p) > MEMORY_PIECE_LENGTH:
                del young[p]
        self._turn()
        return out

    def _turn(self) -> None:
        if len(self.young) > self.pieces:
            self.young, self.old = {}, self.young


_PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACKERS[len(ids)].pack(*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


def piece_ids(texts: list[str], marks: bool, each: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Packed ids by pieces, for normal texts with no other white space than ASCII; `each` gives those of different pieces."""
    parts = [t.encode() for t in texts]
    ends = np.cumsum([0] + [len(p) for p in parts])
    data = b"".join(parts)
    if not data:
        return [b""] * len(texts)
    some = np.flatnonzero(np.diff(ends))
    starts = piece_starts(np.frombuffer(data, np.uint8), ends[some], ends[some + 1], marks)
    bounds = np.append(starts, len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
    known = each(found.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes, index = np.array([len(k) // 4 for k in known]), found.indices.to_numpy()
    # The ids of all pieces, by their places in the ids of different ones.
    n = sizes[index]
    upto = np.cumsum(n)
    place = np.repeat((np.cumsum(sizes) - sizes)[index] - upto + n, n)
    place += np.arange(len(place))
    ids = np.frombuffer(b"".join(known), "<u4")[place].tobytes()
    at = (4 * np.append(0, upto))[np.searchsorted(starts, ends)].tolist()
    return [ids[a:b] for a, b in zip(at, at[1:])]


class PieceEncoder:
    """Packed ids of texts, with a bounded memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = piece_rule(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.words = Words(spec) if self.cut else None
        # Words of the byte level hold the blank before them; elsewhere white space belongs to no word.
        self.drop = ASCII_SPACE if self.cut is words else ""
        self.model = self.library.model
        self.known_words: dict[str, bytes] = {}
        self.memory = PieceMemory(self._pieces)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        return packed_ids([t.id for t in self.model.tokenize(self.words.spelled(word))])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known, found, out = self.known_words, self.words.found, []
        if len(known) > MEMORY_WORDS:
            known.clear()
        for piece in pieces:
            parts = found(piece.strip(self.drop) if self.drop else piece)
            if len(parts) == 1:
                out.append(self._word(parts[0]))
                continue
            ids = []
            for word in parts:
                own = known.get(word)
                if own is None:
                    own = self._word(word)
                    if len(word) <= MEMORY_PIECE_LENGTH:
                        known[word] = own
                ids.append(own)
            out.append(b"".join(ids))
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        return piece_ids(texts, self.words.marks_apart, self.memory.each)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole, wide, plain = [], [], []
        for i, t in enumerate(texts):
            if self.cut is None or any(s in t for s in self.special):
                whole.append((i, t))
            else:
                t = self.words.normal(t)
                (plain if t.isascii() or not _WIDE_SPACE.search(t) else wide).append((i, t))
        by_piece = lambda texts: self.memory.joined([self.cut(t) for t in texts])
        for held, way in ((whole, self._library), (wide, by_piece), (plain, self._cut)):
            if held:
                for (i, _), ids in zip(held, way([t for _, t in held])):
                    out[i] = ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary file."""
    return PieceEncoder(path)


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of many texts, a bounded slice of text at a time."""
    own, out = encoder(path), []
    for a, b in slices([len(t) for t in texts], SLICE_LETTERS):
        out += own.encode(texts[a:b])
    return out


def token_ids(text: Column, path: str) -> Column:
    """Packed ids (binary) of a text column; null as empty."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(encode_texts(path, [t or "" for t in texts.to_pylist()]), pa.binary())

    return encode(text)
