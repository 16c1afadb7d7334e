"""Token operators against the tokenizers library and brute force."""

import hashlib
import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flatwork.llm import bpe, huffman, packing, token_counts
from flatwork.llm.common import shared_folder, stored
from flatwork.llm.tokens import PieceEncoder, PieceMemory, default_path, encode_texts

WORDS, BYTES = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  \n\t ", "Hello, World's end.\nIt'll  do", "ΣΊΣΥΦΟΣ ÉCOLE İstanbul J̌ é", "x<|endoftext|>y <|endoftext|>  z",
    "<|startoftext|> a", "日本語 　 テキスト 123 456", "a\x1cb \x85c d e", "z" * 5000, "!?!? -- ...", "😀 👩‍👩‍👧", "word " * 3000, "same", "same",
]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length string, offset string")


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_pieces_give_the_ids_of_whole_texts(path):
    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "ab cD'sé́Σ 1\n\t.,!\x85　😀<|endoftext|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(500)]
    want = [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode_texts(path, texts) == want == encode_texts(path, texts)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_letters_marks_and_white_space_in_any_order(path):
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    parts = ["a", "Zoe", "é", "É", "×", "÷", "ÿ", "İ", "Σ", "'s", "'", "1", "²", ",", ".", "%%", "-", "_", "\x00", "\x1c", "\x7f", " ", "  ", "\n", "\r\n"]
    wide = ["\xa0", "\u2003", "\u3000", "\u0301", "J\u030c", "\u212a", "\u037e", "日", "😀"]
    texts = ["".join(rng.choices(rng.sample(parts, 8) + rng.sample(wide, rng.randrange(4)), k=rng.randrange(40))) for _ in range(3000)]
    assert encode_texts(path, texts) == [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_word_is_encoded_once_whatever_mark_follows(path):
    own, asked = PieceEncoder(path), []
    encode = own.memory.encode
    own.memory.encode = lambda pieces: asked.extend(pieces) or encode(pieces)
    names, marks = ["alpha", "beta", "gamma", "delta", "été", "déjà", "naïf", "ÿ"] * 2, ",.;:!?)%*$"
    texts = [" ".join(n + m for n in names) for m in marks]
    assert own.encode(texts) == [packed(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) <= len(set(names)) + len(marks) + 1  # the first word has no blank


def test_a_slice_looks_up_each_different_piece_once(monkeypatch):
    looked, each = [], PieceMemory.each
    monkeypatch.setattr(PieceMemory, "each", lambda self, pieces: looked.extend(pieces) or each(self, pieces))
    ids = encode_texts(BYTES, ["one two three, four."] * 100_000)
    assert sorted(looked) == sorted(["one", " two", " three", ",", " four", "."]) and len(set(ids)) == 1


def test_marks_stay_where_a_rule_may_join_them(tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L},]+|[\p{N}]|[^\s\p{L}\p{N},]+"
    path = tmp_path / "joined.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["one,two three, four", "é,è a1,b !,?"]
    assert encode_texts(str(path), texts) == [packed(e.ids) for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr("flatwork.llm.tokens.MEMORY_PIECES", 10)
    asked = []
    memory = PieceMemory(lambda pieces: [asked.append(p) or p.encode() for p in pieces])
    for i in range(100):
        assert memory.joined([["often", f"w{i}"], []]) == [f"oftenw{i}".encode(), b""]
    assert asked.count("often") == 1 and len(memory.young) + len(memory.old) <= 24


def test_codec_equals_the_library(docs):
    library = Tokenizer.from_file(WORDS)
    got = bpe.decode(bpe.encode(docs, WORDS), WORDS).orderBy("doc_id").collect()
    for row, text in zip(got, TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (bytes(row["ids"]), row["decoded"], row["length"]) == (packed(ids), library.decode(ids, skip_special_tokens=False), "clash")


def test_digests_are_those_of_ids_and_decoded_texts(docs):
    rows = bpe.digests(bpe.decode(bpe.encode(docs, WORDS), WORDS), WORDS).collect()
    assert len(rows) == len(TEXTS) and {r["length"] for r in rows} == {"clash"}
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) // 4 and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.digests(docs.where("false"), WORDS).count() == 0


def test_codec_of_letters_marks_and_white_space_in_any_order():
    own, library = bpe.Bpe(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    letters = [*"ab cD'sé́ΣİÀ÷ 1\n\t.,!\x1c\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b😀", "<|endoftext|>", "<|ENDOFTEXT|>", "word"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(1000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == [packed(ids) for ids in want] == own.encode(texts)
    assert own.encode([]) == own.decoded([]) == []
    assert [str(t, "utf-8") for t in own.decoded([packed(ids) for ids in want])] == library.decode_batch(want, skip_special_tokens=False)


def test_codec_meets_each_different_word_once():
    own, asked = bpe.Bpe(WORDS), []
    merged = own.merged
    own.merged = lambda words: asked.extend(words) or merged(words)
    texts = ["Zebrafish zebrafish, (ZEBRAFISH). É", "zebrafish! e\u0301 zebrafish"] * 3
    ids = own.encode(texts) + own.encode(texts[:1])
    assert ids == encode_texts(WORDS, texts + texts[:1])
    assert asked.count("zebrafish") == asked.count("é") == 1


def test_codec_drops_letters_that_the_vocabulary_lacks(tmp_path):
    spec = json.loads(Path(WORDS).read_text(encoding="utf-8"))
    vocab = ["a", "b", "a</w>", "b</w>", "ab", "ab</w>", "ba", "aba", "abab</w>"]
    spec["model"] |= {"vocab": {s: i for i, s in enumerate(vocab)}, "merges": [["ab", "ab</w>"], ["a", "b"], ["a", "b</w>"], ["ab", "a"], ["b", "a"]]}
    spec["added_tokens"] = []
    path = tmp_path / "few.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own, library = bpe.Bpe(str(path)), Tokenizer.from_file(str(path))
    rng = random.Random(4)
    texts = ["", "q", "qa", "aq b", "q q", "abq qab"] + ["".join(rng.choices("aabbq é.", k=rng.randrange(30))) for _ in range(500)]
    assert own.encode(texts) == [packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merge_skips_stale_entries():
    model, library = bpe.model(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices("aeinrst", k=rng.randrange(1, 40)))
        assert model.piece(word) == packed(library.encode(word, add_special_tokens=False).ids)
    assert model.decode(packed([0, 10**6, 1])) == library.decode([0, 10**6, 1], skip_special_tokens=False)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert bpe.decode(bpe.encode(none, WORDS), WORDS).count() == 0
    assert huffman.round_trip(none, WORDS).count() == 0
    assert packing.pack(packing.pieces(none, BYTES)).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(none, BYTES)).count() == 0


def test_files_give_the_ids_back(spark, docs):
    library = Tokenizer.from_file(WORDS)
    path = shared_folder(spark)
    blocks = stored(huffman.raw_blocks(docs.unionByName(docs.where("doc_id = 4")), WORDS, 1, block_ids=300))
    huffman.write(blocks, path)
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    got = huffman.read(spark, path).orderBy("start").collect()
    at = 0
    for row, i in zip(got, sorted([*range(len(TEXTS)), 4])):
        ids = library.encode(TEXTS[i] or "", add_special_tokens=False).ids + [1]
        assert (row["doc_id"], row["start"], row["n_tokens"], bytes(row["ids"])) == (i, at, len(ids), packed(ids))
        assert row["ids_crc32"] == zlib.crc32(packed(ids))
        at += len(ids)
    assert len(got) == len(TEXTS) + 1
    assert huffman.read(spark, path, with_ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("end, width", [(1, 2), (70_000, 4)])
def test_ids_take_16_bits_where_all_fit(docs, end, width):
    blocks = stored(huffman.raw_blocks(docs, WORDS, end))
    want = Counter(i for t in TEXTS for i in [*np.frombuffer(encode_texts(WORDS, [t or ""])[0], "<u4").tolist(), end])
    assert huffman.counts(blocks) == want
    for r in blocks.where("place IS NOT NULL").collect():
        assert len(r["ids"]) == width * sum(r["n_tokens"]) and end in huffman.unpacked(r["ids"], sum(r["n_tokens"]))
    back = huffman.round_trip(docs, WORDS, end).collect()
    assert sorted(r["doc_id"] for r in back) == list(range(len(TEXTS))) and all(bytes(r["ids"]).endswith(packed([end])) for r in back)


def test_rows_that_share_an_id_are_dealt_over_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    nulls = huffman.raw_blocks(df.repartition(4), WORDS, 1).where("place IS NOT NULL").withColumn("d", F.explode("doc_ids")).where("d IS NULL")
    sizes = [r["count"] for r in nulls.groupBy("part").count().collect()]
    assert sum(sizes) == 1334 and max(sizes) < 1334
    got = huffman.round_trip(df, WORDS).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 1334 + sorted(i for i in range(4000) if i % 3)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_a_null_id_comes_first(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a a a"), (1, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in huffman.round_trip(df, WORDS).orderBy("start").collect()] == [(None, 0), (1, 4), (2, 5)]


@pytest.mark.parametrize("most", [4, 7, 20])
def test_codes_are_short_prefix_free_and_optimal(most):
    counts = {i: c for i, c in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])}
    lengths = huffman.code_lengths(counts, most)
    assert max(lengths.values()) <= most and sum(2.0**-n for n in lengths.values()) == 1
    if most == 20:  # no limit in effect: the cost of plain Huffman codes
        heap, cost = sorted(counts.values()), 0
        while len(heap) > 1:
            cost += heap[0] + heap[1]
            heap = sorted(heap[2:] + [heap[0] + heap[1]])
        assert sum(counts[s] * n for s, n in lengths.items()) == cost
    coder = huffman.Coder(lengths)
    ids = np.random.default_rng(0).integers(0, 11, 5000)
    payload, marks = coder.encode(ids)
    assert (coder.decode(payload, marks, len(ids)) == ids).all()
    # A block can be entered at any checkpoint.
    assert (coder.decode(payload, marks[3:4], 100) == ids[3 * huffman.CHECKPOINT_IDS :][:100]).all()


def test_codes_of_one_id_and_too_many():
    assert huffman.code_lengths({7: 3}) == {7: 1} and huffman.code_lengths({}) == {}
    with pytest.raises(ValueError):
        huffman.code_lengths({i: 1 for i in range(9)}, 3)


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (1, 40, 5000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048)
        counts = Counter(lengths.tolist())
        plan = packing.plan(counts)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] += times
        assert used == counts
        assert sum(t for _, t in plan) <= -(-int(lengths.sum()) // 2048) * 1.02 + 1
    assert packing.plan({1000: 2, 24: 4, 1024: 2}) == [((1024, 1024), 1), ((1000, 1000, 24, 24), 1), ((24, 24), 1)]
    assert packing.plan({}) == []


def test_packed_pieces(spark, docs):
    library = Tokenizer.from_file(BYTES)
    many = docs.unionByName(docs.where("doc_id IN (4, 14)"))
    cut = packing.pieces(many, BYTES, end_id=0, limit=64)
    got = packing.pack(cut, limit=64).collect()
    for i, text in enumerate(TEXTS):
        ids = packed(library.encode(text or "", add_special_tokens=False).ids + [0])
        copies = 2 if i in (4, 14) else 1
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own[::copies]) == ids and len(own) == copies * (own[-1]["piece"] + 1)
        assert all(r["length"] == 64 for r in own[copies:]) and [r["start"] for r in own[::copies]] == [0] + [own[0]["length"] + 64 * k for k in range(own[-1]["piece"])]
    for _, rows in {s: [r for r in got if r["sequence_id"] == s] for s in {r["sequence_id"] for r in got}}.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64


def test_a_hot_length_packs_whole(spark):
    rows = spark.range(0, 200_000).select(F.when(F.col("id") % 3 > 0, 1000).otherwise(F.col("id") % 2000 + 1).alias("length"), F.lit("x").alias("sequence_id"))
    got = packing.pack(rows)
    assert got.count() == 200_000
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 2048 OR n <> m").isEmpty()


def test_suffix_sums(spark, docs):
    library = Tokenizer.from_file(BYTES)
    sizes = np.array([len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS])
    sums = stored(token_counts.suffix_sums(token_counts.histogram(docs, BYTES)))
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == ((sizes == n).sum(), (sizes >= n).sum(), sizes[sizes >= n].sum())
        assert r["truncated_total"] == np.minimum(sizes, n).sum() and r["quantile"] == pytest.approx((sizes <= n).mean())
    for limit in (0, 1, 7, 2500, 10**6):
        assert token_counts.truncated_total(sums, limit).first()[0] == np.minimum(sizes, limit).sum()
    for share in (0.1, 0.5, 1.0):
        assert token_counts.quantile(sums, share).first()[0] == np.sort(sizes)[int(np.ceil(share * len(sizes))) - 1]
