"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flatwork.llm import (
    bpe,
    codes,
    huffman,
    langid,
    lattice,
    mixing,
    packing,
    pii,
    prefixes,
    simhash,
    suffixes,
    token_counts,
    vptree,
)
from flatwork.llm.oracles import CONVERSATION_TRIE, SOURCE_MIXING, VECTOR_CODES
from flatwork.llm.tokens import default_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_read(spark, sf_dir, "documents"), default_path(WORDS), end_id=1, with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count(F.col("spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.written(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents"), default_path(BYTES), end_id=0, with_ids=False))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(_read(spark, sf_dir, "documents"), default_path(BYTES)))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(documents, default_path(WORDS)).drop("text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(_read(spark, sf_dir, "documents"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(_read(spark, sf_dir, "documents"))
    return langid.identify_pages(_read(spark, sf_dir, "pages"), model)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.rebuilt(_read(spark, sf_dir, "conversations"), group=5, modulus=9))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), cycle=(1, 2, 3), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    books = codes.fit(vectors, parts=8, entries=16, rounds=6, scale=4096)
    coded = codes.with_label_error(codes.encode(vectors, books, scale=4096))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_near_dedup,
        op2_vantage_point_search,
        op3_huffman_token_files,
        op4_pii,
        op5_best_fit_packing,
        op6_token_counts,
        op7_bpe_codec,
        op8_suffix_dedup,
        op9_simhash_near_dedup,
        op10_language_id,
        op11_conversation_trie,
        op12_source_mixing,
        op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_source_mixing": SOURCE_MIXING,
    "op13_vector_codes": VECTOR_CODES,
}
