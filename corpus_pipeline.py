"""The training-data pipeline: five operators of `flatwork.llm` in a row over `documents`.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
`run` writes as Parquet and reads again. All stages but the last return the columns of documents. Every row
is a document; rows that share a doc_id, or have none, stay apart. A null text has no letter, so its
document goes at the first stage. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flatwork.functions.coerce import col
from flatwork.llm import langid, packing, pii, simhash, suffixes
from flatwork.llm.common import stored
from flatwork.llm.tokens import default_path

TOKENIZER = "byte_bpe_50k.json"
PASSAGE_BYTES = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known. The declared language is `lang`, the host is `source`."""
    model = langid.fit(docs)
    named = docs.withColumnsRenamed({c: f"__c_{i}" for i, c in enumerate(docs.columns)})
    at = {c: F.col(f"__c_{i}") for i, c in enumerate(docs.columns)}
    found = langid.identify(named, model, at["text"], declared=langid.primary(at["lang"]), host=at["source"])
    return found.where("NOT rejected").select(*[c.alias(n) for n, c in at.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last."""
    return simhash.one_of_each(docs, words=3, radius=3)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also stand elsewhere."""
    cut = suffixes.remove_repeats(docs, length=PASSAGE_BYTES, as_text=True, keep_columns=True)
    return _with_text(docs, cut, F.col("kept"), lambda c: F.col("row")[c])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return _with_text(docs, pii.redact(docs), F.col("text"), col)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, default_path(TOKENIZER), end_id=0, with_ids=False))


def _with_text(docs: DataFrame, df: DataFrame, text: Column, kept: Callable[[str], Column]) -> DataFrame:
    """The columns of documents with a new text and its length; `kept` gives the others by their exact names."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[(new[c] if c in new else F.col(c) if c == "doc_id" else kept(c)).alias(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Shingle hashes, suffix sorting and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
