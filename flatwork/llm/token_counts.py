"""Operator 6: the exact histogram of encoded lengths, with suffix sums.

Documents are encoded and only their length goes on; one aggregate gives a row per length, combined
before the shuffle. Suffix sums over the histogram come in two levels (lengths within a block of lengths,
blocks within the table) and answer every question about a context limit.

Nulls and empty texts have length 0. Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import stored
from flatwork.llm.tokens import encode_texts

LENGTHS_PER_BLOCK = 1024


def token_length(text: Column, path: str) -> Column:
    """The number of ids of a whole text."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([len(p) // 4 for p in encode_texts(path, [t or "" for t in texts.to_pylist()])], pa.int64())

    return run(text)


def histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens and n_docs: how many documents have each encoded length."""
    return docs.select(token_length(col(text), path).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each occurring length, taken as a context limit: docs_at_least and tokens_at_least (documents that
    long or longer, and their tokens), truncated_total (tokens when every document is cut there) and
    quantile (share of documents that are no longer). The histogram is stored first, so documents are encoded once."""
    lengths = stored(lengths)
    blocked = lengths.withColumns({"block": F.floor(F.col("n_tokens") / LENGTHS_PER_BLOCK), "t": F.col("n_tokens") * F.col("n_docs")})
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocked.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("t").alias("bt"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), zero).alias("docs_after"),
        F.coalesce(F.sum("bt").over(after), zero).alias("tokens_after"),
        F.sum("bd").over(every).alias("docs"),
        F.sum("bt").over(every).alias("tokens"),
    )
    down = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = blocked.withColumns({"own_docs": F.sum("n_docs").over(down), "own_tokens": F.sum("t").over(down)}).join(blocks, "block")
    docs, tokens = F.col("docs_after") + F.col("own_docs"), F.col("tokens_after") + F.col("own_tokens")
    return summed.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("tokens") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("docs") - docs + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents does not exceed."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens when every document is cut at any limit, one that does not occur as a length included: the suffix sums
    of the next length, or all tokens where none is that long."""
    cut = F.col("truncated_total") - F.col("docs_at_least") * (F.col("n_tokens") - limit)
    next_length = F.when(F.col("n_tokens") >= limit, F.col("n_tokens"))
    found = F.coalesce(F.min_by(cut, next_length), F.max_by("truncated_total", "n_tokens"))
    return sums.agg(found.alias("truncated_total"))
