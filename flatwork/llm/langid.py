"""Operator 10: language identification by fusion of evidence.

The text gives a likelihood for each language (hashed byte trigrams, naive Bayes, fitted on a documented,
bounded sample of labelled documents). The declared language of the markup and the suffix of the address are
likelihoods too: how often pages whose text speaks for a language declare this, or have that suffix. The host
gives the prior, smoothed by its domain, which is smoothed by the whole corpus. All these counts come from
grouped aggregates over all rows, so a host with a third of them is a partial sum per task. Their logarithms
add up; the posterior is their softmax.

Long texts would drown all other evidence, so the text's weight ends at TEXT_WEIGHT trigrams (all of them are
read). A row is rejected where its text holds no letter, fits its best language no better than chance, or
where the best posterior is below MIN_POSTERIOR; `language` is then null.

Null and empty texts hold no letter. Missing evidence (null or unknown) is neutral. Repeated rows are rows like
any other. Columns of the input pass through; those with the names of the results are replaced. An empty table
gives no rows; without any labelled document every row is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import slices, stored, text_bytes

#: Labelled documents per language that the model is fitted on (about: by a hash of the text).
SAMPLE_DOCUMENTS = 500
BUCKETS = 1 << 16
TEXT_WEIGHT = 200
MIN_POSTERIOR = 0.4
STRENGTH = 20.0  # rows that the level above counts for
AT_ONCE = 1 << 16
ENTRIES_AT_ONCE = 1 << 20

#: ASCII letters and all bytes of other letters stay, the rest is a blank.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of lower-case text in bounded slices, without those of blanks alone."""
    letters = _LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    for a in range(0, len(letters) - 2, AT_ONCE):
        x = letters[a : a + AT_ONCE + 2]
        seen = (x[:-2] != 32) | (x[1:-1] != 32)
        seen &= (x[1:-1] != 32) | (x[2:] != 32)
        code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
        yield ((code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1))[seen]


@dataclass(frozen=True)
class Model:
    """Log-likelihoods, of buckets that occur only: `base` is what a language gives any trigram, and entries
    first[b] to first[b + 1] say by how much (`more`) which `language` gives bucket b more."""

    languages: tuple[str, ...]
    base: np.ndarray
    first: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def score(self, text: bytes) -> tuple[int, list[float]]:
        """The number of trigrams and their mean log-likelihood for each language."""
        n, total = 0, np.zeros(len(self.languages))
        for codes in trigrams(text):
            n += len(codes)
            for a in range(0, len(codes), step := max(1, ENTRIES_AT_ONCE // max(len(total), 1))):
                begin = self.first[codes[a : a + step]]
                sizes = self.first[codes[a : a + step] + 1] - begin
                at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                total += np.bincount(self.language[at], self.more[at], len(total))
        return n, (total / max(n, 1) + self.base if n else total).tolist()


def labelled(label: Column) -> Column:
    """The primary language of a label; a label without one, such as a name in full, as it is in lower case."""
    return F.when(primary(label) != "", primary(label)).otherwise(F.lower(label))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """A model of all labels. The driver receives a row per label, and per label and bucket that occurs in its sample."""
    named = docs.select(labelled(col(label)).alias("label"), col(text).alias("t")).where("label IS NOT NULL AND t IS NOT NULL")
    sizes = named.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    names = tuple(sorted(r["label"] for r in sizes))
    if not names:
        return Model((), np.zeros(0), np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    # A share of each label by the hash of the text: the same rows in every run, none twice more likely.
    share = F.map_from_arrays(F.lit([r["label"] for r in sizes]), F.lit([min(1.0, sample / r["n"]) for r in sizes]))
    place = F.pmod(F.xxhash64(F.lit("sample"), "t"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = named.where(place < F.element_at(share, F.col("label")))
    number = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                codes = [number[name] * BUCKETS + c.astype(np.int64) for name, t in zip(labels[a:b], texts[a:b]) for c in trigrams(t)]
                found, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["c", "n"])

    found = picked.select("label", F.lower("t").cast("binary")).mapInArrow(run, "c long, n long")
    counts = found.groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    code, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("c", "n"))
    order = np.lexsort((code // BUCKETS, code % BUCKETS))
    language, bucket, n = (code // BUCKETS)[order], (code % BUCKETS)[order], n[order]
    base = -np.log(np.bincount(language, n, len(names)) + BUCKETS)
    first = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    return Model(names, base, first, language.astype(np.int32), np.log(n + 1.0))


def score(text: Column, model: Model) -> Column:
    """n (trigrams) and ll (mean log-likelihood by language) of whole texts."""

    def run(texts: pa.Array) -> pa.Array:
        made = [model.score(t) for t in text_bytes(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["n", "ll"]
        )

    return F.arrow_udf(run, "struct<n: bigint, ll: array<double>>").asNondeterministic()(F.lower(text).cast("binary"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)\.?$", 1)


def declared_of(html: Column) -> Column:
    """The primary language that the markup declares."""
    return primary(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))


def primary(language: Column) -> Column:
    return F.lower(F.regexp_extract(language, "^[A-Za-z]{2,3}(?![A-Za-z])", 0))


def text_of(html: Column) -> Column:
    """The text of markup: no scripts, styles, comments, tags or entities."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")


def identify(
    df: DataFrame,
    model: Model,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add language, posterior, text_language and rejected to the columns `keep` (default: all)."""
    size = len(model.languages)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("language", "posterior", "text_language", "rejected")]
    if not size:
        out = {"language": "string", "posterior": "double", "text_language": "string"}
        return df.select(*[col(c) for c in kept], *[F.lit(None).cast(t).alias(c) for c, t in out.items()], F.lit(True).alias("rejected"))
    blank = F.lit(None).cast("string")
    evidence = {"d": declared, "x": suffix, "h": host, "m": domain}
    given = {k: F.when(v != "", v) if v is not None else blank for k, v in evidence.items()}
    scored = df.select(*[col(c) for c in kept], score(text, model).alias("__s"), *[v.alias(f"__{k}") for k, v in given.items()])
    # Python's answer is looked at once here; the position of the best language is what the counts go by.
    best = F.array_position("__s.ll", F.array_max("__s.ll")) - 1
    fits = (F.col("__s.n") > 0) & (F.array_max("__s.ll") > float(-np.log(BUCKETS)))

    votes = scored.where(fits).select(best.alias("b"), "__d", "__x", "__h", "__m")
    votes = stored(votes.groupBy("b", "__d", "__x", "__h", "__m").agg(F.count("*").alias("n")))
    total = [0.0] * size
    for r in votes.groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row per language at most
        total[r["b"]] = float(r["n"])
    rows = sum(total)
    overall = F.lit([(t + 1) / (rows + size) for t in total])
    totals = F.lit(total)

    def counts(key: str) -> DataFrame:
        """The counts of each value by language, and their sum."""
        by_language = votes.where(F.col(key).isNotNull()).groupBy(key, "b").agg(F.sum("n").cast("double").alias("n"))
        one = by_language.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("b").cast("int"), "n"))).alias("m"), F.sum("n").alias(f"e{key}"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        return one.select(key, dense.alias(f"c{key}"), f"e{key}")

    out = scored
    for key in ("__d", "__x", "__h", "__m"):
        out = out.join(counts(key), key, "left")

    def count(key: str, i: Column) -> Column:
        return F.coalesce(F.get(f"c{key}", i), F.lit(0.0))

    def likelihood(key: str, i: Column) -> Column:
        """How often the language goes with this value, against how often any does."""
        expected = F.col(f"e{key}") / max(rows, 1.0)
        return F.when(F.col(f"c{key}").isNull(), 0.0).otherwise(F.log((count(key, i) + STRENGTH * expected) / (F.get(totals, i) + STRENGTH)))

    def prior(i: Column) -> Column:
        sums = {key: F.coalesce(f"e{key}", F.lit(0.0)) for key in ("__m", "__h")}
        of_domain = (count("__m", i) + STRENGTH * F.get(overall, i)) / (sums["__m"] + STRENGTH)
        return F.log((count("__h", i) + STRENGTH * of_domain) / (sums["__h"] + STRENGTH))

    weight = F.least(F.col("__s.n"), F.lit(TEXT_WEIGHT))
    logs = F.transform("__s.ll", lambda x, i: x * weight + likelihood("__d", i) + likelihood("__x", i) + prior(i))
    out = out.withColumn("__l", logs).withColumn("__top", F.array_max("__l"))
    out = out.withColumn("__p", 1 / F.aggregate("__l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))
    names = F.lit(list(model.languages))
    rejected = ~(fits & (F.col("__p") >= MIN_POSTERIOR))
    return out.select(
        *[col(c) for c in kept],
        F.when(~rejected, F.get(names, (F.array_position("__l", F.col("__top")) - 1).cast("int"))).alias("language"),
        F.when(F.col("__s.n") > 0, F.col("__p")).alias("posterior"),
        F.when(fits, F.get(names, best.cast("int"))).alias("text_language"),
        rejected.alias("rejected"),
    )


def identify_pages(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and the language of web pages."""
    host = host_of(col(url))
    return identify(
        pages, model, text_of(F.coalesce(col(html), F.lit(""))), declared_of(col(html)), suffix_of(host), host, domain_of(host), keep=[page_id, url]
    )
