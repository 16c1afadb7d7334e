"""The pipeline stage by stage, on a small table."""

import random

import pytest
from pyspark.sql import functions as F

from flatwork.llm.common import stored
from tests.llm.test_text import slow_removal

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_chain(spark, docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, sf))
        assert docs.schema.simpleString() == before.schema.simpleString(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf, docs):
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_decisions(spark, docs, sf):
    stages = dict(corpus_pipeline.STAGES)
    rows = [docs.where("doc_id = 1").first(), docs.where("doc_id = 2").first()]
    more = [(9001, rows[0]["text"], "en", "s", 1), (9002, None, "en", "s", 1), (9003, "??? 123", "en", "s", 1), (9002, None, "en", "s", 1)]
    df = spark.createDataFrame([*[tuple(r) for r in rows], *more], docs.schema)
    assert {r["doc_id"] for r in stages["language ID"](spark, docs.unionByName(df.where("doc_id > 9000")), sf).collect()} >= {1, 2, 9001}
    kept = sorted(r["doc_id"] for r in stages["SimHash near-dedup"](spark, df, sf).collect())
    assert kept == [1, 2, 9002, 9003]  # 9001 repeats 1, and the two rows of 9002 are one document
    rng = random.Random(1)
    parts = ["".join(rng.choices("abcdé ", k=300)) for _ in range(4)]
    texts = [parts[0] + parts[1], parts[2] + parts[1] + parts[3], "clean"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], docs.schema)
    got = stages["suffix-array dedup"](spark, df, sf).orderBy("doc_id").collect()
    want = slow_removal([t.encode() for t in texts], 200)
    assert [len(t.encode()) - w[1] for t, w in zip(texts, want)] == [len(r["text"].encode()) for r in got]
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    df = spark.createDataFrame([(1, "mail me@here.org", "en", "s", 0), (2, None, "en", "s", 0)], docs.schema)
    assert [tuple(r)[1] for r in stages["PII"](spark, df, sf).orderBy("doc_id").collect()] == ["mail [EMAIL]", None]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def test_near_copies_keep_one_row_of_each_group(spark, sf):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))
    texts = [text() for _ in range(30)]
    rows = [(None, t) for t in texts[:20] for _ in range(2)]  # unlike texts without an id, each twice
    rows += [(7, texts[20]), (7, texts[21]), (8, texts[20]), (9, texts[21]), (7, texts[20])]  # one id in two groups
    rows += [(5, texts[0]), (None, texts[22]), (3, texts[22]), (4, texts[22])]  # an id goes before none
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, sf).collect()]
    want = [(5, texts[0]), *[(None, t) for t in texts[1:20]], (7, texts[20]), (7, texts[21]), (3, texts[22])]
    assert sorted(got, key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_stages_keep_other_columns_by_their_exact_names(spark, docs, sf):
    more = docs.limit(20).select("*", F.col("n_chars").alias("a.b"), F.lit("k").alias("kept"), F.lit(1).alias("row"), F.lit(2).alias("number"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns, name
        assert out.where("kept <> 'k' OR row <> 1 OR number <> 2 OR `a.b` IS NULL").isEmpty(), name
