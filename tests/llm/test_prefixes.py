"""The conversation trie against a trie that is built turn by turn."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flatwork.llm import common, prefixes

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, `a.b` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(rows, group=5, modulus=9):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        base = c - (abs(c) % group) * (1 if c > 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {n: [m for m in members if m and m[:-1] == n] for n in members}
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in convs if paths[c] == node)
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children[node]),
                sum(not children[m] for m in below),
                sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def fast_trie(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in prefixes.trie(prefixes.rebuilt(spark.createDataFrame(rows, schema))).select(COLUMNS).collect()), key=str)


def conversation(rng, c, n, words="abé"):
    return [(c, i, rng.choice(["user", "assistant"]), rng.choice(words) * rng.randint(1, 3), 1, "x", 2) for i in range(n)]


@pytest.mark.parametrize("segment, bits", [(prefixes.SEGMENT, prefixes.PIECE_BITS), (3, 1)])
def test_equals_a_trie_built_by_hand(spark, monkeypatch, segment, bits):
    monkeypatch.setattr(prefixes, "SEGMENT", segment)
    monkeypatch.setattr(prefixes, "PIECE_BITS", bits)
    rng = random.Random(4)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 7))]
    rows += [r for c in (-7, -5, -1, 1002, 2**40 + 3) for r in conversation(rng, c, 9)]  # no base, or a negative one
    rows += [(c, i, "user", "hi", 1, "x", 2) for c in range(100, 160) for i in range(12)]  # a hot sequence
    rows += [(200, i, "user", f"t{i}", 1, "x", 2) for i in range(300)]  # a hot conversation
    rows += [(205, i, "user", f"t{i}", 1, "x", 2) for i in range(100)]  # a proper prefix of it
    rows += [(7, None, None, None, 1, "x", 2), (7, None, "user", "", 1, "x", 2), (8, 2, "b", "same turn", 1, None, 2), (8, 2, "a", "z", 1, "x", 2)]
    rows += [(9, 1, "user", "twice", 1, "x", 2)] * 2 + [(None, 1, "user", "nobody's", 1, "x", 2)] * 50
    rows += [(11, 0, "user", "long " * 40000, 1, "x", 2)]
    rng.shuffle(rows)
    assert fast_trie(spark, rows) == slow_trie(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # With a head of up to 8 turns and no base, short conversations lose all their turns.
    rows = [(c, 0, "user", "only", 1, "x", 2) for c in range(1001, 1005)]
    assert fast_trie(spark, rows) == slow_trie(rows)
    only = [c for c in range(1001, 1005) if zlib.crc32(str(c).encode()) % 9][:1]
    rows = [(only[0], 0, "user", "only", 1, "x", 2)]
    assert fast_trie(spark, rows) == [(only[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(only[0]).encode()).hexdigest())]


def test_no_conversations(spark):
    assert fast_trie(spark, []) == []
    assert fast_trie(spark, [(None, 1, "user", "x", 1, "x", 2)]) == []


def test_given_conversations(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in given.collect()]
    assert fast_trie(spark, rows, given.schema) == slow_trie(rows)


def test_look_up_splits_hot_keys(spark):
    rows = common.stored(spark.range(1000).select(F.when(F.col("id") > 300, None).otherwise(F.col("id") % 50).alias("k"), "id"))
    table = common.stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")))
    got = {r["id"]: (r["k"], r["n"], r["s"]) for r in common.look_up(rows, table, ["k"], "n").collect()}
    want = {r["k"]: (r["k"], r["n"], r["s"]) for r in table.collect()}
    assert got == {r["id"]: want[r["k"]] for r in rows.collect()} and len(got) == 1000
    assert common.look_up(rows, table.where("k < 10"), ["k"], "n").count() == sum(want[k][1] for k in range(10))
    assert common.look_up(rows.where("false"), table, ["k"], "n").count() == 0
    assert common.look_up(rows, table.where("false"), ["k"], "n").count() == 0
