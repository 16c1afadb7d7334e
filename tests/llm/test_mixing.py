"""Mixed sources: targets against resharing step by step, copies against exact fractions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flatwork.llm import mixing


def slow_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        aims = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        above = {s for s in rest if aims[s] > cap * sizes[s]}
        if not above:
            return {s: aims.get(s, Fraction(cap * sizes[s])) for s in names}
        full |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_mix(rows, targets, sizes):
    """Copies by doc_id, for rows whose ids differ."""
    out = {}
    for source in sizes:
        mine = sorted((words(t), i) for i, t, s in rows if s == source)
        unit = 1 << 32
        each = math.floor(min(3.0, float(targets[source]) / sizes[source]) * unit) if sizes[source] else 0
        named = "42:" + ("" if source is None else f"={source}")
        upto = int(hashlib.md5(named.encode()).hexdigest()[:8], 16)
        for n, i in mine:
            out[i] = (upto + each) // unit - upto // unit
            upto += each
    return out


def table():
    rows = [(i, "w " * (i % 37) + "é x\tb\x0bc", "hot") for i in range(400)]  # a no-break space is no separator
    rows += [(1000 + i, "word " * (i % 11), f"s{i % 7}") for i in range(150)]
    rows += [(2000 + i, "a b c", None) for i in range(90)]
    rows += [(3000, None, "empty"), (3001, "", "empty"), (3002, " \n\t", "empty"), (3003, "x" * 300000 + " y", "s1")]
    rows += [(3004, "\U0001f600 a", "\U0001f600"), (3005, "b " * 7, "￿"), (3006, "long " * 5000, "long")]
    return rows


def test_mix_equals_brute_force(spark):
    rows = table()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    sizes["empty"] += 0
    want = slow_targets(sizes)
    schema = "doc_id long, text string, source string, size string, copies int, `a.b` int"
    df = spark.createDataFrame([(*r, "x", 7, 1) for r in rows], schema).repartition(5)
    got = mixing.mix(df).collect()
    copies = slow_mix(rows, want, sizes)
    assert len(got) == len(rows)
    for r in got:
        text, source = next((t, s) for i, t, s in rows if i == r["doc_id"])
        assert (r["size"], r["source"], r["source_size"]) == (words(text), source, sizes[source])
        assert r["target"] == pytest.approx(float(want[source]), rel=1e-12)
        assert r["copies"] == copies[r["doc_id"]] <= 3 and r["taken"] == r["copies"] * r["size"]
    assert sum(want.values()) == sum(sizes.values())
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * longest[s] + 1
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.emit(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: c for i, c in copies.items() if c}
    assert mixing.emit(df).columns == df.columns


@pytest.mark.parametrize("sizes", [[1, 1000, 1000], [0, 5, 0, 9, 1], [1] * 8 + [500], [0, 0], [7], [10, 1, 100, 2, 1000, 3, 0]])
def test_targets_equal_resharing(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    df = spark.createDataFrame(list(named.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.cycled_weights(df)).collect()}
    assert got == {s: pytest.approx(float(t), rel=1e-12) for s, t in slow_targets(named).items()}


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b", "s")] * 30 + [(None, "c d", "s")] * 30 + [(1, "other words here", "t")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df)
    assert got.count() == 65 and got.where("copies NOT BETWEEN 0 AND 3").isEmpty()
    taken = {r["source"]: (r["sum(taken)"], r["max(target)"]) for r in got.groupBy("source").agg(F.sum("taken"), F.max("target")).collect()}
    assert all(abs(n - target) <= 3 for n, target in taken.values())


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.emit(df).count() == 0
