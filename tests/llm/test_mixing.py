"""Mixing: targets against repeated resharing, taken words against the targets, texts against the allocation."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfuse.llm import mixing

from . import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, got, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), [s for s in names if sizes[s]]
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        for s in free:
            got[s] += left * w[s] / total
        left = sum(max(0, got[s] - 2 * sizes[s]) for s in free)
        for s in free:
            got[s] = min(got[s], 2 * sizes[s])
        free = [s for s in free if got[s] < 2 * sizes[s]]
    return got


def check(rows, got, block):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(W.findall(r[1] or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    assert Counter(got["size"]) == Counter(len(W.findall(r[1] or "")) for r in rows)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = {(round(v, 6)) for v in got.target}
    assert by == {round(want[r[3]], 6) for r in rows}
    assert got.taken.sum() == pytest.approx(sum(want.values()), abs=len(want))
    for t, g in got.groupby("target"):
        n = sum(1 for s in want if round(want[s], 6) == round(t, 6))
        assert abs(g.taken.sum() - n * t) <= n
    return want


def test_shards_and_repeats(spark):
    """Shards' counts add up to the targets, and repeats of a row each take their own words."""
    import time

    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))), "en", f"s{k % 4}", 0, 1, 1, "") for k in range(300)]
    rows += [(7000, "one row many times over " * 9, "en", "s1", 0, 1, 1, "")] * 400
    d = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    taken = {r.source: (r.t, r.w) for r in mixing.allocate(d, block=8, shard_slots=16).join(d.select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("w")).collect()}
    counts = mixing.shard_counts(d, block=8, shard_slots=16).collect()
    words = {}
    for r in counts:
        words[r.source] = words.get(r.source, 0) + r.words
    assert {s: w for s, (_, w) in taken.items()} == words and all(abs(t - w) <= 1 for t, w in taken.values())
    blocks = {}
    for r in counts:
        blocks[r.shard] = blocks.get(r.shard, 0) + r.blocks
    assert sum(blocks.values()) / 16 <= len(blocks) + 1 and max(blocks.values()) < 16 + 6 * 4 + 8  # a multinomial draw's spread
    began = time.time()
    out = mixing.mixed_documents(d, block=8, shard_slots=16)
    assert out.columns == d.columns and sum(len(r.text.split()) for r in out.collect()) == sum(words.values())
    assert time.time() - began < 120


@pytest.mark.parametrize("block", [3, 512])
def test_allocate(spark, block):
    a = mixing.allocate(cases.frame(spark), block=block).toPandas()
    check(cases.rows(), a, block)
    b = mixing.allocate(cases.frame(spark).repartition(5), block=block).toPandas()
    key = ["doc_id", "size", "target", "taken"]
    assert a.sort_values(key)[key].reset_index(drop=True).equals(b.sort_values(key)[key].reset_index(drop=True))
    assert mixing.allocate(cases.empty(spark)).count() == 0


def test_many_sources(spark):
    rows = [(i, "w " * (i % 50), None, f"s{i % 13}" if i % 13 else None, 0, 0, 0, "") for i in range(400)]
    check(rows, mixing.allocate(spark.createDataFrame(rows, cases.SCHEMA), block=16).toPandas(), 16)


def test_texts(spark):
    f = cases.frame(spark)
    got = mixing.mixed_documents(f, block=3)
    assert got.columns == f.columns
    got = got.toPandas()
    want = mixing.allocate(f, block=3).toPandas()
    assert sum(len(W.findall(t)) for t in got.text) == want.taken.sum()
    texts = {r[1] for r in cases.rows() if r[1]}
    for t in got.text:
        assert any(set(W.findall(t)) <= set(W.findall(x)) for x in texts)
    assert (got.n_chars == got.text.str.len()).all()
    assert mixing.mixed_documents(cases.empty(spark)).count() == 0


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        d = spark.range(n).withColumn("p", mixing.permuted(F.col("id"), F.lit(n), [F.lit(3)])).withColumn("q", mixing.permuted(F.col("p"), F.lit(n), [F.lit(3)], inverse=True)).toPandas()
        assert sorted(d.p) == list(range(n)) and (d.q == d.id).all()
        assert n < 1000 or abs(pd.Series(d.id).corr(d.p)) < 0.15
