"""SimHash against a plain definition and all pairs; components against union-find."""

import random
import re

import numpy as np
import xxhash

from skyfuse.llm import simhash
from skyfuse.operators.components import components

from . import cases


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def grouped(rows):
    fps = [plain(r[1]) for r in rows]
    u = sorted(set(fps))
    of = roots(u, [(a, b) for k, a in enumerate(u) for b in u[:k] if (a ^ b).bit_count() <= 2])
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[of[f]] = min(least.get(of[f], r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, f"{f:016x}", least.get(of[f])) for r, f in zip(rows, fps, strict=True))


def near_rows():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(120)) for _ in range(12)]
    out = []
    for k in range(160):
        w = base[k % 12].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "Changed"
        out.append((k, " ".join(w), None, "s", 1, 1, 1, ""))
    return out


def test_near_duplicates(spark):
    for rows in (cases.rows(), near_rows()):
        got = simhash.near_duplicates(spark.createDataFrame(rows, cases.SCHEMA).repartition(3)).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got)
        assert have == grouped(rows)
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_links_span_each_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62, 40)
    fps = {int(c) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for c in np.repeat(centre, 30)} | {int(c) for c in centre}
    want = roots(fps, [(a, b) for a in fps for b in fps if b < a and (a ^ b).bit_count() <= 2])
    for bucket in (simhash.BUCKET, 5):  # 5: buckets are dealt again
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert roots(fps, links) == want


def test_long_runs():
    fps = np.array(sorted(set(np.random.default_rng(1).integers(0, 1 << 9, 400).tolist())), np.int64)
    for radius in (0, 1, 2, 3):
        links = simhash.linked(fps, np.zeros(len(fps), int), radius)
        want = roots(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= radius])
        assert roots(range(len(fps)), links.tolist()) == want


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 300) if k % 50] + [(1000, n) for n in range(1001, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(260)]
    nodes = {n for e in links for n in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(nodes, [e for e in links if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicated(spark):
    f = cases.frame(spark)
    got = simhash.deduplicated(f)
    assert got.columns == f.columns
    rows = got.collect()
    groups = {g[3] for g in grouped(cases.rows()) if g[3] is not None}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(groups)
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.deduplicated(cases.empty(spark)).count() == 0
