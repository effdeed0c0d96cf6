"""The pipeline's near-duplicate stage against brute-force Jaccard of five-word shingles."""

import random
import re

import numpy as np

import corpus_pipeline as cp
from skyfuse.llm import simhash

from . import cases
from .test_near_duplicates import roots

SF = "/root/testdata/sf0.001"


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def staying(rows):
    """Ids that stay, None for a group without ids."""
    sets = list({shingles(r[1]) for r in rows})
    at = {x: k for k, x in enumerate(sets)}
    similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    of, least = roots(range(len(sets)), similar), {}
    for r in rows:
        k = of[at[shingles(r[1])]]
        least.setdefault(k, r[0])
        if r[0] is not None:
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    return sorted(least.values(), key=str)


def edited_rows():
    """Groups of copies with 0 to 6 words of 150 changed, and texts that share a long passage but aren't near."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    base, passage, out = [[word() for _ in range(150)] for _ in range(15)], [word() for _ in range(90)], []
    for k in range(180):
        w = list(base[k % 15])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = word()
        out.append(w)
    out += [passage + [word() for _ in range(60)] for _ in range(40)]
    rng.shuffle(out)
    return [(k, " ".join(w), None, "s", 1, 1, 1, "") for k, w in enumerate(out)]


def test_stage_against_brute_force(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows, s in ((real, schema), (edited_rows(), cases.SCHEMA), (cases.rows(), cases.SCHEMA)):
        d = spark.createDataFrame(rows, s).repartition(3)
        got = cp.dedup_stage(spark, d, SF)
        assert got.columns == d.columns
        assert sorted((r.doc_id for r in got.collect()), key=str) == staying(rows)
    assert cp.dedup_stage(spark, cases.empty(spark), SF).count() == 0


def test_order_of_shingles_has_no_bearing(spark, monkeypatch):
    rows = edited_rows()
    monkeypatch.setattr(simhash, "COMMON", 0)
    got = simhash.similar_deduplicated(spark.createDataFrame(rows, cases.SCHEMA))
    assert sorted((r.doc_id for r in got.collect()), key=str) == staying(rows)


def test_buckets_cut_into_parts(spark, monkeypatch):
    rows = edited_rows()
    monkeypatch.setattr(simhash, "BUCKET", 3)
    got = simhash.similar_deduplicated(spark.createDataFrame(rows, cases.SCHEMA).repartition(3))
    assert sorted((r.doc_id for r in got.collect()), key=str) == staying(rows)


def test_groups_too_large_for_a_task(spark, monkeypatch):
    rows = edited_rows()
    monkeypatch.setattr(simhash, "MOST_GRAMS", 3000)
    got = simhash.similar_deduplicated(spark.createDataFrame(rows, cases.SCHEMA).repartition(3))
    assert sorted((r.doc_id for r in got.collect()), key=str) == staying(rows)


def chained_rows():
    """One group too large for a task: copies of a text, texts at the edge of 0.8 beside them, and some less alike."""
    rng = random.Random(3)
    base, out = [f"w{k}" for k in range(100)], []
    for k in range(160):
        w = list(base)
        for at in rng.sample(range(5, 95), (0, 1, 2, 3)[k % 4] if k < 130 else 3):
            w[at] = f"x{rng.randrange(40 if k % 3 else 10**6)}"
        out.append(w)
    return [(k, " ".join(w), None, "s", 1, 1, 1, "") for k, w in enumerate(out)]


def test_a_large_group_writes_no_pairs(spark, monkeypatch):
    rows, written = chained_rows(), {}
    write = simhash.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    for most in (600, 3000):
        monkeypatch.setattr(simhash, "MOST_GRAMS", most)
        got = simhash.similar_deduplicated(spark.createDataFrame(rows, cases.SCHEMA).repartition(3))
        assert sorted((r.doc_id for r in got.collect()), key=str) == staying(rows)
        del written["jac-met"]  # a row for each shingle of a prefix
        assert max(written.values()) < len(rows) * len(rows) // 8


def test_search_inside_a_group():
    rng = np.random.default_rng(8)
    for n in (1, 2, 40, 150):
        base = [rng.integers(-(1 << 62), 1 << 62, 60) for _ in range(4)]
        sets = []
        for k in range(n):
            x = base[k % 4].copy()
            x[rng.permutation(60)[: rng.integers(0, 14)]] = rng.integers(0, 1 << 40, 1)[0] + np.arange(1)
            sets.append(np.unique(x))
        label = simhash.similar_within(sets, (4, 5))
        root = list(range(n))
        for _ in range(n):
            old = list(root)
            for i in range(n):
                for j in range(i):
                    if len(np.intersect1d(sets[i], sets[j])) * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                        root[i] = root[j] = min(root[i], root[j])
            if old == root:
                break
        assert len(set(zip(label.tolist(), root, strict=True))) == len(set(label.tolist())) == len(set(root))


def test_pairs_of_runs():
    """The bit-sliced comparison against all pairs of each run; marked rows pair at any distance."""
    rng = np.random.default_rng(4)
    for radius in (0, 2, 13, 26):
        runs = np.sort(rng.integers(0, 9, 150))
        base = rng.integers(0, 1 << 62, 150)
        near = base[rng.integers(0, 40, 150)] ^ (1 << rng.integers(0, 62, 150)) ^ (1 << rng.integers(0, 62, 150))
        marked = rng.random(150) < 0.1
        got = {(int(i), int(j)) for at, to in simhash.pairs_within(near, runs, radius, marked) for i, j in zip(at, to, strict=True)}
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if runs[i] == runs[j] and (marked[i] or bin(int(near[i]) ^ int(near[j])).count("1") <= radius)}
        assert got == want


def test_fingerprint_of_a_set_tells_similarity():
    """Sets of Jaccard 0.8 stay far within the radius that candidates have."""
    rng = np.random.default_rng(6)
    far = []
    for n in (24, 60, 500):
        for _ in range(300):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
            cut = n // 9  # (n - cut) / (n + cut) = 0.8
            b = np.unique(np.r_[a[rng.permutation(n)[cut:]], rng.integers(-(1 << 62), 1 << 62, cut)])
            far.append(bin(simhash._votes(a) ^ simhash._votes(b)).count("1"))
            x, y = (np.frombuffer(simhash.sketch(v), "<u2") for v in (a, b))
            some, alike = ((x > 0) | (y > 0)).sum(), ((x == y) & (x > 0)).sum()
            assert alike >= 0.8 * some - simhash.ERR * np.sqrt(0.16 * some) + 0.5
    assert max(far) <= simhash.WIDE - 3 and 8 < np.mean(far) < 12
