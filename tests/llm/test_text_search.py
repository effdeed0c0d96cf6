"""BM25 search against scoring every document, pruning, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from skyfuse.llm import text_search

from . import cases


def brute(rows, every, k):
    docs = [(r[0], Counter((r[1] or "").lower().encode().split())) for r in rows if r[0] is not None]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    asked = {}
    for i, c in docs:
        if i % every == 0:
            asked.setdefault(i, set()).update(c)
    out = []
    for q, terms in asked.items():
        s = []
        for i, c in docs:
            if i != q and (both := terms & set(c)):
                size = sum(c.values())
                s.append((-round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in both), 6), i))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


def run(spark, rows, every, k):
    got = text_search.search(spark.createDataFrame(rows, cases.SCHEMA).repartition(3), every, k).collect()
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got)


def made(n=700, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    out = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))), "en", "s", 0, 1, 1, "") for k in range(n)]
    return out + [(n + k, out[20][1], "en", "s", 0, 1, 1, "") for k in range(5)]  # ties


@pytest.mark.parametrize("shard", [100, 100_000])
def test_made(spark, monkeypatch, shard):
    monkeypatch.setattr(text_search, "SHARD", shard)
    assert run(spark, made(), 20, 10) == brute(made(), 20, 10)


def test_cases(spark):
    assert run(spark, cases.rows(), 1, 3) == brute(cases.rows(), 1, 3)
    assert run(spark, [], 1, 3) == []


@pytest.mark.parametrize("frequent, dense, block", [(4, 2, 8), (2, 1000, 16), (40, 3, 64)])
def test_frequent_terms_by_postings_and_rows(monkeypatch, frequent, dense, block):
    """Terms as rows, as frequent postings and as rare ones, against plain scores; and pivots leave blocks out."""
    for name, value in (("FREQUENT", frequent), ("DENSE", dense), ("BLOCK", block)):
        monkeypatch.setattr(text_search, name, value)
    rng = np.random.default_rng(3)
    n, v = 900, 300
    tf = (rng.random((n, v)) < np.r_[np.full(20, 0.5), np.full(80, 0.06), np.full(200, 0.004)]) * rng.integers(1, 6, (n, v))
    size = tf.sum(axis=1) + 5
    doc, term = (x.astype(np.int64) for x in np.nonzero(tf))
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    df = np.bincount(term, minlength=v)
    shard = text_search.Shard(doc.astype(np.uint16).tobytes(), tf[doc, term].astype(np.uint8).tobytes(), np.arange(n).tobytes(), size.astype(np.int64).tobytes(), np.flatnonzero(df), df[df > 0], float(size.mean()))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = text_search.K1 * (1 - text_search.B + text_search.B * size / size.mean())
    impact = tf * (text_search.K1 + 1) / (tf + norm[:, None])
    seen = 0
    for q in range(60):
        terms = np.flatnonzero(tf[q])
        want = np.round(impact[:, terms] @ idf[terms], text_search.DECIMALS)
        want[q] = 0
        best = [d for d in np.lexsort((np.arange(n), -want))[:10] if want[d] > 0]
        s, ids, blocks = shard.search(terms.astype(np.uint64), idf[terms], q, 10)
        assert ids.tolist() == best and np.allclose(s, want[best], atol=2e-6)
        seen += blocks
    assert seen < 60 * shard.n_blocks


def test_blocks_are_pruned():
    """One document far above the rest: most blocks must not be scored."""
    n = 64 * 40
    doc = np.r_[np.arange(n), [7]].astype(np.uint16)
    tf = np.r_[np.ones(n), [50]].astype(np.uint8)
    tf[7] = 60
    shard = text_search.Shard(doc.tobytes(), tf.tobytes(), np.arange(n).tobytes(), np.full(n, 10).tobytes(), [1, 2], [n, 1], 10.0)
    s, ids, seen = shard.search(np.array([1, 2], np.uint64), np.array([0.1, 5.0]), -1, 1)
    assert ids.tolist() == [7] and seen <= 8 < shard.n_blocks


def shards(tf, size, parts):
    for at in np.array_split(np.arange(len(tf)), parts):
        doc, term = (x.astype(np.int64) for x in np.nonzero(tf[at]))
        order = np.lexsort((doc, term))
        doc, term, df = doc[order], term[order], np.bincount(term, minlength=tf.shape[1])
        yield text_search.Shard(doc.astype(np.uint16).tobytes(), tf[at][doc, term].astype(np.uint8).tobytes(), at.astype(np.int64).tobytes(), size[at].astype(np.int64).tobytes(), np.flatnonzero(df), df[df > 0], float(size.mean()))


@pytest.mark.parametrize("cells, postings", [(16_000_000, 1_000_000), (4_000, 50)])
def test_queries_go_together_and_keep_their_best(monkeypatch, cells, postings):
    """Shards one after the other, with scores closer than single precision, repeated rows, and queries in lots."""
    for name, value in (("FREQUENT", 8), ("BLOCK", 16), ("CELLS", cells), ("POSTINGS", postings), ("QUERIES", 7)):
        monkeypatch.setattr(text_search, name, value)
    rng = np.random.default_rng(5)
    n, v, k = 1200, 150, 10
    tf = (rng.random((n, v)) < np.r_[np.full(30, 0.5), np.full(120, 0.03)]) * rng.integers(1, 4, (n, v))
    tf[600:640] = tf[3]
    size = tf.sum(axis=1) + 5
    idf = rng.random(v) * 1000 + np.arange(v) * 1e-5
    norm = text_search.K1 * (1 - text_search.B + text_search.B * size / size.mean())
    impact = tf * (text_search.K1 + 1) / (tf + norm[:, None])
    asked = [np.flatnonzero(tf[q]) for q in range(40)]
    own, many, terms = np.arange(40), np.array([len(t) for t in asked]), np.concatenate(asked)
    best, fresh, carried = [(np.zeros(0), np.zeros(0, np.int64))] * 40, 0, 0
    for s in shards(tf, size, 3):
        fresh += s.search_many(own, many, terms.astype(np.uint64), idf[terms], k, [(np.zeros(0), np.zeros(0, np.int64))] * 40)
        carried += s.search_many(own, many, terms.astype(np.uint64), idf[terms], k, best)
    assert carried <= fresh
    for q, (s, ids) in enumerate(best):
        want = np.round(impact[:, asked[q]] @ idf[asked[q]], text_search.DECIMALS)
        want[q] = 0
        expected = [d for d in np.lexsort((np.arange(n), -want))[:k] if want[d] > 0]
        assert ids.tolist() == expected and np.allclose(s, want[expected], atol=2e-6)
