"""Passage removal against all windows in a dictionary."""

import hashlib
import random
import re

import pytest

from skyfuse.llm import substring

from . import cases


def brute(rows, span):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = {}
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for j in range(len(w) - span + 1):
                k = tuple(w[j : j + span])
                least[k] = min(least.get(k, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        if r[0] is not None:
            for j in range(len(w) - span + 1):
                if least[tuple(w[j : j + span])] < r[0]:
                    gone.update(range(j, j + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0] is None, r[0] or 0, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, span):
    got = substring.deduplicated_spans(spark.createDataFrame(rows, cases.SCHEMA).repartition(3), span).collect()
    for r in got:
        assert r.n_removed == sum(x.hi - x.lo for x in r.spans)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def made(seed, n=90, alphabet=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(alphabet))
    passages = [[word() for _ in range(rng.randrange(48, 75))] for _ in range(4)]
    out = []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            p = rng.choice(passages)
            w[at:at] = p[rng.randrange(3) :] if rng.random() < 0.5 else p
        if out and rng.random() < 0.3:
            w = out[rng.randrange(len(out))][1].split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
        out.append((rng.randrange(1000), " ".join(w), None, None, 0, 0, 0, ""))
    return out + [(7, "x " * 130, None, None, 0, 0, 0, ""), (9, "x " * 90 + "y", None, None, 0, 0, 0, "")]


@pytest.mark.parametrize("shard", [2048, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_made(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(substring, "SHARD", shard)
    rows = made(seed)
    assert run(spark, rows, 50) == brute(rows, 50)


def test_cases(spark):
    assert run(spark, cases.rows(), 50) == brute(cases.rows(), 50)
    assert run(spark, [], 50) == []


def test_long_texts_go_in_parts(spark, monkeypatch):
    import numpy as np

    rng = random.Random(3)
    w = [str(rng.randrange(99)).encode() for _ in range(5000)]
    hashes = substring.WordHash()
    whole = substring.segments(np.fromiter(map(hashes.__getitem__, w), np.uint64), np.zeros(len(w), np.int64), 50)
    assert whole[2].sum() == len(w) - 49  # every window in one segment
    assert (whole[1][1:] == (whole[1] + whole[2])[:-1]).all()


@pytest.mark.parametrize("part", [60, 173])
def test_parts_find_the_same(spark, monkeypatch, part):
    """Texts of many parts: the same segments, and the same words go."""
    import numpy as np

    monkeypatch.setattr(substring, "PART", part)
    rows = made(4)
    assert run(spark, rows, 50) == brute(rows, 50)
    rng, hashes = random.Random(9), substring.WordHash()
    w = [str(rng.randrange(40)).encode() for _ in range(2000)]
    whole = substring.segments(np.fromiter(map(hashes.__getitem__, w), np.uint64), np.zeros(len(w), np.int64), 50)
    cover = np.zeros(len(w), np.int64)
    for b in substring._long(1, 2, w, 50, hashes, part):
        for at, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            cover[at : at + n] += 1
    assert (cover[: len(w) - 49] >= 1).all() and (cover[len(w) - 49 :] == 0).all() and whole[2].sum() == len(w) - 49


def test_repeated_rows(spark):
    """Rows alike in id and text each get the spans once."""
    rows = made(3)
    twice = [*rows, *rows[:10], *rows[:10], *rows[:10]]
    assert run(spark, twice, 50) == brute(twice, 50)


def test_automaton():
    rng = random.Random(6)
    for _ in range(200):
        seqs = [[rng.choice("ab") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        auto, probe = substring.Automaton(), [rng.choice("abc") for _ in range(15)]
        for s in seqs:
            auto.add(s)
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for n in (1, 2, 3, 4):
            assert auto.matches(probe, n) == [i for i in range(n - 1, 15) if tuple(probe[i - n + 1 : i + 1]) in subs]
