"""The ordinal classifier on held-out labelled rows, and on odd inputs."""

import random

import numpy as np

from skyfuse.llm import quality

from . import cases


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [rng.choice("abcdefgh") + rng.choice("xyzuvw") + rng.choice("klmnop") for _ in range(rng.randrange(30, 200))]
        g = rng.choice([0, 1, 2, 2])
        if g == 0:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        elif g == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "vile", "awful"])
        out.append((k, " ".join(w), g))
    return out


def test_held_out(spark):
    rows = made(1500, 1)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows], cases.SCHEMA)
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in rows if k < 900] + [(5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    test = [(k, g) for k, _, g in rows if k >= 900]
    keep = np.array([got[k].keep for k, _ in test])
    grade = np.array([g for _, g in test])
    assert keep[grade == 2].mean() > 0.97 and keep[grade < 2].mean() < 0.03
    mean = [np.mean([got[k].expected_grade for k, g in test if g == x]) for x in range(3)]
    assert mean[0] < mean[1] < mean[2]
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.keep}


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(cases.frame(spark), none)
    got = quality.score(cases.frame(spark), model).collect()
    assert len(got) == len(cases.rows())
    assert sum(not r.keep for r in got) >= sum(not (r[1] or "").strip() for r in cases.rows())
    assert quality.score(cases.empty(spark), model).count() == 0
    assert quality.kept_documents(cases.frame(spark), model).count() <= len(cases.rows())
    p = model.probabilities(0.3)
    assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0


def test_bounded_fit(spark):
    rows = made(60, 2)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows], cases.SCHEMA)
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in rows], "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs, labels, fit_rows=20), quality.fit(docs.repartition(3), labels.repartition(2), fit_rows=20)
    assert a.weights == b.weights and a.thresholds == b.thresholds


def test_score_by_the_formula(spark):
    """Score, probabilities and expected grade reckoned one by one from the weights and thresholds."""
    rows = made(400, 7)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows], cases.SCHEMA)
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in rows], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, m).collect()}
    low, high = (np.exp(-np.logaddexp(0, -t)) for t in (0.0, 1.0))  # the logistic, written another way
    assert low == 0.5 and abs(high - 0.7310585786) < 1e-9
    for k, t, _ in rows:
        feats = set()
        for w in t.split():
            feats |= set(quality.word_features(w))
        ratios = quality.text_features(t, quality.Features()) - feats
        z = sum(m.weights.get(f, 0.0) for f in feats | ratios)
        below = [np.exp(-np.logaddexp(0, z - x)) for x in m.thresholds]
        p = np.diff([0.0, *below, 1.0])
        r = got[k]
        assert abs(r.score - z) < 1e-9 and abs(r.tail_prob - p[2]) < 1e-9 and abs(r.expected_grade - (p[1] + 2 * p[2])) < 1e-9
        assert r.keep == (p[2] >= quality.KEEP_FROM)


def test_fit_is_the_better_likelihood(spark):
    """The fitted weights and thresholds are likelier than thresholds alone, and than weights moved off."""
    rows = made(300, 8)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows], cases.SCHEMA)
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in rows], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, labels)
    grade = {k: g for k, _, g in rows}
    of = quality.Features()
    feats = {k: quality.text_features(t, of) for k, t, _ in rows}

    def loss(model):
        return -sum(np.log(max(1e-12, model.probabilities(model.score(feats[k]))[g])) for k, g in grade.items())

    share = np.cumsum([sum(g == x for g in grade.values()) / len(grade) for x in (0, 1)])
    alone = quality.OrdinalModel({}, tuple(np.log(share / (1 - share)).tolist()))
    half = quality.OrdinalModel({f: w / 2 for f, w in m.weights.items()}, m.thresholds)
    assert loss(m) < 0.3 * loss(alone) and loss(m) < loss(half)


def test_repeated_ids_stay_bounded(spark):
    rows = made(30, 3)
    docs = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows] * 5 + [(0, "other text", "en", "s", 0, 1, 1, "")], cases.SCHEMA)
    once = spark.createDataFrame([(k, t, "en", "s", 0, 1, 1, "") for k, t, _ in rows[1:]], cases.SCHEMA)
    labels = spark.createDataFrame([(k, int(g > 0), int(g == 1)) for k, _, g in rows] * 2, "doc_id long, quality int, toxic int")
    a = quality.fit(docs, labels.where("doc_id > 0"))
    b = quality.fit(once, labels.where("doc_id > 0").distinct())
    assert a.weights == b.weights and a.thresholds == b.thresholds
