"""Whole licence texts in documents: wrapped anew, edited, inside other text; windows against brute force."""

import random

from skyfuse.llm import license_scan

from .test_scans import frame


def rewrapped(text, width):
    w = text.split()
    return "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))


def test_whole_texts(spark):
    t = license_scan.license_texts()
    names = ["mit", "isc", "bsd-3-clause", "apache-2.0-header", "gpl-3-sentence", "mit-sentence", "isc-sentence", "bsd-sentence", "apache-2.0", "gpl-3"]
    other = " ".join(f"word{i}" for i in range(40))
    docs = [f"{other}\nbefore it {rewrapped(t[f'{k}-text'], 7)} and then\n{other}" for k in names]
    docs.append(t["mit-text"].replace("Software", "Library") + "\nbetween\n" + t["mit-text"])
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in license_scan.licenses(frame(spark, docs)).collect()}
    for k, name in enumerate(names):
        assert got[k, f"{name}-text"] == (1.0, 1)
    assert got[10, "mit-text"] == (1.0, 2)


def test_windows_against_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        template = [rng.choice("abcdefgh") for _ in range(14)]
        words = [rng.choice("abcdefghxyz") for _ in range(30)]
        at = rng.randrange(30)
        words[at:at] = [rng.choice("xyz") if rng.random() < 0.1 else w for w in template]
        have, want = license_scan.bigrams(" ".join(template)), 0.0
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                x = license_scan.bigrams(" ".join(words[i:j]))
                want = max(want, 2 * len(x & have) / (len(x) + len(have)))
        got = license_scan.Windows({"t": " ".join(template)}, 0.7).document(" ".join(words))
        assert (abs(got[0][1] - want) < 1e-12) if want >= 0.7 else got == []
