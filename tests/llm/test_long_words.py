"""Words of any length count whole in the quality features."""

import random
import re

from skyfuse.llm import quality


def test_whole_word_counts():
    long = "x1" * 200
    a, b = quality.word_features(long + "good"), quality.word_features(long + "bad")
    assert a != b and quality.word_features(long) != quality.word_features(long + "###")
    assert quality.word_features("A1" * 200 + "b") != quality.word_features("A1" * 200)
    assert quality.word_features(long + ",") == quality.word_features(long)  # plain closing punctuation is no shape


def test_edges_as_the_pattern_has_them():
    rng = random.Random(3)
    for _ in range(2000):
        w = "".join(rng.choice("aB1_-.,é日!") for _ in range(rng.randrange(1, 12)))
        head, core, tail = re.match(r"^(\W*)(.*?)(\W*)$", w, re.S).groups()
        if not w.isalpha():
            shape = "U" if len(core) > 1 and core.isupper() else "d" if core.isdigit() else "" if core else "-"
            said = quality._hash(f"s:{head}_{tail}|{shape}")
            want = bool(head or shape or tail not in ("", ",", "."))
            got = quality.word_features(w)
            assert (said in got) == want and (not core or quality._hash(core.lower()) == got[0])
