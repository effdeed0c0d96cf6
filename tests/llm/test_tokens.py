"""Packing and token-id files against the tokenizers library itself, text by text."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyfuse.llm import packing, token_cache, token_files
from skyfuse.llm.token_cache import SPACE, CachedTokenizer

from . import cases

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


_toks = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def plain(path, text, eos):
    return np.array([*_toks[path].encode(text or "", add_special_tokens=False).ids, eos], dtype="<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cache_equals_library(path):
    mine, theirs = CachedTokenizer(path), Tokenizer.from_file(path)
    chars = st.sampled_from(list(SPACE + "\x1c\x1f᠎​abcXYZ019'.,!<|>_-éÑßΣσ中́\U0001f600") + ["<|endoftext|>", "'s", "'LL", "  ", "\n\n"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(chars, max_size=40).map("".join))
    def run(text):
        assert mine.encode(text) == np.array(theirs.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    run()

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.lists(chars, max_size=30).map("".join), st.lists(st.sampled_from(["the", "The", "cat,", "it's", "naïve", "été.", "$5", "##", "\n", "a\nb", "<|endoftext|>", "x--y", "Ω", "12", "don't!", ""]), max_size=20).map(" ".join)), min_size=1, max_size=6))
    def many(texts):
        import pyarrow as pa

        ids, n = mine.encode_many(pa.array(["before", *texts], pa.string()).slice(1), 7)
        want = [[*theirs.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    many()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_full_caches_and_slices(path, monkeypatch):
    """Caches that overflow all the time, texts of more than one slice, and batches of many slices change nothing."""
    import pyarrow as pa

    for name, value in (("KEEP", 5), ("SLICE", 7), ("AT_ONCE", 300), ("LONG", 120)):
        monkeypatch.setattr(token_cache, name, value)
    mine, theirs = CachedTokenizer(path), _toks[path]
    rng = np.random.default_rng(5)
    words = ["the", "cat,", "it's", "Été", "a\nb", "x  y", "mmm", "naïve.", "Ω", "12", "zz"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    for _ in range(2):
        got = []
        for first, rows, ids, n in mine.batches(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0, 3):
            assert first == len(got) and rows == len(n)
            ends = np.cumsum(n)
            got += [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
        assert got == [[*theirs.encode(t, add_special_tokens=False).ids, 3] for t in texts]


@pytest.mark.parametrize("block", [7, 1000])
def test_writer_in_any_portions(block):
    """Files hold the same documents however these are handed over; a document may span many blocks."""
    import io

    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, int(k)).astype("<u4") for k in (3, 0, 5000, 1, 999, 1001, 0, 40)]
    for cuts in ([0, 8], [0, 1, 2, 3, 8], list(range(9))):
        out = io.BytesIO()
        w = token_files.Writer(out, block=block)
        for a, b in zip(cuts, cuts[1:], strict=False):
            w.add_many(list(range(a, b)), [len(d) for d in docs[a:b]], np.concatenate(docs[a:b]))
        w.close()
        got = list(token_files.Reader(out, out.tell()).documents())
        assert [d for d, _ in got] == list(range(8)) and all((a == b).all() for (_, a), b in zip(got, docs, strict=True))


@pytest.mark.parametrize("length", [16, 2048])
def test_pack(spark, length):
    got = packing.pack(cases.frame(spark), WORD, 1, length, with_ids=True).toPandas()
    want = Counter((r[0], plain(WORD, r[1], 1).tobytes()) for r in cases.rows())
    got = got.sort_values(["sequence_id", "offset"])
    place = got.sequence_id * length + got.offset
    assert list(place) == [0, *np.cumsum(got.length)[:-1]]  # gapless
    assert (got.offset + got.length <= length).all()
    docs, doc = Counter(), []
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        assert r.start == sum(map(len, doc))
        doc.append(list(r.ids))
        if r.start + r.length == r.doc_tokens:
            docs[(None if np.isnan(r.doc_id) else int(r.doc_id), np.array(sum(doc, []), "<u4").tobytes())] += 1
            doc = []
    assert docs == want
    last = got.iloc[-1]
    end = last.offset + last.length
    assert last["pad"] == (0 if end & (end - 1) == 0 else length - end) and (got["pad"].iloc[:-1] == 0).all()
    assert packing.pack(cases.empty(spark), WORD).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, kind):
    m = token_files.write_files(cases.frame(spark), BYTE, 2, kind=kind, block=1000)
    got = token_files.read_files(m, with_ids=True).toPandas().sort_values("start")
    assert list(got.start) == [0, *np.cumsum(got.n_tokens)[:-1]]
    want = defaultdict(list)
    for r in cases.rows():
        want[r[0]].append(plain(BYTE, r[1], 2).tobytes())
    have = defaultdict(list)
    for r in got.itertuples():
        raw = np.array(r.ids, "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(raw) and len(r.ids) == r.n_tokens
        have[None if np.isnan(r.doc_id) else int(r.doc_id)].append(raw)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    ids = got.doc_id.dropna().tolist()
    assert ids == sorted(ids) and np.isnan(got.doc_id.iloc[0])
    assert token_files.read_files(token_files.write_files(cases.empty(spark), BYTE)).count() == 0


def test_planes():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 777, dtype=np.uint32)
    for kind in ("byte", "bit"):
        assert (token_files.from_planes(token_files.to_planes(ids, kind), 777, kind) == ids).all()
