"""The pipeline stage by stage on the smallest tables: each against a plain reading of what it must do to its own input."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from skyfuse.llm import mixing, quality, secret_scan

from .test_mixing import brute_targets
from .test_shingle_dedup import staying

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before = docs.collect()
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]

    before, after = seen["quality"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    bad = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
    good = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.35 * len(bad)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = seen["near_duplicates"]
    assert sorted((r.doc_id for r in after), key=str) == staying([tuple(r) for r in before])  # five words, Jaccard 0.8
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = seen["secrets"]
    assert [r.doc_id for r in sorted(before)] == [r.doc_id for r in sorted(after)]
    old = {r.doc_id: r for r in before}
    for r in after:
        t = old[r.doc_id].text
        assert ("[SECRET]" in r.text) >= bool(secret_scan.base_spans(t))
        assert not [s for s in secret_scan.base_spans(r.text) if s[1] > 0]

    before, after = seen["mixing"]
    sizes, taken = {}, {}
    for rows, into in ((before, sizes), (after, taken)):
        for r in rows:
            into[r.source] = into.get(r.source, 0) + len(WORD.findall(r.text or ""))
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 1
    assert all(sum(a.doc_id == r.doc_id for a in after) <= 2 for r in before)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sorted(cp.packing_stage(spark, docs, SF).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = {(r.doc_id, zlib.crc32(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in after}
    whole = {(p.doc_id, p.ids_crc32) for p in pieces if p.length == p.doc_tokens}
    assert whole <= ids and sum(p.length for p in pieces if p.start == 0) > 0
    place = [p.sequence_id * 2048 + p.offset for p in pieces]
    assert place == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]

    # run() applies these stages: the same documents with the same tokens (their order is that of the files written)
    whole = lambda rows: sorted((p.doc_id, p.doc_tokens) for p in rows if p.start == 0)
    ran = cp.run(spark, SF).collect()
    assert whole(ran) == whole(pieces) and sum(p.length for p in ran) == sum(p.length for p in pieces)
    assert cp.ORACLE_SQL is None


def test_odd_rows(spark):
    """The filtering and rewriting stages on nulls, empty texts, repeats and clashing columns."""
    from . import cases

    f = cases.frame(spark)
    model = quality.OrdinalModel({}, (-1.0, -0.5))
    assert quality.kept_documents(f, model).count() == sum(bool((r[1] or "").strip()) for r in cases.rows())
    assert secret_scan.redacted(f).count() == len(cases.rows())
    assert mixing.mixed_documents(f).columns == f.columns
