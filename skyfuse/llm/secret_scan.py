"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

Candidates are runs of 20 and more key characters with digits or mixed case.  Each is read in the smallest encoding
that has all its characters, and tested for uniform use of the alphabet (chi-squared), runs about the alphabet's
middle, and serial correlation; Fisher's method combines the three into one p-value of "this is random".  Random
strings have p uniform on 0..1, names and words pile up near 0.  So in each stratum of encoding and length, twice
the number with p > 1/2 estimates the random ones, and the least cut is taken at which the estimated share of
others above it is at most ``fdr``.  Short strings, which the tests can hardly tell apart, so need more.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("assign", "access", "hex", "random")
#: The base patterns (fixed values) and the least length of what they must hold.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ of 16 and more
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Encodings by alphabet, smallest first (fixed values).
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (DIGIT, DIGIT + "abcdef", DIGIT + "ABCDEF", UPPER + "234567", DIGIT + LOWER, DIGIT + UPPER, UPPER + LOWER, UPPER + LOWER + DIGIT, UPPER + LOWER + DIGIT + "+/", UPPER + LOWER + DIGIT + "-_", UPPER + LOWER + DIGIT + "+/-_")
_INDEX = tuple({c: k for k, c in enumerate(a)} for a in ENCODINGS)
_SETS = tuple(map(frozenset, ENCODINGS))
BINS = 200


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(s: str) -> int | None:
    """Index of the smallest encoding, or None for plain words: letters of one case, or with a capital only in front."""
    if s.isalpha() and (s[1:].islower() or s.isupper()):
        return None
    have = set(s)
    return next((k for k, a in enumerate(_SETS) if have <= a), None)


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by Wilson and Hilferty."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(s: str, enc: int) -> float:
    """Combined p-value of the battery for a string in its encoding."""
    x, k, n = [_INDEX[enc][c] for c in s], len(ENCODINGS[enc]), len(s)
    cells = max(2, min(k, n // 5))
    count = [0] * cells
    for v in x:
        count[v * cells // k] += 1
    width = [0] * cells
    for v in range(k):
        width[v * cells // k] += 1
    p1 = _chi_tail(sum((c - n * w / k) ** 2 / (n * w / k) for c, w in zip(count, width, strict=True)), cells - 1)
    up = [2 * v >= k for v in x]
    a = sum(up)
    b = n - a
    if a == 0 or b == 0:
        p2 = 1e-12
    else:
        runs = 1 + sum(u != v for u, v in zip(up, up[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1e-12
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    r = sum((u - m) * (v - m) for u, v in zip(x, x[1:], strict=False)) / power if power else 1.0
    p3 = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    h = -sum(math.log(max(p, 1e-12)) for p in (p1, p2, p3))
    return min(1.0, math.exp(-h) * (1 + h + h * h / 2))


def length_bin(n: int) -> int:
    return int(2 * math.log2(n))


def candidates(text: str) -> list[tuple[int, int, int, int, float]]:
    """(start, end, encoding, length bin, p) of the runs that are tested."""
    out = []
    for m in RUN.finditer(text):
        s = m[0].rstrip("=")
        if (enc := encoding(s)) is not None:
            out.append((m.start(), m.end(), enc, length_bin(len(s)), randomness(s, enc)))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one, in place: (doc_id, base, tested)."""

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        tests = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("enc", pa.int32()), ("len", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            base, tested = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append([dict(zip("ske", x, strict=True)) for x in base_spans(text)])
                tested.append([dict(zip(("s", "e", "enc", "len", "p"), x, strict=True)) for x in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(tested, tests)], ["doc_id", "base", "tested"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, base array<struct<s:int,k:int,e:int>>, tested array<struct<s:int,e:int,enc:int,len:int,p:double>>")


def cuts(histogram: dict[tuple[int, int], dict[int, int]], fdr: float) -> dict[tuple[int, int], float]:
    """Least p for a find, by stratum; strata without evidence of random strings have none."""
    out = {}
    for stratum, bins in histogram.items():
        above = [0] * (BINS + 1)
        for b in range(BINS - 1, -1, -1):
            above[b] = above[b + 1] + bins.get(b, 0)
        random = 2 * max(0, above[BINS // 2] - 1)  # one less, against chance
        for b in range(BINS):
            if above[b] and 1 - random * (1 - b / BINS) / above[b] <= fdr and random:
                out[stratum] = b / BINS
                break
    return out


def learned_cuts(rows: DataFrame, fdr: float) -> dict[tuple[int, int], float]:
    """Cuts from the histogram of p over all texts: at most 11 encodings x 64 length bins x BINS counts reach the driver, whatever the input."""
    t = rows.select(F.explode("tested").alias("t")).select("t.enc", "t.len", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    hist: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for enc, length, b, n in t.groupBy("enc", "len", "bin").count().collect():
        hist[enc, length][b] = n
    return cuts(hist, fdr)


def random_spans(tested, base, least: dict[tuple[int, int], float]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the tested runs that reach their cut and lie in no base span."""
    good = [(s, e) for s, e, enc, length, p in tested if p >= least.get((enc, length), 2.0)]
    return [(s, 3, e) for s, e in good if not any(b[0] <= s and e <= b[2] for b in base)]


def spans(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and found (arrays of (s, k, e), k an index of KINDS; code points, end exclusive)."""
    rows = materialize(scan(docs, id_col, text_col), "secret-scan")
    least = learned_cuts(rows, fdr)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            found = []
            for base, tested in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = random_spans([tuple(x.values()) for x in tested], [tuple(x.values()) for x in base], least)
                found.append([dict(zip("ske", x, strict=True)) for x in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(kind), pa.array(found, kind)], ["doc_id", "base", "found"])

    span = "array<struct<s:int,k:int,e:int>>"
    return rows.select("doc_id", "base", "tested").mapInArrow(run, f"doc_id long, base {span}, found {span}")


def report(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans read kind:start:end, by start, then kind as listed, comma-joined.  Null texts are empty; repeated rows
    come each; an empty table gives none.
    """
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])), ",")
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    every = F.sort_array(F.concat("base", "found"))
    return spans(docs, fdr, id_col, text_col).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"), F.size("found").cast("long").alias("n_random"))


def redact(text: str, found: list[tuple[int, int]], mark: str) -> str:
    """Each maximal union of spans becomes ``mark``."""
    out, at = [], 0
    for s, e in sorted(found):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, fdr: float = 0.05, mark: str = "[SECRET]", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with every span replaced by ``mark``; ``n_chars_col`` follows where it exists.

    Two passes in place, without a shuffle of texts: the first learns the cuts, the second finds and replaces.
    """
    least = learned_cuts(scan(docs.withColumn("_id", F.lit(0)), "_id", text_col), fdr)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), False
            for k, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    got = base + random_spans(candidates(text), base, least)
                    if got:
                        texts[k], changed = redact(text, [(s, e) for s, _, e in got], mark), True
            if changed:
                cols = list(batch.columns)
                if n_at is not None:
                    old = batch.column(at).to_pylist()
                    n = [len(t) if t is not None and t != o else x for t, o, x in zip(texts, old, cols[n_at].to_pylist(), strict=True)]
                    cols[n_at] = pa.array(n, cols[n_at].type)
                cols[at] = pa.array(texts, cols[at].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
