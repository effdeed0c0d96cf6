"""Quality by ordinal cumulative-link regression: hashed-text weights shared by all grades, and ordered thresholds.

P(grade <= k | x) = logistic(t_k - w.x).  Grades: 0 low quality, 1 fair text with toxic words, 2 clean.  A text's
features are its distinct words (lower-cased, outer punctuation dropped), the shapes of its words' outer
punctuation and case, and binned shares over the whole text (distinct words, letters, capitals), all hashed into
one weight vector.  The fit sees a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit uses at most (those of the smallest hash), a documented bound.
FIT_ROWS = 12_000
BITS = 22
#: Least probability of the highest grade that a kept text has.
KEEP_FROM = 0.6
EDGE = re.compile(r"\W*")


MASK = (1 << BITS) - 1


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & MASK


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one word: its core, the beginnings of long cores (families of words), and its shape where that is unusual."""
    if word.isalpha():
        head, core, tail = "", word, ""
    else:
        head, end = EDGE.match(word)[0], len(word)
        while end > len(head) and not (word[end - 1].isalnum() or word[end - 1] == "_"):
            end -= 1
        core, tail = word[len(head) : end], word[end:]
    low = core.lower()
    out = [zlib.crc32(low.encode("utf-8", "surrogatepass")) & MASK] if low else []
    if len(low) > 5:
        out += [zlib.crc32(low[:k].encode("utf-8", "surrogatepass"), 7) & MASK for k in (3, 4, 5, 6)]
    case = "U" if len(core) > 1 and core.isupper() else "d" if core.isdigit() else "" if core else "-"
    if head or case or tail not in ("", ",", "."):
        out.append(_hash(f"s:{head}_{tail}|{case}"))
    return tuple(out)


class Features(dict):
    """word -> its features, of those that the model weighs if it is given; bounded."""

    def __init__(self, weighed: set[int] | None = None):
        self.weighed = weighed

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        v = word_features(word)
        if self.weighed is not None:
            v = tuple(f for f in v if f in self.weighed)
        if len(word) <= 48:
            self[word] = v
        return v


def text_features(text: str | None, of: Features) -> set[int]:
    words = (text or "").split()
    seen = set(words)
    out = set()
    for w in seen:
        out.update(of[w])
    if words:
        n = len(text)
        ratio = {"distinct": len(seen) / len(words), "upper": sum(1 for w in seen if w.isupper() and len(w) > 1) / len(seen), "edge": sum(1 for w in seen if not w[-1].isalnum()) / len(seen), "alone": sum(1 for w in seen if not w.isalnum() and not any(map(str.isalnum, w))) / len(seen), "length": min(1.0, n / len(words) / 20)}
        size = min(6, int(math.log2(len(words) + 1) / 2))
        out.update(_hash(f"r:{k}:{size}:{int(v * 10)}") for k, v in ratio.items())
        out.update(_hash(f"r:{k}:{int(v * 20)}") for k, v in ratio.items())
    return out


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[int, float]  # of the telling features
    thresholds: tuple[float, ...]

    def score(self, features) -> float:
        get = self.weights.get
        return sum(w for f in sorted(features) if (w := get(f)))

    def probabilities(self, z: float) -> list[float]:
        """Of each grade."""
        at = [1 / (1 + math.exp(-max(-50.0, min(50.0, t - z)))) for t in self.thresholds]
        return [b - a for a, b in zip([0.0, *at], [*at, 1.0], strict=True)]


def telling(y, flat, row, n: int, grades: int, strength: float = 20.0):
    """Features 0..n-1 whose presence tells a grade from those above it: a chi-squared of one degree over each cut, corrected for continuity.

    Rare words that come with a grade by chance don't pass.  Nor do words that speak for a higher grade: long clean
    texts hold many of those, and their sum would hide what a text is marked down for.
    """
    import numpy as np

    found = np.zeros(n, bool)
    for cut in range(grades - 1):
        for low, high in (((y <= cut), (y > cut)), ((y == cut), (y == cut + 1))):
            n0, n1 = int(low.sum()), int(high.sum())
            if not n0 or not n1:
                continue
            a = np.bincount(flat[low[row]], minlength=n).astype(float)
            b = np.bincount(flat[high[row]], minlength=n).astype(float)
            c, d, m = n0 - a, n1 - b, n0 + n1
            chi = m * np.maximum(0, np.abs(a * d - b * c) - m / 2) ** 2 / np.maximum(1, (a + b) * (c + d) * n0 * n1)
            found |= (chi >= strength) & (a * n1 > b * n0)
    return found


def fit_ordinal(y, sizes, flat, grades: int = 3, epochs: int = 60, rate: float = 1.0, l2: float = 1e-5, least: int = 4, seed: int = 3) -> OrdinalModel:
    """Maximum likelihood over the telling features by AdaGrad in mini-batches.

    Arrays: the rows' grades, their numbers of features, and all rows' feature ids one after the other.  Features of
    fewer than ``least`` rows are left out.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    t = np.linspace(-1.0, 1.0, grades - 1)
    t2 = np.full(grades - 1, 1e-2)
    if not len(y):
        return OrdinalModel({}, tuple(t.tolist()))
    ids = np.flatnonzero(np.bincount(flat, minlength=1) >= least)
    new = np.full(int(flat.max(initial=0)) + 1, -1, np.int32)
    new[ids] = np.arange(len(ids), dtype=np.int32)
    of, flat = np.repeat(np.arange(len(y), dtype=np.int32), sizes), new[flat]
    of, flat = of[flat >= 0], flat[flat >= 0]
    told = telling(y, flat, of, len(ids), grades)
    of, flat = of[told[flat]], flat[told[flat]]
    sizes = np.bincount(of, minlength=len(y))
    start = np.r_[0, np.cumsum(sizes)]
    w, g2 = np.zeros(len(ids)), np.full(len(ids), 1e-4)
    share = np.maximum(np.bincount(y, minlength=grades), 1) / len(y)
    weight = (1 / share) ** 0.5
    weight /= (weight * share).sum()
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            b = order[at : at + 64]
            row = np.repeat(np.arange(len(b)), sizes[b])
            idx = flat[np.arange(len(row)) - np.repeat(np.cumsum(sizes[b]) - sizes[b], sizes[b]) + np.repeat(start[b], sizes[b])]
            z = np.bincount(row, w[idx], minlength=len(b))
            edge = np.r_[-60.0, t, 60.0]
            hi, lo = logistic(edge[y[b] + 1] - z), logistic(edge[y[b]] - z)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            c = weight[y[b]]
            dz = c * (dhi - dlo)  # of the negative log-likelihood
            hit, at_hit = np.unique(idx, return_inverse=True)
            gh = np.bincount(at_hit, dz[row], minlength=len(hit)) / len(b) + l2 * w[hit]
            g2[hit] += gh * gh
            w[hit] -= rate * gh / np.sqrt(g2[hit])
            gt = np.zeros(grades - 1)
            for k in range(grades - 1):
                gt[k] = (-(c * dhi)[y[b] == k].sum() + (c * dlo)[y[b] == k + 1].sum()) / len(b)
            t2 += gt * gt
            t -= rate * gt / np.sqrt(t2)
            t = np.maximum.accumulate(t + np.arange(grades - 1) * 1e-6)  # thresholds stay in order
    used = np.flatnonzero(w)
    return OrdinalModel(dict(zip(ids[used].tolist(), w[used].tolist(), strict=True)), tuple(float(x) for x in t))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (doc_id, grade): 0 low quality, 1 toxic, 2 clean; rows with nulls are left out."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``fit_rows`` labelled documents, those whose doc_id hashes smallest.

    Label rows with a null are left out.  Of rows that share an id, documents or labels, one counts: the lowest grade,
    then the smallest features.  Null and empty texts are rows without features.  Without labelled documents the model
    has no weights, and its thresholds are -1 and 1.
    """
    sample = graded(labels).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "grade").limit(fit_rows)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        import pyarrow as pa

        of = Features()
        for batch in batches:
            feats = [sorted(text_features(t.as_py(), of)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])

    got = d.mapInArrow(run, "doc_id long, grade int, features array<int>")
    one = F.min(F.struct("grade", "features")).alias("m")  # ids may repeat in documents
    got = got.groupBy("doc_id").agg(one).select("doc_id", "m.grade", "m.features").toArrow()  # fit_rows at most
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    feats = got["features"].combine_chunks()
    return fit_ordinal(got["grade"].to_numpy(), feats.value_lengths().to_numpy(zero_copy_only=False), feats.flatten().to_numpy())


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, extra: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, score, expected_grade, tail_prob = P(grade is the highest), keep = tail_prob >= keep_from.

    A null, empty or white text has no features and is not kept.  Repeated rows come each, an empty table gives none.
    Long texts are read whole; the memory they need is that of their distinct words.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))  # telling features of a bounded sample
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]

    def run(batches):
        import pyarrow as pa

        weights, thresholds = sent.value
        m = OrdinalModel(weights, thresholds)
        of = Features(set(weights))
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                if not (text and text.strip()):
                    rows.append((0.0, 0.0, 0.0, False))
                    continue
                z = m.score(text_features(text, of))
                p = m.probabilities(z)
                rows.append((z, sum(k * q for k, q in enumerate(p)), p[-1], p[-1] >= keep_from))
            c = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c[0], pa.float64()), pa.array(c[1], pa.float64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.bool_())], ["doc_id", "score", "expected_grade", "tail_prob", "keep"])

    return docs.select(*cols).mapInArrow(run, "doc_id long, score double, expected_grade double, tail_prob double, keep boolean")


def kept_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns as they are, in one pass without a shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        weights, thresholds = sent.value
        m = OrdinalModel(weights, thresholds)
        of = Features(set(weights))
        for batch in batches:
            keep = []
            for t in batch.column(at):
                text = t.as_py()
                keep.append(bool(text and text.strip()) and m.probabilities(m.score(text_features(text, of)))[-1] >= keep_from)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
