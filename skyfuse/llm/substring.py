"""Removing passages that repeat across documents: suffix automata of reference shards, matching statistics, maximal spans.

A window is ``span`` consecutive words of a document.  Every window has an anchor, the least of the hashes of its
short word runs (rightmost of ties), so equal windows have equal anchors wherever they stand.  The consecutive
windows of a document with the same anchor make a segment, and an anchor's distinct segments make a reference shard.
Copies of a segment fold into one with the smallest document before anything else.  In a shard the segments stream by
document through a suffix automaton of all segments of smaller documents: where the matching statistic reaches
``span``, the window stands in a smaller document.  Shards are dealt to tasks rather than broadcast, since they grow
with the corpus; those of more than SHARD segments are resolved by exact window keys instead, pre-aggregated.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of the runs that anchors are chosen from.
GRAM = 10
#: Segments that a shard's automaton holds at most.
SHARD = 2048
BATCH_WORDS = 1 << 18
#: Words of a part of a longer text.
PART = 1 << 22
_BASE, _ODD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class WordHash(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 77)
        if len(word) <= 48:
            self[word] = h
        return h


def _powers(n: int, base: int):
    """base ** 0..n-1 mod 2 ** 64."""
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any runs of a list of word hashes, by one prefix sum."""

    def __init__(self, h):
        import numpy as np

        n, inverse = len(h), pow(_BASE, -1, 1 << 64)
        self.back = _powers(n + 1, inverse)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(n, _BASE), dtype=np.uint64)])

    def runs(self, at, length):
        import numpy as np

        x = (self.sum[at + length] - self.sum[at]) * self.back[at]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD)
        return x ^ (x >> np.uint64(29))


def segments(h, doc, span: int):
    """Arrays (doc, at, n, anchor, key) of the segments: n windows from word ``at`` of the list; h, doc: the words' hashes and documents (ascending)."""
    import numpy as np

    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    n = len(h)
    if n < span:
        return none
    roll, pos = Rolling(h), np.arange(n - GRAM + 1)
    gram = roll.runs(pos, GRAM)
    low = np.uint64((1 << 24) - 1)
    key = (gram & ~low) | (low - pos.astype(np.uint64))  # ties: the rightmost
    width, have = span - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    where = (low - (key & low)).astype(np.int64)  # of the anchor of each window
    good = doc[: n - span + 1] == doc[span - 1 :]
    first = np.flatnonzero(good & np.r_[True, (where[1:] != where[:-1]) | ~good[:-1]])
    last = np.flatnonzero(good & np.r_[(where[1:] != where[:-1]) | ~good[1:], True])
    count = last - first + 1
    return doc[first], first, count, gram[where[first]].view(np.int64), roll.runs(first, count + span - 1).view(np.int64)


class Automaton:
    """Suffix automaton of several word sequences, grown online."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w) -> int:
        c = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words) -> None:
        last, nxt, link, length = 0, self.next, self.link, self.length
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            new, p = self._state({}, 0, length[last] + 1), last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def matches(self, words, least: int) -> list[int]:
        """Ends (index of the last word) where the longest match with what was added has ``least`` words or more."""
        out, state, size, nxt, link, length = [], 0, 0, self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state, size = nxt[state][w], size + 1
            if size >= least:
                out.append(i)
        return out


def _ranges(at: list[int], span: int) -> list[tuple[int, int]]:
    """Ascending window starts -> word ranges (from, to) that they cover."""
    out: list[list[int]] = []
    for j in at:
        if out and j <= out[-1][1]:
            out[-1][1] = j + span
        else:
            out.append([j, j + span])
    return [tuple(x) for x in out]


def _found(docs: DataFrame, span: int) -> DataFrame:
    """Segments of every text: d, k (hash of the text), at, n, a (anchor), s (segment)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHash()

        def flush(ids, ks, words, sizes):
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            row = np.repeat(np.arange(len(sizes)), sizes)
            begin = np.r_[0, np.cumsum(sizes)]
            doc, at, n, a, s = segments(h, row, span)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[doc]), pa.array(np.array(ks, np.int64)[doc]), pa.array((at - begin[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(a), pa.array(s)], ["d", "k", "at", "n", "a", "s"])

        ids, ks, words, sizes = [], [], [], []
        for b in batches:
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = t.as_py().encode("utf-8", "surrogatepass").split()
                if len(w) < span:
                    continue
                if len(w) > PART:
                    # longer than positions reach: in parts that share all but one window's words, each with whole windows
                    yield from _long(i, k, w, span, hashes, PART)
                    continue
                if words and len(words) + len(w) > BATCH_WORDS:
                    yield from flush(ids, ks, words, sizes)
                    ids, ks, words, sizes = [], [], [], []
                ids.append(i)
                ks.append(k)
                words += w
                sizes.append(len(w))
        if ids:
            yield from flush(ids, ks, words, sizes)

    d = docs.where("d is not null and text is not null").select("d", "k", "text")
    return d.mapInArrow(run, "d long, k long, at int, n int, a long, s long")


def _long(i, k, words, span: int, hashes, step: int):
    """Segments of a very long text.  A part's last segment may go on, so the next part starts with its first window."""
    import numpy as np
    import pyarrow as pa

    at = 0
    while at + span <= len(words):
        h = np.fromiter(map(hashes.__getitem__, words[at : at + step]), np.uint64)
        _, first, n, a, s = segments(h, np.zeros(len(h), np.int64), span)
        keep = len(first) if at + step >= len(words) else max(1, len(first) - 1)
        if at + step < len(words) and len(first) < 2:
            keep = len(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(keep, i, np.int64)), pa.array(np.full(keep, k, np.int64)), pa.array((first[:keep] + at).astype(np.int32)), pa.array(n[:keep].astype(np.int32)), pa.array(a[:keep]), pa.array(s[:keep])], ["d", "k", "at", "n", "a", "s"])
        if at + step >= len(words):
            return
        at += int(first[keep]) if keep < len(first) else int(first[-1] + n[-1])


def _removed(words: list[bytes], spans) -> tuple[int, str]:
    """Number of removed words, and the digest of the kept ones."""
    gone = bytearray(len(words))
    for lo, hi in spans:
        gone[lo:hi] = b"\x01" * (hi - lo)
    kept = [w for w, x in zip(words, gone, strict=True) if not x] if spans else words
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def deduplicated_spans(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges [from, to), ascending).

    A word goes if a window of ``span`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input.  Null texts hold no words.  Rows with a null id keep all words and are no source; rows that
    share an id don't remove each other's.  An empty table gives none.
    """
    d = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("text"))
    every = materialize(_found(d, span), "sub-segments")
    # anchors in two documents at least, and whether their segments differ
    anchors = every.groupBy("a").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    anchors = materialize(anchors.where("lo < hi").select("a", (F.col("s0") < F.col("s1")).alias("many")), "sub-anchors")
    shared = materialize(every.join(anchors, "a"), "sub-shared")
    first = materialize(shared.groupBy("a", "s").agg(F.min("d").alias("m")), "sub-first")
    marked = shared.join(first, ["a", "s"])
    # copies of a segment of a smaller document go whole; first ones of an anchor with others are looked at
    info = marked.where("d > m or many").select("d", "k", F.struct("at", "n", (F.col("d") > F.col("m")).alias("whole"), "a", "s").alias("seg"))
    info = info.distinct().groupBy("d", "k").agg(F.collect_list("seg").alias("segs"))  # repeats of a row have its segments once
    joined = d.join(info, ["d", "k"], "left")

    def settle(batches):
        """Final rows where nothing is open, else the text with its spans and its open segments with their words."""
        import pyarrow as pa

        for b in batches:
            out = []
            for i, t, segs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                spans = [(x["at"], x["at"] + x["n"] + span - 1) for x in segs or [] if x["whole"]]
                look = [{"at": x["at"], "a": x["a"], "s": x["s"], "words": b" ".join(w[x["at"] : x["at"] + x["n"] + span - 1])} for x in segs or [] if not x["whole"]]
                merged = _merge(spans)
                if look:
                    out.append((i, len(w), None, None, _structs(merged), t.as_py(), look))
                else:
                    out.append((i, len(w), *_removed(w, merged), _structs(merged), None, None))
            yield _batch(out, kinds)

    span_kind = "array<struct<lo:int,hi:int>>"
    schema = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {span_kind}, text string, open array<struct<at:int,a:long,s:long,words:binary>>"
    kinds = _kinds()
    state = materialize(joined.select("d", "text", "segs").mapInArrow(settle, schema), "sub-state")
    wait = state.where("open is not null")
    pieces = wait.select("doc_id", F.explode("open").alias("o")).select(F.col("doc_id").alias("m"), "o.a", "o.s", "o.words")
    # one row for each distinct segment; of copies in one document any
    pieces = materialize(pieces.groupBy("a", "s").agg(F.min("m").alias("m"), F.first("words").alias("words")), "sub-pieces")
    hot = materialize(pieces.groupBy("a").count().where(F.col("count") > SHARD).select("a"), "sub-hot")
    cold = pieces.join(F.broadcast(hot) if hot.count() < 100_000 else hot, "a", "left_anti")

    def stream(batches):
        """Shards follow each other, segments by document: match against what smaller documents gave, then add."""
        import pyarrow as pa

        now, auto, same, doc = None, None, [], None
        for b in batches:
            out = []
            for a, s, m, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a != now:
                    now, auto, same, doc = a, Automaton(), [], m
                if m != doc:
                    for x in same:
                        auto.add(x)
                    same, doc = [], m
                w = words.split(b" ")
                if len(auto.next) > 1 and (ends := auto.matches(w, span)):
                    out.append((a, s, _structs(_ranges([e - span + 1 for e in ends], span))))
                same.append(w)
            c = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], kinds[4][1])], ["a", "s", "got"])

    got = cold.select("a", "s", "m", "words").repartition("a").sortWithinPartitions("a", "m", "s").mapInArrow(stream, f"a long, s long, got {span_kind}")
    if hot.head(1):
        got = got.unionByName(_by_window(pieces.join(F.broadcast(hot) if hot.count() < 100_000 else hot, "a", "left_semi"), span))
    got = materialize(got, "sub-matches")
    hits = wait.select("doc_id", F.xxhash64("text").alias("k"), F.explode("open").alias("o")).select("doc_id", "k", "o.at", "o.a", "o.s").distinct().join(got, ["a", "s"])
    hits = hits.select("doc_id", "k", F.explode(F.transform("got", lambda g: F.struct((g["lo"] + F.col("at")).alias("lo"), (g["hi"] + F.col("at")).alias("hi")))).alias("g"))
    hits = hits.groupBy("doc_id", "k").agg(F.collect_list("g").alias("more"))
    last = wait.select("doc_id", F.xxhash64("text").alias("k"), "text", "spans").join(hits, ["doc_id", "k"], "left").select("doc_id", "text", "spans", "more")

    def finish(batches):
        for b in batches:
            out = []
            for i, t, spans, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = t.encode("utf-8", "surrogatepass").split()
                merged = _merge([(x["lo"], x["hi"]) for x in spans + (more or [])])
                out.append((i, len(w), *_removed(w, merged), _structs(merged)))
            yield _batch(out, kinds[:5])

    result = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {span_kind}"
    return state.where("open is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans").unionByName(last.mapInArrow(finish, result))


def _by_window(pieces: DataFrame, span: int) -> DataFrame:
    """Matches of shards too large for an automaton: every window by a 128-bit key, its smallest document pre-aggregated."""

    def run(batches):
        for b in batches:
            out = []
            for a, s, m, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words.split(b" ")
                for j in range(len(w) - span + 1):
                    h = hashlib.blake2b(b" ".join(w[j : j + span]), digest_size=16).digest()
                    out.append((a, s, m, j, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)))
                    if len(out) >= 1 << 16:
                        yield _batch(out, _window_kinds())
                        out = []
            yield _batch(out, _window_kinds())

    w = materialize(pieces.select("a", "s", "m", "words").mapInArrow(run, "a long, s long, m long, j int, h1 long, h2 long"), "sub-windows")
    least = materialize(w.groupBy("h1", "h2").agg(F.min("m").alias("least")), "sub-windows-first")
    hit = w.join(least, ["h1", "h2"]).where("least < m")
    return hit.groupBy("a", "s").agg(F.collect_list(F.struct(F.col("j").alias("lo"), (F.col("j") + span).alias("hi"))).alias("got"))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _structs(spans) -> list[dict]:
    return [{"lo": lo, "hi": hi} for lo, hi in spans]


def _kinds():
    import pyarrow as pa

    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    look = pa.list_(pa.struct([("at", pa.int32()), ("a", pa.int64()), ("s", pa.int64()), ("words", pa.binary())]))
    return [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", spans), ("text", pa.string()), ("open", look)]


def _window_kinds():
    import pyarrow as pa

    return [("a", pa.int64()), ("s", pa.int64()), ("m", pa.int64()), ("j", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]


def _batch(rows, kinds):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])
