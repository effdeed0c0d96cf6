"""SimHash near-duplicates: fingerprints, bit-sliced comparison within radius, components.

Distinct fingerprints (exact copies fold into one) meet in buckets: of radius + 2 blocks of the bits, two
fingerprints within the radius agree on at least two, so each goes to one bucket for every pair of blocks.  Buckets
too large for that are dealt again by pairs of blocks of what is left, which bounds them.  In a bucket the bit
planes of all fingerprints stand vertically, as integers with one bit for each fingerprint; shifting them by k
lines every fingerprint up with its k-th neighbour, carry-save counters add up the differing bits of all such pairs
at once, and a shift is abandoned as soon as every pair exceeds the radius.

``similar_deduplicated`` holds documents to a Jaccard similarity of their shingles instead.  Its buckets are shingles:
under any common order of these, two sets of the similarity or more share one among the first n - ceil(least n) + 1 of
each, so no such pair misses the other.  The order puts shingles that are common in a bounded sample last, which keeps
the buckets small; what it is has no bearing on the result.  In a bucket the same bit-sliced comparison, at a radius
far over that of similar sets, tells what is worth looking at, and that is settled on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import drop
from .common import byte_words, materialize
from ..operators.components import components

#: A bucket up to this many distinct fingerprints is compared whole; larger ones are dealt again.
BUCKET = 1 << 14
#: Runs of up to this many share one pass over the planes.
SHORT_RUN = 48
#: Bounds of what orders the shingles: sets sampled, shingles taken for common, and how often those come in the sample.
SAMPLE, COMMON, OFTEN = 2_000, 50_000, 4
#: Sets of fewer shingles are verified at any distance: their fingerprints are made of too few votes.
FEW = 24
#: Sets of Jaccard 0.8 lie 10 bits of 64 apart (standard deviation 2.9), so this is 5.7 deviations off; unrelated ones lie at 32.
WIDE = 26
#: Bins of the sketch that pairs are told by before they are verified, and the standard deviations that it may err.
BINS, ERR = 128, 5.5
#: Shingles of a group that one task settles (about 30 bytes each there).
MOST_GRAMS = 4_000_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles (repeats included); 0 for a text without words."""
    import numpy as np
    import xxhash

    votes, n, carry = np.zeros(64, np.int64), 0, []
    hash64 = xxhash.xxh64_intdigest
    for part in byte_words((text or "").encode("utf-8", "surrogatepass").lower()):
        w = carry + part
        m = len(w) - words + 1
        if m > 0:
            h = np.fromiter((hash64(s, seed) for s in map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))), np.uint64, m)
            for at in range(0, m, 1 << 14):
                votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += m
        carry = w[-(words - 1) :] if words > 1 else []
    if n == 0:
        return hash64(b" ".join(carry), seed) if carry else 0
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, k1, k2, fp): fp the fingerprint as a signed long, k1 and k2 a hashed key of id and text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps)], ["doc_id", "k1", "k2", "fp"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_key(id_col, text_col, "k1", "k2"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _over(planes: list[int], shift: int, alive: int, radius: int, size: int) -> int:
    """Bits of the pairs (i, i + shift) within the radius; alive: the pairs to look at."""
    full = (1 << size) - 1
    count = [0] * (radius + 1).bit_length()  # carry-save counters, low bit first
    for k, p in enumerate(planes):
        d = (p ^ (p >> shift)) & alive
        for c in range(len(count)):
            count[c], d = count[c] ^ d, count[c] & d
            if not d:
                break
        else:
            alive &= ~d & full  # counted past the counters
        if k % 4 == 3 or k + 1 == len(planes):
            above, equal = 0, alive  # counters compared with the radius, high bit first
            for c in range(len(count) - 1, -1, -1):
                if radius >> c & 1:
                    equal &= count[c]
                else:
                    above |= equal & count[c]
                    equal &= ~count[c]
            alive &= ~above
            if not alive:
                return 0  # every pair exceeds the radius
    return alive


def pairs_within(fps, run_ids, radius: int, any_far=None):
    """Arrays (i, j), shift by shift: the pairs within the radius inside each run of equal run_ids (both arrays in run order); ``any_far`` marks i of which all pairs count."""
    import numpy as np

    n = len(fps)
    if n < 2:
        return
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(np.packbits(bits[:, k], bitorder="little").tobytes(), "little") for k in range(64) if bits[:, k].any() and not bits[:, k].all()]
    longest = int(np.bincount(np.unique(run_ids, return_inverse=True)[1]).max())
    every = 0 if any_far is None else int.from_bytes(np.packbits(any_far, bitorder="little").tobytes(), "little")
    for shift in range(1, longest):
        same = np.zeros(n, bool)
        same[: n - shift] = run_ids[shift:] == run_ids[:-shift]
        alive = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        if alive and (hit := (_over(planes, shift, alive, radius, n) if planes else alive) | alive & every):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(hit.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n))
            yield at, at + shift


def linked(fps, run_ids, radius: int, any_far=None, also=None):
    """Spanning links (i, j) of the fingerprints within the radius inside each run of equal run_ids (both arrays in run order); ``also`` tells which of the pairs (i, j) not joined yet may link."""
    import numpy as np

    label, out = np.arange(len(fps)), []

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at, to in pairs_within(fps, run_ids, radius, any_far):
        if also is not None:
            while (label != label[label]).any():
                label = label[label]
        apart = label[at] != label[to]
        at, to = at[apart], to[apart]
        if also is not None and len(at):
            ok = also(at, to)
            at, to = at[ok], to[ok]
        for i, j in zip(at.tolist(), to.tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


def by_runs(placed: DataFrame, keys: int, compare, schema: str = "a long, b long") -> DataFrame:
    """``compare(run numbers, other columns)`` over whole runs of the first ``keys`` columns, by which the rows stand together: short runs many at a time, long ones each."""

    def run(batches):
        import numpy as np

        def whole(cols):
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)])
            size = np.diff(np.r_[new, len(cols[0])])
            rid = np.repeat(np.arange(len(new)), size)
            short = (size[rid] <= SHORT_RUN) & (size[rid] > 1)
            groups = [np.flatnonzero(short)] + [np.arange(a, a + s) for a, s in zip(new[size > SHORT_RUN], size[size > SHORT_RUN], strict=True)]
            for g in groups:
                if len(g) > 1:
                    yield from compare(rid[g], [c[g] for c in cols[keys:]])

        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero(np.any([c != c[-1] for c in now[:keys]], axis=0))
            end = last[-1] + 1 if len(last) else 0  # the last run may go on in the next batch
            yield from whole([x[:end] for x in now]) if end else ()
            held = [x[end:] for x in now]
        if held is not None:
            yield from whole(held)

    return placed.mapInArrow(run, schema)


def _keys(fp, lo_bits: int, blocks: int, agree: int, base):
    """Array of structs (table, key): the bits of each choice of ``agree`` blocks of the low ``lo_bits`` bits."""
    cut = [lo_bits * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, cut[k]).bitwiseAND(F.lit((1 << (cut[k + 1] - cut[k])) - 1)) for k in range(blocks)]
    out = []
    for t, choice in enumerate(combinations(range(blocks), agree)):
        key = F.lit(0).cast("long")
        for k in choice:
            key = F.shiftleft(key, cut[k + 1] - cut[k]).bitwiseOR(part[k])
        out.append(F.struct((base + t).cast("int").alias("table"), key.alias("key")))
    return F.array(*out)


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """distinct(fp) -> links (a, b) that span, in every bucket, what is linked in it; the union of all buckets holds each component whole."""
    blocks = radius + 2
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), 64, blocks, 2, F.lit(0))).alias("k")).select("k.table", "k.key", "fp")
    large = materialize(keyed.groupBy("table", "key").count().where(F.col("count") > BUCKET).select("table", "key"), "sim-large")
    if large.head(1):
        # bits outside the agreed blocks still hold all differences: deal by pairs of blocks of all bits, finer cut
        fine = 2 * blocks
        refined = keyed.join(large, ["table", "key"], "left_semi").withColumn("k2", F.explode(_keys(F.col("fp"), 64, fine, fine - radius, F.lit(0))))
        refined = refined.select((F.lit(1000) + F.col("k2.table")).alias("table"), F.xxhash64("table", "key", "k2.table", "k2.key").alias("key"), "fp")
        keyed = keyed.join(large, ["table", "key"], "left_anti").unionByName(refined)

    def compare(runs, cols):
        import pyarrow as pa

        if len(links := linked(cols[0], runs, radius)):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][links[:, 0]]), pa.array(cols[0][links[:, 1]])], ["a", "b"])

    return by_runs(keyed.repartition("table", "key").sortWithinPartitions("table", "key", "fp"), 2, compare)


def _key(id_col: str, text_col: str, a: str, b: str) -> list:
    """A row's hashed key of id and text, as columns a and b."""
    return [F.xxhash64(id_col, text_col).alias(a), F.xxhash64(text_col, F.lit("sim"), id_col).alias(b)]


def _first_rows(docs: DataFrame, stay: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each key in stay(k1, k2); the texts are shuffled once."""
    d = docs.select(F.struct("*").alias("row"), *_key(id_col, text_col, "k1", "k2")).join(materialize(stay, "sim-stay"), ["k1", "k2"])
    return d.withColumn("one", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).where("one = 1").select("row.*")


def _grouped(docs: DataFrame, radius: int, words: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprint rows, and (fp, root, component_id) for each distinct fingerprint."""
    rows = materialize(fingerprints(docs, words, seed, id_col, text_col), "sim-prints")
    by_fp = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "sim-distinct")
    parts = components(near_links(by_fp.select("fp"), radius))
    of = by_fp.join(parts, by_fp.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "sim-roots")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, materialize(of.join(ids, "root").select("fp", "root", "component_id"), "sim-components")


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most ``radius`` bits.

    Null texts are empty: fingerprint zero, linked like any other.  Null ids count for no component_id (it is null
    where no row of the component has one).  Repeated rows come each; an empty table gives none.
    """
    rows, of = _grouped(docs, radius, words, seed, id_col, text_col)
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id (nulls last); all columns as they are.

    Of rows alike in id and text one stays.  The texts are shuffled once, by a hashed key of id and text.
    """
    rows, of = _grouped(docs, radius, words, seed, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("f")
    stay = rows.join(of, "fp").groupBy("root").agg(first).select(F.col("f.k1").alias("k1"), F.col("f.k2").alias("k2"))
    return _first_rows(docs, stay, id_col, text_col)


def shingles(text: str | None, words: int = 5, seed: int = 42):
    """Sorted distinct 64-bit hashes of the word shingles (ASCII lower case); a shorter text is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    hash64, carry, out = xxhash.xxh64_intdigest, [], []
    for part in byte_words((text or "").encode("utf-8", "surrogatepass").lower()):
        w = carry + part
        m = len(w) - words + 1
        if m > 0:
            out.append(np.fromiter((hash64(s, seed) for s in map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))), np.uint64, m))
        carry = w[-(words - 1) :] if words > 1 else []
    if not out and carry:
        out.append(np.array([hash64(b" ".join(carry), seed)], np.uint64))
    return np.unique(np.concatenate(out).view(np.int64)) if out else np.zeros(0, np.int64)


def prefix(grams, common, least: tuple[int, int]):
    """The first n - ceil(least n) + 1 shingles: those that aren't in ``common`` (sorted hashes, and their places) by hash, then the others by place."""
    import numpy as np

    n = len(grams)
    if not n:
        return grams
    size = n + (-least[0] * n) // least[1] + 1
    hashes, places = common
    if not len(hashes):
        return grams[:size]
    at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
    known = hashes[at] == grams
    if not known.any():
        return grams[:size]
    late = grams[known][np.argsort(places[at[known]])]
    return np.concatenate([grams[~known], late])[:size]


def _common(docs: DataFrame, words: int, id_col: str, text_col: str):
    """(hashes, places) of the shingles that are common in a sample, the rarer first; sorted by hash."""
    import numpy as np

    every = max(1, docs.count() // SAMPLE)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words))], ["g"])

    seen = docs.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(every)) == 0).select(F.col(text_col).alias("text"))
    seen = seen.mapInArrow(run, "g long").groupBy("g").count().where(F.col("count") >= OFTEN)
    top = seen.orderBy(F.desc("count"), "g").limit(COMMON).collect()  # bounded
    g = np.array([r.g for r in reversed(top)], np.int64)
    order = np.argsort(g)
    return g[order], order


def _sets(docs: DataFrame, words: int, least: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, k1, k2, s, n, fp, bins, first): k1 and k2 a hashed key of id and text, s a hash of the set of shingles, n its size, fp its fingerprint, bins its sketch, first its prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, words, id_col, text_col))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            k = 0
            while k < batch.num_rows:
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), words) for t in part.column(3)]
                s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                fp = np.array([_votes(x) for x in sets], np.uint64).view(np.int64)
                first = [prefix(x, sent.value, least) for x in sets]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in first])], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(s), pa.array([len(x) for x in sets], pa.int32()), pa.array(fp), pa.array([sketch(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first)))], ["doc_id", "k1", "k2", "s", "n", "fp", "bins", "first"])
                k += 256

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_key(id_col, text_col, "k1", "k2"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, k1 long, k2 long, s long, n int, fp long, bins binary, first array<long>")


def _votes(hashes) -> int:
    """Unsigned fingerprint of a set of hashes."""
    import numpy as np

    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def sketch(hashes) -> bytes:
    """One-permutation MinHash of a sorted set: for each of BINS values of the low bits, 16 bits of the least hash (0: none)."""
    import numpy as np

    out, h = np.zeros(BINS, "<u2"), hashes.view(np.uint64)
    bins, first = np.unique(h % np.uint64(BINS), return_index=True)
    out[bins.astype(np.int64)] = np.maximum(1, h[first] >> np.uint64(20) & np.uint64(0xFFFF))
    return out.tobytes()


def _met(rows: DataFrame) -> DataFrame:
    """(g, s, n, fp, size): the distinct sets that meet another at shingle g of both prefixes, and how many meet there."""
    p = rows.where("n > 0").select("s", "n", "fp", "first").dropDuplicates(["s"]).select("s", "n", "fp", F.explode("first").alias("g"))
    return p.withColumn("size", F.count("*").over(W.partitionBy("g"))).where("size > 1").select("g", "s", "n", "fp", "size")


def _dealt(met: DataFrame, bucket: int | None) -> DataFrame:
    """Buckets as runs (g, x, y); one of more than ``bucket`` (BUCKET) sets is cut into parts by hash, and every two parts meet in one task."""
    bucket = bucket or BUCKET
    d = met.withColumn("parts", F.expr(f"int((size + {bucket - 1}) div {bucket})")).withColumn("part", F.pmod(F.xxhash64("s"), "parts").cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.select("g", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), *[c for c in met.columns if c not in ("g", "size")])
    return d.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "s")


def _links(met: DataFrame, radius: int, bucket: int | None = None) -> DataFrame:
    """(a, b): links that span, in every bucket, what lies within the radius there, by bit-sliced comparison."""

    def compare(runs, cols):
        import numpy as np
        import pyarrow as pa

        s, n, fp = cols
        links = linked(fp, runs, radius, n < FEW)
        if len(links):
            i, j = s[links[:, 0]], s[links[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return by_runs(_dealt(met, bucket), 3, compare).distinct()


def _likely_links(met: DataFrame, least: tuple[int, int], radius: int, bucket: int | None = None) -> DataFrame:
    """(a, b): links that span, in every bucket, what may have Jaccard ``least`` by fingerprint, size and sketch; met has ``bins`` too."""
    p, q = least

    def compare(runs, cols):
        import numpy as np
        import pyarrow as pa

        s, n, fp, bins = cols
        n, bins = n.astype(np.int64), np.frombuffer(b"".join(bins), "<u2").reshape(-1, BINS)

        def also(i, j):
            ok = (n[i] * q >= n[j] * p) & (n[j] * q >= n[i] * p)
            for at in range(0, len(i), 1 << 14):
                part = slice(at, at + (1 << 14))
                ok[part] &= likely(bins[i[part]], bins[j[part]], p / q)
            return ok

        links = linked(fp, runs, radius, n < FEW, also)
        if len(links):
            i, j = s[links[:, 0]], s[links[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return by_runs(_dealt(met, bucket), 3, compare).distinct()


def likely(x, y, least: float):
    """Whether sketches (rows of x and y) agree in a share of bins that sets of Jaccard ``least`` may have."""
    import numpy as np

    some, alike = ((x > 0) | (y > 0)).sum(axis=1), ((x == y) & (x > 0)).sum(axis=1)
    return alike >= least * some - ERR * np.sqrt(least * (1 - least) * np.maximum(some, 1))


def similar_within(sets: list, least: tuple[int, int]):
    """Label of each set: the first of those that it reaches over pairs of Jaccard ``least`` or more.

    A search from set to set: common shingles with all sets not reached yet are counted at once, from the lists of
    the sets that hold each shingle; the lists are made anew whenever half of the sets are reached.
    """
    import numpy as np

    p, q = least
    size = np.array([len(x) for x in sets], np.int64)
    label, every = np.full(len(sets), -1, np.int64), np.concatenate(sets) if sets else np.zeros(0, np.int64)
    code = np.unique(every, return_inverse=True)[1].astype(np.int32)
    start, top = np.r_[0, np.cumsum(size)], int(code.max(initial=-1)) + 1
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)

    def listed():
        """Sets not reached yet, by shingle."""
        left = label[owner] < 0
        order = np.argsort(code[left], kind="stable")
        return owner[left][order], np.r_[0, np.cumsum(np.bincount(code[left], minlength=top))], int((label < 0).sum())

    holders, at, n_listed = listed()
    n_left = n_listed
    # those of the most shared shingles first: an original reaches its copies at once
    shared = np.bincount(owner, np.diff(at)[code], len(sets)) / np.maximum(size, 1)
    for first in np.argsort(-shared, kind="stable").tolist():
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        n_left -= 1
        while queue and n_left:
            x = queue.pop()
            if 2 * n_left < n_listed:
                holders, at, n_listed = listed()
            mine = code[start[x] : start[x + 1]]
            n = at[mine + 1] - at[mine]
            to = np.cumsum(n)
            both = np.bincount(holders[np.repeat(at[mine] - (to - n), n) + np.arange(to[-1] if len(to) else 0)], minlength=len(sets))
            new = np.flatnonzero((both * (p + q) >= p * (size[x] + size)) & (label < 0) & (both > 0))
            label[new] = first
            n_left -= len(new)
            queue += new.tolist()
    return label


def _grams(docs: DataFrame, rows: DataFrame, need: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """need(s, ...) with grams: the whole set, from the text of the first row that has it."""
    cols = need.columns
    lead = rows.select("s", "k1", "k2").join(need.select("s"), "s", "left_semi").groupBy("s").agg(F.min(F.struct("k1", "k2")).alias("f"))
    lead = need.join(lead, "s").select(*cols, F.col("f.k1").alias("k1"), F.col("f.k2").alias("k2"))
    text = docs.select(*_key(id_col, text_col, "k1", "k2"), F.col(text_col).alias("text")).join(lead, ["k1", "k2"]).select(*cols, "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), words) for t in part.column(part.num_columns - 1)]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], [*cols, "grams"])

    return text.mapInArrow(run, ", ".join(f"{c} long" for c in cols) + ", grams array<long>").dropDuplicates(["s"])


def _settled(grams: DataFrame, least: tuple[int, int]) -> DataFrame:
    """grams(root, s, grams) -> (node, root): what each set reaches inside its group, exactly; a group is one task's."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(ids, sets):
            to = similar_within(sets, least)
            ids = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[to])], ["node", "root"])

        now, ids, sets = None, [], []
        for batch in batches:
            values = batch.column(2)
            for root, s, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                if root != now and ids:
                    yield out(ids, sets)
                    ids, sets = [], []
                now = root
                ids.append(s)
                sets.append(np.array(g.values))
        if ids:
            yield out(ids, sets)

    return grams.select("root", "s", "grams").repartition("root").sortWithinPartitions("root", "s").mapInArrow(run, "node long, root long")


def _shares(d: DataFrame, by: str, into: Column) -> DataFrame:
    """d with ``total``, the shingles of its ``by`` group, and ``part``, one of ``into`` parts by hash."""
    total = d.groupBy(by).agg(F.sum(F.size("grams")).alias("total"))
    return d.join(total, by).withColumn("part", F.pmod(F.xxhash64("s"), into))


def _settled_in_parts(grams: DataFrame, least: tuple[int, int]) -> DataFrame:
    """grams(root, s, grams) of groups larger than a task -> links (a, b) that span what is similar in them, exactly.

    First each part of a group is settled by itself, then what stands for the parts' components.  What a group's
    largest component has by then needs no more comparing; each of the others meets every part of the group once.
    No pair is written: a row comes once for each part that it meets.
    """
    half = max(1, MOST_GRAMS // 2)
    parts = lambda n: F.expr(f"(({n}) + {half - 1}) div {half}")
    keyed = lambda d, *key: d.select(F.xxhash64("root", *key).alias("root"), "s", "grams")
    own = materialize(_settled(keyed(_shares(grams, "root", parts("total")), "part"), least), "jac-parts")
    lead = grams.join(own.select(F.col("root").alias("s")).distinct(), "s", "left_semi")
    led = materialize(_settled(keyed(_shares(lead, "root", parts("total")), "part"), least), "jac-leads")
    links = own.unionByName(led).select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    of = components(links).select(F.col("node").alias("s"), F.col("root").alias("label"))
    of = grams.select("root", "s", F.size("grams").cast("long").alias("n")).join(of, "s", "left").withColumn("label", F.coalesce("label", "s"))
    of = materialize(of, "jac-labels")
    by = of.groupBy("root", "label").agg(F.sum("n").alias("n"))
    most = by.groupBy("root").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"))
    most = materialize(most.where(F.col("n") > F.col("m.n")).select("root", F.col("m.label").alias("main"), parts("n - m.n").alias("few"), parts("m.n").alias("many")), "jac-most")
    if not most.head(1):
        return links
    at = of.join(most, "root").withColumn("is", F.col("label") == F.col("main"))
    at = at.withColumn("part", F.when(F.col("is"), F.col("few") + F.pmod(F.xxhash64("s"), "many")).otherwise(F.pmod(F.xxhash64("s"), "few")))
    last = F.when(F.col("is"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = at.select("s", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    rest = _settled(keyed(grams.join(at, "s"), "x", "y"), least).select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    return links.unionByName(materialize(rest, "jac-rest"))


def similar_deduplicated(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), radius: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of texts whose word shingles have Jaccard ``least`` (numerator, denominator) or more.

    The one with the smallest id stays (nulls last), all columns as they are; of rows alike in id and text one stays.
    Null texts are empty; texts without words are alike, and a text of fewer words is one shingle.  Sets and shingles
    are known by 64-bit hashes.  A pair is verified if it lies within ``radius`` bits of the 64-bit SimHash of its
    distinct shingles (at any distance with fewer than FEW shingles) and its sketches leave room for the similarity;
    a pair of just that similarity is passed over with a chance of about 1e-8 by either.
    The comparison gives links that span what may be similar in a bucket, so a group of copies makes as many links as
    it has members.  What they join is settled exactly, group by group, in one task each.  Groups of more than
    MOST_GRAMS shingles are linked again by sketches too, and what is still larger is settled part by part.
    """
    rows = materialize(_sets(docs, words, least, id_col, text_col), "jac-rows")
    met = materialize(_met(rows), "jac-met")
    groups = materialize(components(_links(met, radius)).select(F.col("node").alias("s"), "root"), "jac-groups")

    def wide(g, name):
        size = rows.groupBy("s").agg(F.max("n").alias("n")).join(g, "s").groupBy("root").agg(F.sum("n").alias("n"))
        return materialize(size.where(F.col("n") > MOST_GRAMS).select("root"), name)

    large = wide(groups, "jac-wide")
    if large.head(1):
        inside = groups.join(large, "root", "left_semi").select("s")
        bins = rows.join(inside, "s", "left_semi").groupBy("s").agg(F.first("bins").alias("bins"))  # one set, one sketch
        tight = components(_likely_links(met.join(bins, "s").select(*met.columns, "bins"), least, radius)).select(F.col("node").alias("s"), "root")
        groups = materialize(groups.join(large, "root", "left_anti").select("s", "root").unionByName(tight), "jac-tight")
        large = wide(groups, "jac-large")
    drop(met)
    grams = _grams(docs, rows, groups.join(large, "root", "left_anti").select("root", "s"), words, id_col, text_col)
    parts = materialize(_settled(grams, least), "jac-settled")
    if large.head(1):
        grams = materialize(_grams(docs, rows, groups.join(large, "root", "left_semi").select("root", "s"), words, id_col, text_col), "jac-sets")
        parts = materialize(parts.unionByName(components(_settled_in_parts(grams, least))), "jac-all")
        drop(grams)
    drop(groups)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("f")
    by_set = rows.groupBy("s").agg(first).join(parts.withColumnRenamed("node", "s"), "s", "left")
    stay = by_set.groupBy(F.coalesce("root", "s").alias("root")).agg(F.min("f").alias("f")).select(F.col("f.k1").alias("k1"), F.col("f.k2").alias("k2"))
    return _first_rows(docs, stay, id_col, text_col)
