"""Exact BM25 top-k: inverted index per shard, block-max pruning, lists merged by global statistics.

A shard is at most MOST documents of a task.  Its postings stand by term; documents form aligned blocks of BLOCK, and for
each frequent term the largest impact in each block is kept.  Queries go together: their rare terms are added up exactly,
and every block is bounded by its best such sum plus the frequent terms' block maxima, for all queries by one product of
matrices.  Where a query has no k documents yet, the few blocks of the highest bounds give a first k-th score.  A block is
then scored for those queries whose bound in it reaches their k-th score, again as a product, in single precision; what
could reach the k-th score by that, to within its error, is scored exactly.  A task goes through its shards one by one and
keeps each query's k best, so that later shards start from the k-th score of those before.  Document frequencies, the
number of documents and their mean length are those of the whole corpus, so the tasks' lists merge exactly.  Terms are
lower-cased words, known by a 64-bit hash.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, new_folder
from .substring import WordHash

K1, B = 1.2, 0.75
#: Documents of a block; shard document frequency from which a term is frequent; documents of a shard, and at most.
BLOCK, FREQUENT, SHARD, MOST = 64, 256, 8_192, 12_288
#: A frequent term is in one of so many documents of the shard, or more; cells of the table of frequent terms.
DENSE, CELLS = 32, 16_000_000
#: Blocks of the highest bounds that are scored first; queries, and their rare postings, that go together.
SEEDS, QUERIES, POSTINGS = 8, 128, 1_000_000
#: Tasks of the search for each core.
TASKS = 4
#: Scores are compared and returned at this many decimals, so that the order of additions can't matter.
DECIMALS = 6


def terms_of(text: str | None) -> list[str]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _index(docs: DataFrame, n_rows: int) -> DataFrame:
    """One row for each shard: number, postings and documents as bytes, and its terms with document frequencies."""
    d = docs.coalesce(max(1, -(-n_rows // SHARD)))

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        hashes, part, no, held = WordHash(), TaskContext.get().partitionId(), 0, 0
        ids, sizes, terms, tfs, lens = [], [], [], [], []

        def flush():
            nonlocal no
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), lens)
            term, tf = np.concatenate(terms), np.concatenate(tfs)
            tf = tf.astype(np.min_scalar_type(int(tf.max()) if len(tf) else 0))
            terms.clear()
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            df = np.diff(np.r_[first, len(term)]).astype(np.int32)
            # documents alike in their commonest terms (a language, mostly), and in length, stand together: block maxima tell more
            alike = np.zeros(len(ids), np.int64)
            for t in np.argsort(-df, kind="stable")[:12]:
                alike *= 2
                alike[doc[first[t] : first[t] + df[t]]] += 1
            order = np.lexsort((sizes, alike))
            place = np.empty(len(ids), np.uint16)
            place[order] = np.arange(len(ids), dtype=np.uint16)
            doc = place[doc]
            ids[:], sizes[:] = [ids[k] for k in order], [sizes[k] for k in order]
            order = np.lexsort((doc, term))
            doc, tf = doc[order], tf[order]
            row = {"shard": [part * 4096 + no], "doc": [doc.tobytes()], "tf": [tf.tobytes()], "ids": [np.array(ids, np.int64).tobytes()], "sizes": [np.array(sizes, np.int64).tobytes()], "terms": pa.array([term[first].view(np.int64)], pa.list_(pa.int64())), "df": pa.array([df], pa.list_(pa.int32()))}
            no += 1
            for x in (ids, sizes, terms, tfs, lens):
                x.clear()
            return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64() if k == "shard" else pa.binary()) for k, v in row.items()})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = terms_of(t.as_py())
                c = Counter(words)
                terms.append(np.fromiter(map(hashes.__getitem__, c), np.uint64, len(c)))
                tfs.append(np.fromiter(c.values(), np.uint32, len(c)))
                lens.append(len(c))
                ids.append(i)
                sizes.append(len(words))
                held += len(c)
                if len(ids) >= MOST or held > 8_000_000:
                    held = 0
                    yield flush()
        if ids:
            yield flush()

    return d.mapInArrow(run, "shard long, doc binary, tf binary, ids binary, sizes binary, terms array<long>, df array<int>")


class Shard:
    """The index of a shard in memory, with impacts by the corpus's mean length."""

    def __init__(self, doc, tf, ids, sizes, terms, df, mean: float):
        import numpy as np

        self.doc = np.frombuffer(doc, np.uint16)
        tf = np.frombuffer(tf, f"u{len(tf) // max(1, len(self.doc))}") if len(tf) else np.zeros(0, np.uint8)
        self.ids, size = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.terms, self.df = np.asarray(terms, np.int64).view(np.uint64), np.asarray(df, np.int64)
        self.at = np.r_[0, np.cumsum(self.df)]
        norm = K1 * (1 - B + B * size / mean) if mean else np.full(len(size), K1)
        self.impact = tf * (K1 + 1) / (tf + norm[self.doc])
        self.n_blocks = -(-len(self.ids) // BLOCK)
        # frequent terms stand as rows, block by block; what finds no room counts as rare
        often = np.flatnonzero(self.df >= max(FREQUENT, len(self.ids) // DENSE))
        often = np.sort(often[np.argsort(-self.df[often], kind="stable")[: max(1, CELLS // max(1, len(self.ids)))]])
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((self.n_blocks, len(often), BLOCK), np.float32)
        for r, t in enumerate(often):
            at = self.doc[self.at[t] : self.at[t + 1]].astype(np.int64)
            self.table[at // BLOCK, r, at % BLOCK] = self.impact[self.at[t] : self.at[t + 1]]
        self.top = np.ascontiguousarray(self.table.max(axis=2).T)
        # single precision and its sums are off by this share at most: all terms of a sum are positive
        self.grow = 1 + 2 * (len(often) + 8) * 2.0**-24
        # the postings by document, for exact scores
        order = np.argsort(self.doc, kind="stable")
        self.of_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.df)[order]
        self.of_impact = self.impact[order]
        self.of = np.r_[0, np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.weight = np.zeros(len(self.terms))

    def search(self, terms, idf, own: int, k: int):
        """(scores, ids) of the k best documents but ``own``, and the number of blocks scored."""
        import numpy as np

        best = [(np.zeros(0), np.zeros(0, np.int64))]
        seen = self.search_many(np.array([own]), np.array([len(terms)]), np.asarray(terms), np.asarray(idf), k, best)
        return *best[0], seen

    def search_many(self, own, n_terms, terms, idf, k: int, best: list) -> int:
        """Brings ``best``, the (scores, ids) of the k best documents so far of each query, up to date; the number of blocks scored.

        ``terms`` and ``idf`` hold the terms of all queries, ``n_terms`` of each.
        """
        import numpy as np

        if not len(self.terms):
            return 0
        q = np.repeat(np.arange(len(own)), n_terms)
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[place] == terms
        q, place, idf = q[here], place[here], idf[here]
        # lots of queries whose rare postings fit; a query has no more than the shard
        reads = np.bincount(q, np.where(self.row[place] < 0, self.df[place], 0), minlength=len(own))
        lot = np.maximum.accumulate(np.cumsum(reads) // POSTINGS * len(own) + np.arange(len(own)) // QUERIES)
        cut = np.flatnonzero(np.r_[True, lot[1:] != lot[:-1], True])
        seen = 0
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            a, b = np.searchsorted(q, [lo, hi])
            seen += self._search(own[lo:hi], q[a:b] - lo, place[a:b], idf[a:b], k, best, lo)
        return seen

    def _search(self, own, q, place, idf, k: int, best: list, first: int) -> int:
        """A lot of queries; terms are places here.  ``best`` holds the lot from ``first`` on."""
        import numpy as np

        n, row, width, slack = len(own), self.row[place], self.n_blocks * BLOCK, 2 * 10.0**-DECIMALS
        rare = row < 0
        at, reads = _ranges(self.at[place[rare]], self.df[place[rare]])
        score = np.bincount(np.repeat(q[rare] * width, reads) + self.doc[at], self.impact[at] * np.repeat(idf[rare], reads), n * width)
        score = score.astype(float, copy=False).reshape(n, self.n_blocks, BLOCK)
        sorted_ids = self.ids[self.by_id]
        left = np.searchsorted(sorted_ids, own)
        same, many = _ranges(left, np.searchsorted(sorted_ids, own, "right") - left)
        same = self.by_id[same]
        score[np.repeat(np.arange(n), many), same // BLOCK, same % BLOCK] = -np.inf
        weight = np.zeros((n, len(self.top)), np.float32)
        weight[q[~rare], row[~rare]] = idf[~rare]
        bound = score.max(axis=2) + weight @ self.top
        least = np.array([s[-1] if len(s) == k else -np.inf for s, _ in best[first : first + n]])
        near = np.zeros(bound.shape, bool)
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh):  # the blocks of the highest bounds give a first k-th score
            m = min(SEEDS, self.n_blocks)
            seeds = np.argpartition(-bound[fresh], m - 1, axis=1)[:, :m]
            near[fresh[:, None], seeds] = True
            near &= bound > 0
            got = np.zeros((n, m, BLOCK))
            slot = np.cumsum(near, axis=1) - 1
            for b in np.flatnonzero(near.any(axis=0)).tolist():
                who = np.flatnonzero(near[:, b])
                got[who, slot[who, b]] = score[who, b] + weight[who] @ self.table[b]
            if m * BLOCK >= k:
                kth = -np.partition(-got[fresh].reshape(len(fresh), -1), k - 1, axis=1)[:, k - 1]
                least[fresh] = np.where(kth > 0, kth / self.grow - slack, -np.inf)
        least = (least - slack)[:, None]
        todo = (bound > 0) & (bound * self.grow >= least)
        who_all, docs_all, about = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in np.flatnonzero(todo.any(axis=0)).tolist():
            who = np.flatnonzero(todo[:, b])
            s = score[who, b] + weight[who] @ self.table[b]
            j, d = np.nonzero((s > 0) & (s * self.grow >= least[who]))
            who_all.append(who[j])
            docs_all.append(b * BLOCK + d)
            about.append(s[j, d])
        order = np.argsort(who := np.concatenate(who_all), kind="stable")
        who, docs, about = who[order], np.concatenate(docs_all)[order], np.concatenate(about)[order]
        cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            j, d, s = who[lo], docs[lo:hi], about[lo:hi]
            if len(d) > k:
                d = d[s * self.grow >= np.partition(s, len(s) - k)[len(s) - k] / self.grow - slack]
            a, b = np.searchsorted(q, [j, j + 1])
            self.weight[place[a:b]] = idf[a:b]
            at, reads = _ranges(self.of[d], self.of[d + 1] - self.of[d])
            s = np.round(np.add.reduceat(self.of_impact[at] * self.weight[self.of_term[at]], np.cumsum(reads) - reads), DECIMALS)
            self.weight[place[a:b]] = 0
            old, ok = best[first + j], s > 0
            s, ids = np.r_[old[0], s[ok]], np.r_[old[1], self.ids[d[ok]]]
            top = np.lexsort((ids, -s))[:k]
            best[first + j] = s[top], ids[top]
        return int((near | todo).sum())


def _ranges(lo, n):
    """Numbers of many ranges, one after the other, and how many each has."""
    import numpy as np

    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def search(docs: DataFrame, every: int = 100, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: BM25's ``k`` best of all other documents for each document whose id is divisible by ``every``.

    A query is the distinct terms of its whole text; rows that share an id are one query, and each a document of its
    own.  Only documents that share a term come.  Best score first (six decimals), ties to the smaller id.  Null
    texts hold no terms; rows with a null id take no part; an empty table gives none.
    """
    spark = docs.sparkSession
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_rows = d.select("doc_id").count()
    index = materialize(_index(d, n_rows), "bm25-index")

    def words(batches):
        import pyarrow as pa

        hashes = WordHash()
        for b in batches:
            i, t = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = {hashes[w] for w in set(terms_of(text.as_py()))}
                i += [doc] * len(seen)
                t += seen
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.uint64()).view(pa.int64())], ["query_id", "term"])

    def lengths(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(x, np.int64).sum()) for x in b.column(0).to_pylist()], pa.int64())})

    total = index.select("sizes").mapInArrow(lengths, "n long").agg(F.sum("n")).first()[0] or 0
    mean = total / n_rows if n_rows else 0.0
    asked = d.where(F.pmod("doc_id", F.lit(every)) == 0).mapInArrow(words, "query_id long, term long").distinct()
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("z")).groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.df").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n_rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t"))
    asked = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
    folder = new_folder(spark, "bm25-queries")
    asked.write.parquet(f"{folder}/rows")

    def run(batches):
        """A shard at a time against all queries, read in blocks; the k best of the task's shards come at the end."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1))
        best: dict[int, tuple] = {}
        none = np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            for doc, tf, ids, sizes, at, df in zip(*(b.column(c) for c in ("doc", "tf", "ids", "sizes", "terms", "df")), strict=True):
                shard = Shard(*(x.as_buffer() for x in (doc, tf, ids, sizes)), at.values.to_numpy(), df.values.to_numpy(), mean)
                for q in ds.dataset(f"{top}/rows", filesystem=store, format="parquet").to_batches(batch_size=256, columns=["query_id", "terms", "idf"]):
                    own = q.column(0).to_numpy()
                    held = [best.get(o, none) for o in own.tolist()]
                    shard.search_many(own, q.column(1).value_lengths().to_numpy(), q.column(1).flatten().to_numpy().view(np.uint64), q.column(2).flatten().to_numpy(), k, held)
                    best.update(zip(own.tolist(), held, strict=True))
        own = list(best)
        for at in range(0, len(own), 1024):
            some = [(o, *best[o]) for o in own[at : at + 1024]]
            out = np.repeat([o for o, _, _ in some], [len(s) for _, s, _ in some]), np.concatenate([i for _, _, i in some]), np.concatenate([s for _, s, _ in some])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "doc_id", "score"])

    tasks = index.drop("shard").coalesce(TASKS * spark.sparkContext.defaultParallelism)
    found = tasks.mapInArrow(run, "query_id long, doc_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def oracle(every: int = 100, k: int = 10) -> str:
    words = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM d),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1e0 + (n.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.tf * {K1 + 1} / (p.tf + {K1} * ({1 - B} + {B} * len(d.w) / n.mean))), {DECIMALS}) AS score
  FROM p AS q JOIN p ON p.t = q.t AND p.doc_id <> q.doc_id JOIN f ON f.t = p.t JOIN d ON d.doc_id = p.doc_id, n
  WHERE q.doc_id % {every} = 0 GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s) WHERE rank <= {k}"""
