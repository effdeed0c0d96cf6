"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best-bin-first search, calibrated recall.

The tree is fitted on a bounded sample; every row goes to its leaf.  Rows are lifted by one coordinate to a common
length, so that the largest inner product is the smallest distance.  A query visits leaves in the order in which a
priority queue over the tree yields them.  How many: least number at which a sample of queries, held against all
rows, finds the wanted share of its true neighbours (doubling the visits until it does, then halving the step).
Rows of neighbouring leaves form shards of bounded size (large leaves are split); each query goes to the shards of its
leaves, and partial lists are merged by query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bounds, whatever the input: rows that the tree sees, queries that calibrate it, leaves, rows of a shard.
FIT_ROWS, CALIBRATION, MOST_LEAVES, SHARD_ROWS = 16_384, 192, 16_384, 16_384
BRANCH, LEAF_ROWS = 8, 384


@dataclass(frozen=True)
class Tree:
    centers: object  # nodes x (dimension + 1)
    children: tuple[tuple[int, ...], ...]  # of each node; none: a leaf
    leaf_no: tuple[int, ...]  # number of each leaf node, -1 for others
    longest: float  # largest norm of all rows

    @property
    def n_leaves(self) -> int:
        return max(self.leaf_no) + 1

    def lift(self, x):
        import numpy as np

        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def assign(self, x):
        """Leaf of each row: down the tree, always to the nearest child."""
        import numpy as np

        y, out = self.lift(x), np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_no[node]
                continue
            kids = np.array(self.children[node])
            c = self.centers[kids]
            near = np.argmax(y[rows] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            todo += [(int(k), rows[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def leaves(self, products, visits: int) -> list[int]:
        """First ``visits`` leaves of a query, best bin first; products: its inner products with all centers."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for k in self.children[node]:
                    heapq.heappush(heap, (-products[k], k))
            else:
                out.append(self.leaf_no[node])
        return out


def fit_tree(x, longest: float, n_rows: int, seed: int = 5) -> Tree:
    """K-means in levels over the sample ``x``, until a leaf stands for about LEAF_ROWS of all ``n_rows``."""
    import numpy as np

    rng = np.random.default_rng(seed)
    tree = Tree(None, (), (), longest)
    y = tree.lift(x)
    leaf = max(8, LEAF_ROWS * len(x) // max(1, n_rows), len(x) // MOST_LEAVES)
    centers, children, todo = [y.mean(axis=0) if len(y) else np.zeros(y.shape[1])], [()], [(0, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop(0)
        z = y[rows]
        k = min(BRANCH, -(-len(rows) // leaf))
        if k < 2 or (z == z[0]).all():
            continue
        c = z[rng.choice(len(z), k, replace=False)]
        for _ in range(8):
            near = np.argmax(z @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            c = np.stack([z[near == j].mean(axis=0) if (near == j).any() else z[rng.integers(len(z))] for j in range(k)])
        near = np.argmax(z @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        parts = [rows[near == j] for j in range(k)]
        if max(map(len, parts)) == len(rows):
            continue
        kids = []
        for j, part in enumerate(parts):
            if len(part):
                kids.append(len(centers))
                centers.append(c[j])
                children.append(())
                todo.append((kids[-1], part))
        children[node] = tuple(kids)
    n, leaf_no = 0, []
    for kids in children:
        leaf_no.append(-1 if kids else n)
        n += not kids
    return Tree(np.stack(centers), tuple(children), tuple(leaf_no), longest)


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: id not null, vector finite, not zero, and of the commonest length."""
    x = F.col(vec_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    r = rows.where(F.col(id_col).isNotNull() & x.isNotNull() & good & F.exists(x, lambda v: v != 0))
    r = r.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vec"))
    size = r.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return r.where(F.size("vec") == (size[0] if size else 0))


def _matrix(col):
    import numpy as np

    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def exact_products(rows, q):
    """Inner products in double precision, added in the order of the components: alike for alike vectors."""
    import numpy as np

    s = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        s += rows[:, k] * q[k]
    return s


def best(products, ids, rows, q, own, k: int):
    """(score, vec_id) of the k best candidates: products may be rounded, so all near the k-th are computed again."""
    import numpy as np

    seen = np.flatnonzero((products > -np.inf) & (ids != own))
    if len(seen) > k:
        p = products[seen]
        least = -np.partition(-p, k - 1)[k - 1]
        seen = seen[p >= least - 1e-9 * max(1.0, abs(least))]
    s = exact_products(rows[seen], q)
    order = np.lexsort((ids[seen], -s))[:k]
    return s[order].tolist(), ids[seen][order].tolist(), seen[order]


def _calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Visits at which the calibration queries reach the recall, against all rows."""
    import numpy as np

    q = queries.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(CALIBRATION).collect()
    if not q:
        return 1
    ids, qs = [r.vec_id for r in q], np.array([r.vec for r in q])
    sent = rows.sparkSession.sparkContext.broadcast((ids, qs))

    def run(batches):
        import pyarrow as pa

        ids, qs = sent.value
        for b in batches:
            x, own = _matrix(b.column(1)), b.column(0).to_numpy()
            if not len(own):
                continue
            s, out = qs @ x.T, []
            for n in range(len(ids)):
                score, found, at = best(s[n], own, x, qs[n], ids[n], k)
                out += [(n, v, p, int(leaf)) for v, p, leaf in zip(score, found, b.column(2).to_numpy()[at], strict=True)]
            c = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.float64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32())], ["q", "score", "vec_id", "leaf"])

    top = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = rows.select("vec_id", "vec", "leaf").mapInArrow(run, "q int, score double, vec_id long, leaf int")
    near = near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "leaf").collect()  # CALIBRATION x k
    order = [{leaf: j for j, leaf in enumerate(tree.leaves(p, tree.n_leaves))} for p in qs @ tree.centers[:, :-1].T]
    need = np.array([order[r.q][r.leaf] for r in near])
    share = lambda v: (need < v).mean() if len(need) else 1.0
    visits = 1
    while share(visits) < recall and visits < tree.n_leaves:
        visits *= 2
    step = visits // 4
    while step:
        if share(visits - step) >= recall:
            visits -= step
        step //= 2
    return min(visits, tree.n_leaves)


def search(rows: DataFrame, every: int = 20, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``, among all other rows.

    Largest inner product first, ties to the smaller id.  Rows with a null id, and vectors that are null, zero, of
    another length than most, or hold null or non-finite components, take no part.  Rows that share the query's id
    are its own, and of repeated query rows the lists are merged by id.  ``recall`` is
    what the calibration queries must reach; 0.9 is asked for.  A query goes on past the calibrated visits until its
    leaves hold more than ``k`` rows.  An empty table gives none.
    """
    import numpy as np

    spark = rows.sparkSession
    v = valid_vectors(rows, id_col, vec_col)
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n_rows, longest = v.agg(F.count("*"), F.max(norm2)).first()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = v.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(FIT_ROWS).select("vec").toArrow()  # bounded
    tree = fit_tree(_matrix(sample["vec"].combine_chunks()), float(np.sqrt(longest)), n_rows)
    sent = spark.sparkContext.broadcast(tree)  # MOST_LEAVES centers and their parents at most

    def leaf(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.assign(x) if len(x) else [], pa.int32())], ["vec_id", "vec", "leaf"])

    index = materialize(v.mapInArrow(leaf, "vec_id long, vec array<double>, leaf int"), "ann-index")
    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec").distinct()
    visits = _calibrated(index, queries, tree, k, recall)
    sizes = [0] * tree.n_leaves
    for no, count in index.groupBy("leaf").count().collect():  # MOST_LEAVES at most
        sizes[no] = count
    first, parts, shard, room = [], [], 0, SHARD_ROWS
    for n in sizes:
        p = max(1, -(-n // SHARD_ROWS))
        if p > 1 or n > room:
            shard, room = shard + (room < SHARD_ROWS), SHARD_ROWS
        first.append(shard)
        parts.append(p)
        shard, room = (shard + p, SHARD_ROWS) if p > 1 else (shard, room - n)
    places = spark.sparkContext.broadcast((first, parts, sizes))

    def place(batches):
        import pyarrow as pa

        first, parts = (np.array(x) for x in places.value[:2])
        for b in batches:
            no, salt = b.column(2).to_numpy(), b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[no] + salt % parts[no], pa.int32()), pa.array(np.zeros(len(no), np.int32)), b.column(0), b.column(1), pa.array(no[:, None].tolist(), pa.list_(pa.int32()))], ["shard", "kind", "id", "vec", "leaves"])

    def route(batches):
        import pyarrow as pa

        t, (first, parts, sizes) = sent.value, places.value
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            out = []
            for i, p in enumerate(x @ t.centers[:, :-1].T):
                to: dict[int, list[int]] = {}
                go = visits
                leaves = t.leaves(p.tolist(), go)
                while sum(sizes[no] for no in leaves) <= k and go < t.n_leaves:  # the queue goes on until k others can be found
                    go = min(2 * go, t.n_leaves)
                    leaves = t.leaves(p.tolist(), go)
                for no in leaves:
                    for s in range(first[no], first[no] + parts[no]):
                        to.setdefault(s, []).append(no)
                out += [(s, i, nos) for s, nos in to.items()]
            s, i, nos = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(np.ones(len(s), np.int32)), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(nos, pa.list_(pa.int32()))], ["shard", "kind", "id", "vec", "leaves"])

    schema = "shard int, kind int, id long, vec array<double>, leaves array<int>"
    both = index.select("vec_id", "vec", "leaf", F.abs(F.xxhash64("vec_id", "vec") % 1_000_003).alias("salt")).mapInArrow(place, schema).unionByName(queries.mapInArrow(route, schema))
    both = both.repartition(max(1, min(shard + 1, 1 << 15)), "shard").sortWithinPartitions("shard", "kind", "id")

    def compare(batches):
        """Rows of a shard come first and are held, its queries stream past."""
        import pyarrow as pa

        now, held, ids, x, cut = None, [], None, None, None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *edge], [*edge, len(shards)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if shards[lo] != now:
                    now, held, x, ids = shards[lo], [], None, None
                if kinds[lo] == 0:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).flatten().to_numpy()))
                    continue
                if x is None:
                    if not held:
                        continue
                    ids, x, no = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(no, kind="stable")
                    ids, x, no = ids[order], x[order], no[order]
                    at = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])
                    cut, held = list(zip(no[at].tolist(), at.tolist(), [*at[1:].tolist(), len(no)], strict=True)), []
                for a in range(0, len(part), 128):
                    q = part.slice(a, 128)
                    qx, own, nos = _matrix(q.column(3)), q.column(2).to_pylist(), [set(v) for v in q.column(4).to_pylist()]
                    s = np.full((len(qx), len(ids)), -np.inf)
                    for leaf_no, c, d in cut:
                        who = [j for j, v in enumerate(nos) if leaf_no in v]
                        if who:
                            s[who, c:d] = qx[who] @ x[c:d].T
                    out = []
                    for j in range(len(qx)):
                        score, found, _ = best(s[j], ids, x, qx[j], own[j], k)
                        out += [(own[j], f, v) for v, f in zip(score, found, strict=True)]
                    if out:
                        c = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(compare, "query_id long, vec_id long, score double")
    top = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(top).cast("int")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
