"""Mixing sources to target weights with DataFrame functions only.

Each source's documents form one stream of words, cut into fixed-length blocks.  A source's target is its
water-filled share of ``share`` times all words, and takes its slots (one block each) over as many passes as it needs.
Each source's slots are drawn into the output shards, a multinomial draw of its counts with its total kept, so that
every target is met to the word.  The counts' prefix sums give each shard its run of the source's slots, which a
pseudorandom permutation for the source and pass maps to blocks; blocks are joined to slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words

ROUNDS = 24
SLOT_CHUNK = 1 << 12
#: Up to so many sources (a hundred bytes each) are broadcast to their shards' counts.
MOST_SOURCES = 100_000


def permuted(x: Column, n: Column, key: list[Column], inverse: bool = False) -> Column:
    """Swap-or-not permutation of 0..n-1 (Hoang, Morris, Rogaway 2012): exact on any n, and its own inverse by round."""
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        swap = F.xxhash64(*key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in order]), x.cast("long"), step)


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (source, source_size) -> plus sid, target.

    Sources by code point, null last, weigh ``weights`` in turn.  Water-filling in closed form: sorted by cap over
    weight, the capped sources are a prefix, and the rest share what is left by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("w", w)
    t = t.withColumn("capped", F.lit(float(cap)) * F.col("source_size"))
    rank = W.orderBy((F.col("capped") / F.col("w")).asc(), F.col("sid"))
    every = W.partitionBy()
    t = t.withColumn("caps", F.coalesce(F.sum("capped").over(rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("ws", F.sum("w").over(rank.rowsBetween(W.currentRow, W.unboundedFollowing)))
    t = t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    level = (F.col("total") - F.col("caps")) / F.col("ws")
    # the first source whose cap is not under the level fixes the level of all after it
    t = t.withColumn("level", F.when(level * F.col("w") <= F.col("capped"), level))
    t = t.withColumn("level", F.first("level", ignorenulls=True).over(rank.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("capped"), F.coalesce(F.col("level") * F.col("w"), F.col("capped")))
    return t.select("source", "source_size", "sid", target.alias("target"))


def _plan(rows: DataFrame, weights, share, cap, block: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, source, size, thash, dup) -> (placed rows, used blocks)."""
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, round(most**0.5))  # as many chunks a source as rows a chunk
    placed = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "thash", "dup"), F.lit(chunks)))
    order = W.partitionBy("source", "chunk").orderBy("doc_id", "size", "thash", "dup").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("local", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    placed = materialize(placed, "mix-rows")
    per_chunk = placed.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    sizes = per_chunk.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    src = materialize(targets(sizes, weights, share, cap), "mix-sources")
    by_chunk = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("base", F.coalesce(F.sum("words").over(by_chunk), F.lit(0)).cast("long"))
    per_chunk = per_chunk.alias("c").join(src.alias("s"), F.expr("c.source <=> s.source")).select("c.source", "chunk", "base", "sid", "source_size", "target")
    placed = placed.alias("p").join(per_chunk.alias("c"), F.expr("p.source <=> c.source and p.chunk = c.chunk"))
    placed = placed.select("doc_id", "p.source", "size", "thash", "dup", "p.chunk", (F.col("base") + F.col("local")).alias("off"), "sid", "source_size", "target")

    n, b, q, size = F.col("n"), F.lit(block), F.col("quota"), F.col("source_size")
    s = src.where("source_size > 0").select("sid", "source", "source_size", F.round("target").cast("long").alias("quota"))
    s = s.withColumn("n", F.expr(f"(source_size + {block - 1}) div {block}"))
    s = s.withColumn("passes", F.expr("quota div source_size")).withColumn("rest", q - F.col("passes") * size)
    s = s.withColumn("short", size - (n - 1) * b)  # words of the last block
    s = s.withColumn("at", permuted(n - 1, n, [F.lit(seed), F.col("sid"), F.col("passes")], inverse=True))
    rest, at, short = F.col("rest"), F.col("at"), F.col("short")
    before = at * b
    slots = F.when(rest <= before, F.expr(f"(rest + {block - 1}) div {block}")).when(rest <= before + short, at + 1).otherwise(F.expr(f"(rest - short + {block - 1}) div {block}") + 1)
    cut = F.when(rest <= before, rest - (F.col("tail") - 1) * b).when(rest <= before + short, rest - before).otherwise(rest - short - (F.col("tail") - 2) * b)
    s = s.withColumn("tail", slots).withColumn("cut", cut).withColumn("slots", F.col("passes") * n + F.col("tail"))
    s = s.where("slots > 0")
    every = s.agg(F.sum("slots")).first()[0] or 0
    shards, tasks = max(1, -(-every // shard_slots)), max(1, min(-(-every // (4 * SLOT_CHUNK)), 1 << 15))
    counts = materialize(_drawn(s, shards, tasks, seed), "mix-counts")
    run = F.sum("slots").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    runs = counts.withColumn("from", F.coalesce(run, F.lit(0)).cast("long")).withColumnRenamed("slots", "count")
    got = runs.join(F.broadcast(s) if s.count() < MOST_SOURCES else s, "sid").repartition(tasks, "sid", "shard")
    got = got.withColumn("k", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("count") - 1)))
    got = got.withColumn("pass", F.expr("k div n")).withColumn("block", permuted(F.pmod(F.col("k"), n), n, [F.lit(seed), F.col("sid"), F.col("pass")]))
    full = F.when(F.col("block") == n - 1, short).otherwise(b)
    got = got.withColumn("words", F.when((F.col("k") == F.col("slots") - 1) & (F.col("tail") > 0), F.col("cut")).otherwise(full))
    return placed, got.select("sid", "block", "pass", "words", "shard", "source")


def _drawn(s: DataFrame, shards: int, tasks: int, seed: int) -> DataFrame:
    """(sid, shard, slots): how many of a source's slots each shard draws; a chunk of slots draws in one task, and draws add up before they move."""
    step = F.lit(SLOT_CHUNK).cast("long")
    d = s.select("sid", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, step)).alias("from")).repartition(tasks, "sid", "from")
    d = d.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, F.col("slots")) - 1)))
    return d.groupBy("sid", F.pmod(F.xxhash64(F.lit(seed), F.lit("shards"), "sid", "k"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("slots"))


def shard_counts(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 512, shard_slots: int = 1024, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix by output shard: (shard, source, blocks, words) that it takes of each source; same draws as ``allocate`` and ``mixed_documents``."""
    used = _plan(_sized(docs, id_col, text_col, source_col), weights, share, cap, block, shard_slots, seed)[1]
    return used.groupBy("shard", "source").agg(F.count("*").alias("blocks"), F.sum("words").alias("words"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("thash"), F.lit(0).alias("dup"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """One row for each block that a document's words reach: from and to in the block, doc_from in the document."""
    p = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    lo = F.greatest(F.col("off"), F.col("block") * block)
    hi = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    return p.withColumn("from", lo - F.col("block") * block).withColumn("to", hi - F.col("block") * block).withColumn("doc_from", lo - F.col("off"))


def allocate(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 512, shard_slots: int = 1024, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per input row: doc_id, size, source_size, target (its source's), taken (words that the mix takes, repeats counted).

    Null texts hold no words and null sources are one source, the last.  Repeated rows are rows of their own.  An
    empty table gives an empty result, a source without words target 0.  Only the three named columns are read.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    placed, used = _plan(rows, weights, share, cap, block, shard_slots, seed)
    uses = used.groupBy("sid", "block").agg(F.count("*").alias("uses"), F.min("words").alias("least"))
    # the planner takes exploded slots for as small as the sources they come from; they grow with the input
    got = _pieces(placed, block).join(uses.hint("merge"), ["sid", "block"])
    cut = F.greatest(F.lit(0), F.least(F.col("to"), F.col("least")) - F.col("from"))
    taken = (F.col("uses") - 1) * (F.col("to") - F.col("from")) + cut
    # a row is known by its place in its source's stream; rows without words share a place and take nothing
    per_row = got.groupBy("sid", "off").agg(F.sum(taken).alias("got"))
    out = placed.join(per_row.hint("merge"), ["sid", "off"], "left")
    taken_col = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken_col.alias("taken"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 512, shard_slots: int = 1024, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows of ``docs``' own columns: a document comes once for each pass that takes words of it, cut to the words taken.

    Words keep the white space before them; a document taken whole in a pass keeps its text as it is.  Documents
    that the mix doesn't take, or that hold no words, don't come.  Repeated rows are rows of their own.
    ``n_chars_col`` is set to the new length where it exists.
    """
    key = [F.xxhash64(id_col, source_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit("mix"), source_col, id_col).alias("k2")]
    rows = docs.select(*key, F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = rows.groupBy("k1", "k2", "source", "size").count().withColumn("dup", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    rows = rows.select(F.col("k1").alias("doc_id"), "source", "size", F.col("k2").alias("thash"), "dup")
    placed, used = _plan(rows, weights, share, cap, block, shard_slots, seed)
    got = _pieces(placed, block).join(used.select("sid", "block", "pass", "words").hint("merge"), ["sid", "block"])
    got = got.withColumn("end", F.least(F.col("to"), F.col("words"))).where("end > from")
    span = F.struct(F.col("doc_from").alias("at"), (F.col("end") - F.col("from")).alias("n"))
    got = got.groupBy(F.col("doc_id").alias("k1"), F.col("thash").alias("k2"), "dup", "size", "pass").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # the row stands in a struct, so that no column of it can clash; repeats of a row are numbered, and each takes its own spans
    alike = W.partitionBy("k1", "k2").orderBy("k1")
    d = docs.select(F.struct("*").alias("row"), *key).withColumn("dup", F.row_number().over(alike)).join(got.hint("merge"), ["k1", "k2", "dup"])
    text = F.col("row")[text_col]
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n"]) == F.col("size")
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    # the words stand in an array of one, so that they are cut once for a row and not once for a span
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["n"].cast("int")))), ""))[0]
    d = d.withColumn("new", F.when(whole, text).otherwise(cut))
    new = {text_col: F.col("new")} | ({n_chars_col: F.length("new").cast(docs.schema[n_chars_col].dataType)} if n_chars_col in docs.columns else {})
    return d.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
