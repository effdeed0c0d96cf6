"""Concatenate-and-cut packing by two passes over token totals.

Pass one tokenizes each partition once, writes the ids with their offset in the partition, and pass two adds the
prefix sum of the partitions' totals: a document's global offset, from which its pieces in fixed windows follow.
No row moves between the passes; only one total for each partition does.
"""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Partition totals (16 bytes each) up to this number are broadcast; more are joined by shuffle.
MOST_TOTALS = 1_000_000


def encoded(docs: DataFrame, tokenizer_path: str, eos: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, part, local, n, ids): ids as little-endian bytes with the end id (uint16 where the vocabulary fits, else uint32), local = ids before it in its partition."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .token_cache import tokenizer

        tok, part, at = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        kind = "<u2" if tok.tok.get_vocab_size() <= 1 << 16 and eos < 1 << 16 else "<u4"
        for batch in batches:
            for first, rows, ids, n in tok.batches(batch, 1, eos):
                to = np.cumsum(n)
                raw = ids.astype(kind, copy=False)
                ends = pa.py_buffer(np.r_[0, to * raw.itemsize].astype("<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.full(rows, part, np.int64)), pa.array(at + to - n), pa.array(n), pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(raw)])], ["doc_id", "part", "local", "n", "ids"])
                at += int(to[-1])

    return d.mapInArrow(run, "doc_id long, part long, local long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, eos: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary, pad [, ids].

    Documents follow each other in the order of the input's partitions; each ends with ``eos``; a window of
    ``length`` ids is a sequence.  ``boundary`` marks pieces of a document that windows cut; ``pad`` is what follows
    the piece up to the padded length: only the last sequence is padded, unless its length is a power of two.
    Null texts are empty ones (the end id only); null and repeated doc_ids are kept row by row; an empty table gives
    no pieces.  ``with_ids`` adds each piece's ids (array<int>).
    """
    rows = materialize(encoded(docs, tokenizer_path, eos, id_col, text_col), "pack-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy()).alias("total"))
    totals = materialize(totals, "pack-totals")
    if totals.count() <= MOST_TOTALS:
        totals = F.broadcast(totals)
    placed = rows.join(totals, "part").select("doc_id", (F.col("base") + F.col("local")).alias("at"), "total", "n", "ids")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "boundary": pa.bool_(), "pad": pa.int64()}
        kinds |= {"ids": pa.list_(pa.int32())} if with_ids else {}
        for batch in batches:
            out = {k: [] for k in kinds}
            for doc, at, total, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    take = min(length - offset, n - start)
                    got = offset + take
                    last = at + start + take == total
                    row = (doc, start, take, zlib.crc32(ids[start : start + take].tobytes()), n, (at + start) // length, offset, take < n, length - got if last and got & (got - 1) else 0)
                    for k, v in zip(kinds, row, strict=False):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(ids[start : start + take].astype("<i4"))
                    start += take
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, pad long"
    return placed.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))
