"""Token-id files: ids in fixed-size blocks, transposed to byte or bit planes, each plane zstandard-compressed.

A file holds the documents of one range of doc_id, ascending.  Layout: magic; the planes of each block, one after
the other; a footer (zstandard JSON: id blocks with place, size and plane lengths, the chunk index; document
runs with doc ids and lengths); the footer's place (u64) and magic again.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, new_folder

MAGIC = b"SKYPLN01"
BLOCK = 1 << 16
DOC_RUN = 1 << 14


def to_planes(ids, kind: str) -> list[bytes]:
    """Planes of a block of uint32 ids, lowest byte or bit first."""
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str):
    """Inverse of ``to_planes``."""
    import numpy as np

    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Streams ids into a file; holds one block at most."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.kind, self.block, self.zip = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held, self.blocks, self.runs, self.docs = len(MAGIC), [], 0, [], [], ([], [])
        self.n_ids = self.n_docs = 0
        out.write(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self, least: int) -> None:
        """Writes whole blocks of what is held, and the rest too if that is ``least`` ids or more."""
        import numpy as np

        if self.n_held < least or not self.n_held:
            return
        ids, at = np.concatenate(self.held), 0
        while len(ids) - at >= min(least, self.block) and at < len(ids):
            now, place = ids[at : at + self.block], self.at
            self.blocks.append([place, len(now), [self._put(self.zip.compress(p)) for p in to_planes(now, self.kind)]])
            at += len(now)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def _flush_docs(self) -> None:
        import numpy as np

        ids, sizes = self.docs
        if ids:
            null = np.array([x is None for x in ids], dtype=bool)
            parts = [np.packbits(null).tobytes(), np.array([x or 0 for x in ids], "<i8").tobytes(), np.array(sizes, "<i8").tobytes()]
            at = self.at
            self.runs.append([at, len(ids), [self._put(self.zip.compress(p)) for p in parts]])
            self.docs = ([], [])

    def add_many(self, doc_ids: list, sizes: list[int], ids) -> None:
        """Documents, the ids of all of them one after the other."""
        self.held.append(ids)
        self.n_held += len(ids)
        self.docs[0].extend(doc_ids)
        self.docs[1].extend(sizes)
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(sizes)
        self._flush(self.block)
        if len(self.docs[0]) >= DOC_RUN:
            self._flush_docs()

    def close(self) -> None:
        self._flush(1)
        self._flush_docs()
        foot, at = self.zip.compress(json.dumps({"kind": self.kind, "blocks": self.blocks, "runs": self.runs, "n_ids": self.n_ids, "n_docs": self.n_docs}).encode()), self.at
        self.out.write(foot + struct.pack("<Q", at) + MAGIC)


class Reader:
    """Reads a file by its chunk index."""

    def __init__(self, f, size: int):
        import zstandard

        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        f.seek(size - 16)
        at, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        f.seek(at)
        self.index = json.loads(self.unzip.decompress(f.read(size - 16 - at)))

    def _parts(self, entry) -> list[bytes]:
        self.f.seek(entry[0])
        return [self.unzip.decompress(self.f.read(k)) for k in entry[2]]

    def blocks(self, first: int = 0):
        """Id blocks, from block ``first`` on (blocks are of equal size but for the last)."""
        for b in self.index["blocks"][first:]:
            yield from_planes(self._parts(b), b[1], self.index["kind"])

    def docs(self):
        """(doc_id or None, number of ids), in order."""
        import numpy as np

        for run in self.index["runs"]:
            null, ids, sizes = self._parts(run)
            yield from zip([None if x else y for x, y in zip(np.unpackbits(np.frombuffer(null, np.uint8), count=run[1]).tolist(), np.frombuffer(ids, "<i8").tolist(), strict=True)], np.frombuffer(sizes, "<i8").tolist(), strict=True)

    def documents(self):
        """(doc_id, ids) of each document; a block at a time in memory, besides the document."""
        import numpy as np

        blocks, have = self.blocks(), np.zeros(0, "<u4")
        for doc, n in self.docs():
            parts, got = [have], len(have)
            while got < n:
                parts.append(next(blocks))
                got += len(parts[-1])
            ids = np.concatenate(parts) if len(parts) > 1 else have
            yield doc, ids[:n]
            have = ids[n:]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def write_files(docs: DataFrame, tokenizer_path: str, eos: int = 2, folder: str | None = None, kind: str = "byte", block: int = BLOCK, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents in ascending id order (nulls first; ties by text hash); one file for each id range.

    Returns the manifest (shard, path, bytes, n_docs, n_ids, base), base = ids in all shards before.  Null texts are
    empty ones.  A task writes to a name of its own and then renames, so a repeated task replaces the same file.
    An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        from .token_cache import tokenizer

        shard, writer, tok = TaskContext.get().partitionId(), None, tokenizer(tokenizer_path)
        for batch in batches:
            if batch.num_rows and writer is None:
                store, top = _open(folder)
                store.create_dir(top, recursive=True)
                name = f"{top}/.{uuid.uuid4().hex}"
                out = store.open_output_stream(name)
                writer = Writer(out, kind, block, level)
            for first, rows, ids, n in tok.batches(batch, 1, eos):
                writer.add_many(batch.column(0).slice(first, rows).to_pylist(), n.tolist(), ids)
        if writer is not None:
            writer.close()
            out.close()
            path = f"shard-{shard:06d}.ids"
            store.move(name, f"{top}/{path}")
            size = store.get_file_info(f"{top}/{path}").size
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{path}"], "bytes": [size], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    made = materialize(d.mapInArrow(run, "shard long, path string, bytes long, n_docs long, n_ids long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 [, ids].

    Null ids and repeated rows come as they were written; a null or empty text is its end id alone.  Files are read
    block by block, and a document over many blocks is put together in memory.  An empty manifest gives none.
    """
    n = max(1, min(manifest.count(), 1 << 16))
    m = manifest.select("path", "bytes", "base").repartition(n)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
        for batch in batches:
            for path, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    rows, held = [], 0
                    for doc, ids in Reader(f, size).documents():
                        rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype("<i4"),) if with_ids else ()))
                        at, held = at + len(ids), held + len(ids) * with_ids
                        if len(rows) >= 8192 or held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return m.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
