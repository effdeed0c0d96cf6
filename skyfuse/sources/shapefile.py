"""Polygon shapefiles as a Spark data source, by the published file format (.shp with .dbf beside it)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Shape codes of polygons without and with heights (fixed values).
POLYGON, POLYGON_Z = 5, 15


def read_shapes(data: bytes) -> Iterator[tuple[list[list[float]], list[list[float]] | None]]:
    """(rings, heights or None) of each record; records of other kinds have no rings."""
    at = 100
    while at + 12 <= len(data):
        _, words = struct.unpack_from(">ii", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        rings: list[list[float]] = []
        heights = None
        if kind in (POLYGON, POLYGON_Z):
            n_parts, n = struct.unpack_from("<ii", data, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 52), n]
            xy = struct.unpack_from(f"<{2 * n}d", data, at + 52 + 4 * n_parts)
            rings = [list(xy[2 * a : 2 * b]) for a, b in zip(starts, starts[1:], strict=False) if b - a >= 3]
            if kind == POLYGON_Z:
                z = struct.unpack_from(f"<{n}d", data, at + 52 + 4 * n_parts + 16 * n + 16)
                heights = [list(z[a:b]) for a, b in zip(starts, starts[1:], strict=False) if b - a >= 3]
        yield rings, heights
        at += 8 + 2 * words


def read_rows(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Attribute rows as text by field name; deleted rows too, so that they stay in step with the shapes."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16]))
    for k in range(n):
        at, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = data[at : at + width].decode(encoding, "replace").strip()
            at += width
        yield row


def write_shapes(rings: list[list[list[float]]]) -> bytes:
    """A polygon file of the given segmentations."""
    body = b""
    every = [v for s in rings for r in s for v in r] or [0.0, 0.0]
    bounds = (min(every[::2]), min(every[1::2]), max(every[::2]), max(every[1::2]))
    for k, seg in enumerate(rings):
        flat = [v for r in seg for v in r]
        own = (min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2]))
        starts, at = [], 0
        for r in seg:
            starts.append(at)
            at += len(r) // 2
        rec = struct.pack("<i4d2i", POLYGON, *own, len(seg), at) + struct.pack(f"<{len(seg)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat)
        body += struct.pack(">ii", k + 1, len(rec) // 2) + rec
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, POLYGON, *bounds, 0, 0, 0, 0) + body


class Shapefile(DataSource):
    """``spark.read.format("polygons").option("paths", "a.shp,b.shp").load()``: seq_in_file, file, seg, seg_z, fields (map of text).

    One partition for each file; paths are read through pyarrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> str:
        return "file string, seq_in_file long, seg array<array<double>>, seg_z array<array<double>>, fields map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = sorted(paths)

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path)
        shp = store.open_input_file(path).read()
        side = path[:-4] + ".dbf"
        rows = list(read_rows(store.open_input_file(side).read())) if store.get_file_info(side).type == fs.FileType.File else []
        for k, (rings, z) in enumerate(read_shapes(shp)):
            if rings:
                yield partition.path, k, rings, z, rows[k] if k < len(rows) else {}
