"""Clouds written as record parts: every task writes its own file, the driver commits their list.

A data source writer with two phases.  A task packs its rows and writes one part under a name of its own; its message
says the part's name, its smallest point id and its number of records.  The driver orders the messages, counts the rows
and publishes the manifest by one rename.  Parts of lost or repeated tasks are not in the manifest, so a reader never
sees them; an aborted write removes its parts.  No record passes the driver.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from plumbgrid.sources.ply import FUSED, MANIFEST, locate

CLOUD = [*[(c, "<f8") for c in "xyz"], *[(c, "u1") for c in ("red", "green", "blue")]]


@dataclass
class Part(WriterCommitMessage):
    """What a task says of its part: the file, its smallest ``point_id`` and its records."""

    file: str
    lowest: int
    count: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.fields = [tuple(f) for f in json.loads(options["fields"])]
        self.pads = json.loads(options.get("pads", "[]"))
        self.note = options.get("note", "")

    def _dtype(self) -> np.dtype:
        return np.dtype([(n, t) for n, t in self.fields])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, inner = locate(self.path)
        store.create_dir(inner, recursive=True)
        name, lowest, count, out = f"part-{uuid.uuid4().hex}.bin", -1, 0, None
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if out is None:
                    out = store.open_output_stream(f"{inner}/{name}")
                    lowest = b.column("point_id")[0].as_py()
                a = np.zeros(b.num_rows, dtype=self._dtype())
                for n, _ in self.fields:
                    if n not in self.pads:
                        a[n] = b.column(n).to_numpy(zero_copy_only=False)
                out.write(a.tobytes())
                count += len(a)
        finally:
            if out is not None:
                out.close()
        return Part(name if count else "", lowest, count)

    def _parts(self, messages: list[Part | None]) -> list[dict]:
        parts, first = [], 0
        for m in sorted((m for m in messages if m is not None and m.count), key=lambda m: m.lowest):
            parts.append({"file": m.file, "first": first, "count": m.count})
            first += m.count
        return parts

    def commit(self, messages: list[Part | None]) -> None:
        store, inner = locate(self.path)
        store.create_dir(inner, recursive=True)
        parts = self._parts(messages)
        lines = ["ply", "format binary_little_endian 1.0", *self.note.splitlines(), f"element vertex {sum(p['count'] for p in parts)}"]
        lines += [f"property {'uchar' if t == 'u1' else 'double' if t == '<f8' else 'float'} {n}" for n, t in self.fields] + ["end_header\n"]
        document = {"header": "\n".join(lines), "parts": parts, "fields": self.fields}
        draft = f"{inner}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(document).encode())
        store.move(draft, f"{inner}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        store, inner = locate(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{inner}/{m.file}")


class RecordSink(DataSource):
    """``df.write.format("point_records")`` with ``path``, ``fields`` (JSON list of name and NumPy type), ``pads`` and ``note``."""

    @classmethod
    def name(cls) -> str:
        return "point_records"

    def writer(self, schema, overwrite):
        return RecordWriter(dict(self.options), overwrite)


def _put(points: DataFrame, path: str, fields: list[tuple[str, str]], note: str = "", pads: tuple[str, ...] = ()) -> None:
    points.sparkSession.dataSource.register(RecordSink)
    ordered = points.repartitionByRange("point_id").sortWithinPartitions("point_id")
    ordered.write.format("point_records").mode("overwrite").option("path", path).option("fields", json.dumps(fields)).option("pads", json.dumps(pads)).option("note", note).save()


def write_cloud(points: DataFrame, path: str, comments: tuple[str, ...] = ()) -> int:
    """``point_id, x, y, z, r, g, b`` as a folder of record parts (doubles and bytes) in id order; the number of points.

    ``spark.read.format("ply")`` reads the folder; :func:`join_parts` makes a single file of it.
    """
    d = points.select(F.col("point_id").cast("long").alias("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("smallint").alias(n) for c, n in zip("rgb", ("red", "green", "blue"))])
    note = "\n".join(f"comment {c}".encode("ascii", "replace").decode() for c in comments)
    _put(d, path, CLOUD, note)
    return manifest(path)[1]


def write_fused_cloud(points: DataFrame, path: str) -> int:
    """Oriented points (``point_id`` and the 27-byte record's fields) as a folder of record parts."""
    kinds = {"<f4": "float", "u1": "smallint"}
    _put(points.select(F.col("point_id").cast("long").alias("point_id"), *[F.col(n).cast(kinds[t]).alias(n) for n, t in FUSED]), path, FUSED)
    return manifest(path)[1]


#: Record of LAS point format 7 (fixed values): names of fields that stay zero have a capital.
LAS_RECORD = [
    ("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("Intensity", "<u2"), ("returns", "u1"), ("Flags", "u1"), ("Class", "u1"), ("User", "u1"), ("Angle", "<i2"), ("Source", "<u2"), ("Time", "<f8"),
    ("r16", "<u2"), ("g16", "<u2"), ("b16", "<u2"),
]
LAS_HEADER_BYTES = 375


def _las_header(count: int, scale: float, offsets: list[float], low: list[int], high: list[int], wkt: str) -> bytes:
    """Header of LAS 1.4 with counts of 64 bit, and the coordinate system as a WKT record."""
    crs = wkt.encode() + b"\0" if wkt else b""
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(crs), b"coordinate system") + crs if crs else b""
    start = LAS_HEADER_BYTES + len(record)
    box = [v for a, b, o in zip(high, low, offsets) for v in (a * scale + o, b * scale + o)]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 1 << 4 if crs else 0, 0, 0, 0, b"\0" * 8, 1, 4, b"plumbgrid".ljust(32, b"\0"), b"plumbgrid".ljust(32, b"\0"), 1, 2024, LAS_HEADER_BYTES, start, int(bool(crs)), 7, np.dtype(LAS_RECORD).itemsize, 0, *[0] * 5)
    head += struct.pack("<12d", *[scale] * 3, *offsets, *box) + struct.pack("<QQIQ15Q", 0, 0, 0, count, count, *[0] * 14)
    return head + record


def write_las_cloud(points: DataFrame, path: str, crs_wkt: str = "", scale: float = 0.001) -> int:
    """``point_id, x, y, z, r, g, b`` as LAS 1.4 records (point format 7) in a folder of parts; ``header.las`` lies beside them.

    Coordinates are quantised to ``scale``, offsets are the floors of the smallest ones, colours are times 257.  Without
    a coordinate system none is written.  Header and parts, in the manifest's order, are a LAS file: :func:`join_parts`.
    """
    from plumbgrid.sinks.files import las_records

    rec, offsets = las_records(points, scale)
    s = rec.agg(*[f(f"i{c}") for f in (F.min, F.max) for c in "xyz"]).first()
    low, high = [v or 0 for v in list(s)[:3]], [v or 0 for v in list(s)[3:]]
    own = rec.select(F.col("point_id").cast("long").alias("point_id"), *[f"i{c}" for c in "xyz"], *[f"{c}16" for c in "rgb"], F.lit(0x11).cast("smallint").alias("returns"))
    _put(own, path, LAS_RECORD, pads=tuple(n for n, _ in LAS_RECORD if n[0].isupper()))
    count = manifest(path)[1]
    store, inner = locate(path)
    with store.open_output_stream(f"{inner}/header.las") as f:
        f.write(_las_header(count, scale, offsets, low, high, crs_wkt))
    return count


def manifest(path: str) -> tuple[dict, int]:
    """The list of a folder's parts and the number of records in them."""
    store, inner = locate(path.rstrip("/"))
    with store.open_input_file(f"{inner}/{MANIFEST}") as f:
        said = json.loads(f.read())
    return said, sum(p["count"] for p in said["parts"])


def join_parts(path: str, target: str, header: bytes | None = None) -> None:
    """A single file of a folder's header and parts, for programs that need one; bytes are copied in bounded pieces."""
    said, _ = manifest(path)
    store, inner = locate(path.rstrip("/"))
    if header is None:
        header = said["header"].encode("latin-1")
        if store.get_file_info(f"{inner}/header.las").is_file:
            with store.open_input_file(f"{inner}/header.las") as f:
                header = f.read()
    to, name = locate(target)
    with to.open_output_stream(name) as out:
        out.write(header)
        for p in said["parts"]:
            with store.open_input_stream(f"{inner}/{p['file']}") as f:
                while piece := f.read(4 << 20):
                    out.write(piece)
