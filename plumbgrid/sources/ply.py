"""PLY point clouds: header layout, a data source that reads only what is asked for, and a reader for any store.

The data source ``ply`` reads a file, or a folder of record parts with a manifest (see :mod:`plumbgrid.sinks.records`), by
ranges of records.  Of these it reads only the ranges that filters on ``point_id`` leave and, for a preview, only the
windows of its strata; only the columns of the requested schema become Arrow columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from plumbgrid.functions.hashing import split_mix_words

# scalar type names of the format (fixed values) -> NumPy little-endian type
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
# Spark has no unsigned types: each goes to the next wider one
SPARK = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
WIDE = {"i1": np.int8, "u1": np.int16, "i2": np.int16, "u2": np.int32, "i4": np.int32, "u4": np.int64, "f4": np.float32, "f8": np.float64}
HEADER_BYTES = 1 << 20
#: Records of an oriented point as fusion writes them (fixed layout, 27 bytes).
FUSED = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]


class Layout:
    """What a header says: format, element counts, vertex record, bytes before the first record."""

    def __init__(self, head: bytes) -> None:
        end = head.find(b"end_header")
        eol = head.find(b"\n", end)
        if not head.startswith(b"ply") or end < 0 or eol < 0:
            raise ValueError("no PLY header within the first megabyte")
        self.offset = eol + 1
        self.counts: dict[str, int] = {}
        self.fields: list[tuple[str, str]] = []
        self.format = ""
        element = ""
        for line in head[:eol].decode("ascii", "replace").splitlines():
            word = line.split()
            if not word:
                continue
            if word[0] == "format":
                self.format = word[1]
            elif word[0] == "element":
                element = word[1]
                if element == "vertex" and self.counts:
                    raise ValueError("vertices must come first")
                self.counts[element] = int(word[2])
            elif word[0] == "property" and element == "vertex":
                if word[1] == "list" or word[1] not in TYPES:
                    raise ValueError(f"vertex property {' '.join(word[1:])} is not scalar")
                self.fields.append((word[2], TYPES[word[1]]))
        if "vertex" not in self.counts:
            raise ValueError("no vertices declared")

    @property
    def count(self) -> int:
        return self.counts["vertex"]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.fields)

    def ddl(self) -> str:
        return "point_id bigint, " + ", ".join(f"`{n}` {SPARK[t.lstrip('<')]}" for n, t in self.fields)

    def require_fused(self) -> None:
        if self.fields != FUSED:
            raise ValueError("not an oriented fused cloud")


#: Name of the list of parts in a folder of records.
MANIFEST = "records.json"


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI (local, hdfs, s3, gs, abfss: what Arrow reaches) and the path in it."""
    if "://" in path or path.startswith("file:/"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def open_random(path: str) -> pa.NativeFile:
    store, inner = locate(path)
    return store.open_input_file(inner)


class Records:
    """Where the records of a cloud lie: one file behind its header, or the parts that a manifest lists."""

    def __init__(self, path: str) -> None:
        store, inner = locate(path)
        if store.get_file_info(inner).type == pafs.FileType.Directory:
            with store.open_input_file(f"{inner}/{MANIFEST}") as f:
                said = json.loads(f.read())
            self.layout = Layout(said["header"].encode("latin-1"))
            base = path.rstrip("/")
            self.segments = [(f"{base}/{p['file']}", 0, int(p["first"]), int(p["count"])) for p in said["parts"]]
        else:
            with store.open_input_file(inner) as f:
                self.layout = Layout(f.read_at(min(HEADER_BYTES, f.size()), 0))
            self.segments = [(path, self.layout.offset, 0, self.layout.count)]
        self.count = self.layout.count


def read_layout(path: str) -> Layout:
    return Records(path).layout


def counts(path: str) -> tuple[int, int]:
    """Declared vertices and faces; 0 where undeclared."""
    c = read_layout(path).counts
    return c.get("vertex", 0), c.get("face", 0)


def _arrow(a: np.ndarray, first: int, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(np.arange(first, first + len(a), dtype=np.int64))]
    for n, t in a.dtype.descr:
        cols.append(pa.array(np.ascontiguousarray(a[n]).astype(WIDE[np.dtype(t).str.lstrip("<|")])))
    return pa.RecordBatch.from_arrays(cols, names=["point_id", *names])


PREVIEW_SEED, JITTER_SEED = 0x6A09E667F3BCC909, 0x517CC1B727220A95  # fixed values of the preview sample


class Strata:
    """The rows of a preview sample, stratum by stratum: what a task needs to know of ``preview_indices``.

    ``target`` of ``total`` rows are dealt to equal strata.  A stratum's rows come from one window, eight times as wide as
    its number of rows and placed by hash; the window has a bin for each row, and a hash picks the row in its bin.
    """

    def __init__(self, total: int, target: int, block_count: int) -> None:
        self.total, self.target = total, min(max(target, 0), total)
        self.groups = min(self.target, max(1, block_count, -(-self.target // 64)))

    def sizes(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the strata ``g`` and the number of rows in those before them."""
        each, more = divmod(self.target, self.groups)
        return each + (g < more), g * each + np.minimum(g, more)

    def rows(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of the strata ``low`` to ``high`` (exclusive) and the stratum of each."""
        g = np.arange(low, high, dtype=np.int64)
        take, before = self.sizes(g)
        left, right = g * self.total // self.groups, (g + 1) * self.total // self.groups
        width = np.minimum(right - left, 8 * take)
        spare = (right - left - width + 1).astype(np.uint64)
        left = left + (split_mix_words(g.astype(np.uint64) + np.uint64(PREVIEW_SEED)) % spare).astype(np.int64)
        owner = np.repeat(np.arange(len(g)), take)
        number = np.arange(before[0], before[0] + take.sum()) if len(g) else np.zeros(0, np.int64)
        nth, w, t = number - before[owner], width[owner], take[owner]
        edge = nth * w // t
        room = np.maximum((nth + 1) * w // t - edge, 1).astype(np.uint64)
        jitter = split_mix_words(number.astype(np.uint64) + np.uint64((PREVIEW_SEED + JITTER_SEED) % 2**64)) % room
        return left[owner] + edge + jitter.astype(np.int64), g[owner]


class _Range(InputPartition):
    """Rows from ``first`` to ``last``, or the strata of these numbers."""

    def __init__(self, first: int, last: int, strata: bool = False) -> None:
        self.first, self.last, self.strata = first, last, strata


STEP = 65536


class PlyReader(DataSourceReader):
    """Reads ranges of records; ``bytes_read`` tells what a task has taken from the store."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.records = Records(options["path"])
        self.rows = max(1, int(options.get("rowsperpartition", 1_000_000)))
        lay = self.records.layout
        if lay.format != "binary_little_endian":
            raise ValueError("only binary little-endian files are read in ranges")
        known = {"point_id", *(n for n, _ in lay.fields)}
        if missing := [f.name for f in schema.fields if f.name not in known]:
            raise ValueError(f"the cloud has no {', '.join(missing)}")
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)
        self.low, self.high = max(0, int(options.get("first", 0))), min(self.records.count, int(options.get("last", self.records.count)))
        self.only: list[int] | None = None
        self.masks: list[tuple[str, str, object]] = []
        self.strata = Strata(self.records.count, int(options["strata"]), int(options.get("blocks", 128))) if options.get("strata") else None
        self.bytes_read = 0

    def partitions(self) -> list[_Range]:
        if self.only is not None:
            ids = sorted({i for i in self.only if self.low <= i < self.high})
            starts = [i for k, i in enumerate(ids) if not k or ids[k - 1] + 1 != i]
            stops = [i + 1 for k, i in enumerate(ids) if k + 1 == len(ids) or ids[k + 1] != i + 1]
            return [_Range(a, b) for a, b in zip(starts, stops)] or [_Range(0, 0)]
        if self.strata is not None and self.strata.groups:
            s = self.strata
            # the strata that can have rows between low and high
            a, b = max(0, self.low * s.groups // s.total - 1), min(s.groups, -(-self.high * s.groups // s.total) + 1)
            step = max(1, self.rows * s.groups // s.target)
            return [_Range(g, min(g + step, b), True) for g in range(a, b, step)] or [_Range(0, 0)]
        return [_Range(a, min(a + self.rows, self.high)) for a in range(self.low, self.high, self.rows)] or [_Range(0, 0)]

    def _fetch(self, files: dict[str, pa.NativeFile], first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        """Records of the rows from ``first`` to ``last`` with the number of the first of each piece."""
        dtype = self.records.layout.dtype
        for path, offset, start, n in self.records.segments:
            a, b = max(first, start), min(last, start + n)
            if a >= b:
                continue
            if path not in files:
                files[path] = open_random(path)
            data = files[path].read_at((b - a) * dtype.itemsize, offset + (a - start) * dtype.itemsize)
            if len(data) < (b - a) * dtype.itemsize:
                raise ValueError("the file is cut short")
            self.bytes_read += len(data)
            yield a, np.frombuffer(data, dtype=dtype)

    def _batch(self, a: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        keep = np.ones(len(a), dtype=bool)
        for name, sign, value in self.masks:
            c = ids if name == "point_id" else a[name]
            hit = {"==": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[sign]
            keep &= hit | (c != c)  # Spark's order of NaN is left to Spark
        if not keep.all():
            a, ids = a[keep], ids[keep]
        column = lambda f: pa.array(ids if f.name == "point_id" else np.ascontiguousarray(a[f.name]).astype(WIDE[a.dtype[f.name].str.lstrip("<|")])).cast(f.type)
        return pa.RecordBatch.from_arrays([column(f) for f in self.schema], schema=self.schema)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}
        try:
            if not partition.strata:
                for a in range(partition.first, partition.last, STEP):
                    for first, data in self._fetch(files, a, min(a + STEP, partition.last)):
                        yield self._batch(data, np.arange(first, first + len(data)))
                return
            for g in range(partition.first, partition.last, 256):
                rows, _ = self.strata.rows(g, min(g + 256, partition.last))
                rows = np.unique(rows[(rows >= self.low) & (rows < self.high)])  # with nearly all rows asked for, bins may share one
                # rows less than a few records apart are fetched together
                for part in np.split(rows, np.flatnonzero(np.diff(rows) > 64) + 1):
                    if len(part):
                        for first, data in self._fetch(files, int(part[0]), int(part[-1]) + 1):
                            own = part[(part >= first) & (part < first + len(data))]
                            yield self._batch(data[own - first], own)
        finally:
            for f in files.values():
                f.close()


class PushedPlyReader(PlyReader):
    """The reader for sessions that push filters to Python sources (``spark.sql.python.filterPushdown.enabled``)."""

    def pushFilters(self, filters):
        """Comparisons of ``point_id`` choose records; those of other columns spare rows, and Spark checks them again."""
        signs = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        names = {"point_id", *(n for n, _ in self.records.layout.fields)}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "point_id" and isinstance(f, In):
                ids = [int(v) for v in f.value if v is not None]
                self.only = ids if self.only is None else [i for i in self.only if i in set(ids)]
            elif name == "point_id" and type(f) in signs:
                v = int(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, v + (not isinstance(f, LessThan)))
            else:
                if name in names and type(f) in signs and isinstance(f.value, (int, float)) and f.value == f.value:
                    self.masks.append((name, signs[type(f)], f.value))
                yield f


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class PlySource(DataSource):
    """``spark.read.format("ply")`` with the options ``path``, ``rowsPerPartition``, ``first``, ``last``, ``strata``, ``blocks`` and ``pushdown``.

    ``.schema(...)`` with some of the columns (``point_id`` and the fields of the header) reads these only.  ``strata``: the
    number of rows of a preview sample over ``blocks`` strata or more.  All executors must reach the path, by any store
    that Arrow reads; :func:`read_ply_files` reads whole files from any store that Spark reads.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return read_layout(self.options["path"]).ddl()

    def reader(self, schema):
        kind = PushedPlyReader if self.options.get("pushdown") == "true" else PlyReader
        return kind({k.lower(): v for k, v in self.options.items()}, schema)


def read_ply(
    spark: SparkSession, path: str, rows_per_partition: int = 1_000_000, columns: list[str] | None = None, strata: int = 0, blocks: int = 128, rows: tuple[int, int] | None = None, pushdown: bool = False
) -> DataFrame:
    """The points of a PLY file or record folder: ``point_id`` and the fields, or only ``columns``.

    ``rows`` are the first row number and the one after the last; ``strata`` makes it a sample.  With ``pushdown`` filters
    choose the records, if the session has ``spark.sql.python.filterPushdown.enabled``; such a DataFrame is for one query,
    as Spark 4.1 keeps the reader of the last pushed filters for a later query that pushes none.
    """
    spark.dataSource.register(PlySource)
    r = spark.read.format("ply").option("path", path).option("rowsPerPartition", rows_per_partition)
    if columns is not None:
        kinds = dict(c.replace("`", "").split(" ") for c in read_layout(path).ddl().split(", "))
        r = r.schema(", ".join(f"`{c}` {kinds[c]}" for c in columns))
    if strata:
        r = r.option("strata", strata).option("blocks", blocks)
    if rows is not None:
        r = r.option("first", rows[0]).option("last", rows[1])
    return r.option("pushdown", "true" if pushdown and spark.conf.get(PUSHDOWN, "false") == "true" else "false").load()


def preview_ply(spark: SparkSession, path: str, most: int = 1_000_000, block_count: int = 128, default: int = 185) -> tuple[DataFrame, int]:
    """A preview of at most ``most`` points (``point_id, x, y, z, r, g, b``) and the number of all.

    Only the strata's records are read: up to twice ``most`` (500,000 more at most), of which the spatially balanced ones
    stay.  A cloud that is small enough comes whole.  Colours are cut to 0..255; without all three fields they are ``default``.
    """
    from plumbgrid.operators.sampling import spatially_balanced

    lay = read_layout(path)
    names = [n for n, _ in lay.fields]
    if not {"x", "y", "z"} <= set(names):
        raise ValueError("the cloud has no coordinates")
    tinted = {"red", "green", "blue"} <= set(names)
    total, target = lay.count, min(lay.count, max(1, most))
    some = min(total, target + min(target, 500_000))
    own = read_ply(spark, path, columns=["point_id", "x", "y", "z", *(["red", "green", "blue"] if tinted else [])], strata=some if some < total else 0, blocks=block_count)
    cut = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.col(c).cast("int"))).cast("smallint")
    shade = lambda c: (cut(c) if tinted else F.lit(default).cast("smallint")).alias(c[0])
    points = own.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[shade(c) for c in ("red", "green", "blue")])
    return (spatially_balanced(points, target, "point_id") if some > target else points), total


def parse_ply(content: bytes) -> np.ndarray:
    """Vertices of a whole file, binary or ASCII."""
    lay = Layout(content[:HEADER_BYTES])
    if lay.format == "binary_little_endian":
        if len(content) < lay.offset + lay.count * lay.dtype.itemsize:
            raise ValueError("the file is cut short")
        return np.frombuffer(content, dtype=lay.dtype, count=lay.count, offset=lay.offset)
    if lay.format != "ascii":
        raise ValueError(f"format {lay.format} is not read")
    out = np.zeros(lay.count, dtype=lay.dtype)
    rows = content[lay.offset :].decode("ascii").splitlines()[: lay.count]
    for i, row in enumerate(rows):
        out[i] = tuple(np.dtype(t).type(float(v)) for v, (_, t) in zip(row.split(), lay.fields))
    return out


def read_ply_files(spark: SparkSession, path: str, sample: bytes | None = None) -> DataFrame:
    """All PLY files of one layout under ``path``, by Spark's own reader: ``path`` and the vertex fields, file by file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path)
    head = sample if sample is not None else bytes(files.select(F.substring("content", 1, HEADER_BYTES)).first()[0])
    lay = Layout(head)
    names = [n for n, _ in lay.fields]

    def run(batches):
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content")):
                a = parse_ply(c.as_buffer().to_pybytes())
                if a.dtype != lay.dtype:
                    raise ValueError(f"{p}: another layout than the first file's")
                for i in range(0, len(a), 65536):
                    rb = _arrow(a[i : i + 65536], i, names)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * rb.num_rows), *rb.columns], names=["path", *rb.schema.names])

    return files.select("path", "content").mapInArrow(run, "path string, " + lay.ddl())


def colored_points(ply: DataFrame, default: int = 180) -> DataFrame:
    """``point_id, x, y, z`` as doubles and ``r, g, b`` from 0 to 255; colours given as shares of 1 are scaled."""
    kinds = dict(ply.dtypes)
    out = [F.col("point_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]]
    for short, name in (("r", "red"), ("g", "green"), ("b", "blue")):
        own = next((c for c in (name, short, f"diffuse_{name}") if c in kinds), None)
        if own is None:
            out.append(F.lit(default).cast("smallint").alias(short))
            continue
        c = F.col(own)
        if kinds[own] in ("float", "double"):
            c = F.when(c <= 1.0, c * 255.0).otherwise(c)
        out.append(F.least(F.lit(255), F.greatest(F.lit(0), F.coalesce(c.cast("int"), F.lit(default)))).cast("smallint").alias(short))
    return ply.select(*out)
