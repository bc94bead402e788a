"""The matcher's SQLite database as tables.

A database is one small-to-medium file; it is read by Spark as a binary file and opened from a temporary copy in the
task that got it, so any store will do, and several databases (one per block) are read in parallel.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from plumbgrid.functions.scalars import WGS84_A, WGS84_E2

PAIR_BASE = 2147483647


def _scan(spark: SparkSession, path: str, schema: str, rows: Callable[[sqlite3.Connection], list[tuple]]) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:
                    f.write(content)
                try:
                    con = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    try:
                        out = rows(con)
                    except sqlite3.OperationalError:  # no such table: nothing in it
                        out = []
                    finally:
                        con.close()
                finally:
                    os.unlink(f.name)
                for i in range(0, len(out), 5000):
                    yield pd.DataFrame(out[i : i + 5000], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, "image_id long, camera_id long, name string", lambda c: c.execute("SELECT image_id, camera_id, name FROM images ORDER BY image_id").fetchall())


def decode_descriptors(kind: int, rows: int, cols: int, data: bytes | None) -> list[list[float]] | None:
    """Matrix of a blob: type 1 holds 32-bit floats (columns in bytes), others bytes; None where the size is wrong."""
    if not data or rows <= 0:
        return None
    dim = cols // 4 if kind == 1 else cols
    dtype = "<f4" if kind == 1 else "u1"
    if dim <= 0 or len(data) != rows * dim * np.dtype(dtype).itemsize:
        return None
    return np.frombuffer(data, dtype=dtype).reshape(rows, dim).astype(np.float32).tolist()


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, d``: one row per descriptor; blobs of a wrong size are left out."""

    def rows(con: sqlite3.Connection) -> list[tuple]:
        have = {r[1] for r in con.execute("PRAGMA table_info(descriptors)")}
        kind = "type" if "type" in have else "0"
        out = []
        for i, k, r, c, data in con.execute(f"SELECT image_id, {kind}, rows, cols, data FROM descriptors ORDER BY image_id"):
            out += [(i, d) for d in decode_descriptors(k, r, c, data) or []]
        return out

    return _scan(spark, path, "image_id long, d array<float>", rows)


def geodetic_to_cartesian(lat: float, lon: float, alt: float) -> tuple[float, float, float]:
    la, lo = np.radians(lat), np.radians(lon)
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(la) ** 2)
    return float((n + alt) * np.cos(la) * np.cos(lo)), float((n + alt) * np.cos(la) * np.sin(lo)), float((n * (1 - WGS84_E2) + alt) * np.sin(la))


def read_pose_priors(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, x, y, z`` in metres; geodetic positions (system 0: latitude, longitude, height) are converted."""

    def rows(con: sqlite3.Connection) -> list[tuple]:
        have = {r[1] for r in con.execute("PRAGMA table_info(pose_priors)")}
        key = "corr_data_id" if "corr_data_id" in have else "image_id"
        out = []
        for i, blob, system in con.execute(f"SELECT {key}, position, coordinate_system FROM pose_priors"):
            if blob is None or len(blob) != 24:
                continue
            p = np.frombuffer(blob, dtype="<f8")
            if np.isfinite(p).all():
                out.append((i, *(geodetic_to_cartesian(*p) if system == 0 else map(float, p))))
        return out

    return _scan(spark, path, "image_id long, x double, y double, z double", rows)


def read_pairs(spark: SparkSession, path: str, table: str = "two_view_geometries") -> DataFrame:
    """``src, dst, rows`` of matches or verified geometries."""
    if table not in ("matches", "two_view_geometries"):
        raise ValueError(f"unknown table {table}")

    def rows(con: sqlite3.Connection) -> list[tuple]:
        return [((p - p % PAIR_BASE) // PAIR_BASE, p % PAIR_BASE, r) for p, r in con.execute(f"SELECT pair_id, rows FROM {table}")]  # noqa: S608

    return _scan(spark, path, "src long, dst long, rows long", rows)


def table_count(spark: SparkSession, path: str, table: str) -> int:
    """Rows of a table, 0 if it cannot be read."""
    if not table.isidentifier():
        return 0
    r = _scan(spark, path, "n long", lambda c: c.execute(f"SELECT count(*) FROM {table}").fetchall()).first()  # noqa: S608
    return int(r["n"]) if r else 0
