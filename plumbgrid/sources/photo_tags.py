"""Metadata of photographs from their bytes: JPEG segments, PNG chunks and TIFF directories; no pixel is decoded.

A pandas UDF finds the tags, as raw values, in batches that Spark cuts by size; what they mean (which directory wins, signs,
vendor attributes before tags) is said by column expressions.  A file that is cut, whose directories refer to each other, or
whose format is not known has ``problem`` set and no tags; a null content has neither.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.functions import scalars
from plumbgrid.workspace import bound_batches

# fixed values of the formats: tag numbers, and the size and struct code of each value type
ROOT_TAGS = {0x0100: "width", 0x0101: "height", 0x0110: "model", 0x0112: "orientation", 0x9003: "time", 0x920A: "focal", 0xA434: "lens"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "altitude_ref", 6: "altitude"}
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
TEXT_TYPES, RATIONAL_TYPES = (2, 7), {5: "II", 10: "ii"}

TAG_SCHEMA = (
    "width int, height int, orientation int, model string, model_nested string, lens string, lens_nested string, time string, time_nested string,"
    " focal string, focal_nested string, lat array<string>, lat_ref string, lon array<string>, lon_ref string, altitude string, altitude_ref string, problem string"
)
FIELDS = [f.split()[0] for f in TAG_SCHEMA.split(",")]


class Malformed(ValueError):
    """What is wrong with a file."""


def _take(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or at + n > len(data):
        raise Malformed("cut")
    return data[at : at + n]


def _values(tiff: bytes, order: str, kind: int, count: int, at: int) -> list[str | None]:
    """A tag's values as text; a fraction over zero is null."""
    if kind in TEXT_TYPES:
        return [_take(tiff, at, count).rstrip(b"\0").decode("latin-1")]
    if kind in RATIONAL_TYPES:
        pairs = struct.iter_unpack(order + RATIONAL_TYPES[kind], _take(tiff, at, 8 * count))
        return [repr(a / b) if b else None for a, b in pairs]
    size, code = TYPES[kind]
    return [str(v[0]) for v in struct.iter_unpack(order + code, _take(tiff, at, size * count))]


def _directory(tiff: bytes, order: str, at: int, wanted: dict[int, str], seen: set[int]) -> dict[str, list]:
    if at in seen:
        raise Malformed("directories form a loop")
    seen.add(at)
    n = struct.unpack(order + "H", _take(tiff, at, 2))[0]
    found = {}
    for tag, kind, count, inline in struct.iter_unpack(order + "HHI4s", _take(tiff, at + 2, 12 * n)):
        size = 1 if kind in TEXT_TYPES else 8 if kind in RATIONAL_TYPES else TYPES.get(kind, (0, ""))[0]
        if tag not in wanted or not size:
            continue
        short = size * count <= 4  # then the value stands in the entry itself
        found.setdefault(wanted[tag], _values(inline if short else tiff, order, kind, count, 0 if short else struct.unpack(order + "I", inline)[0]))
    return found


def tiff_tags(tiff: bytes) -> dict[str, object]:
    """Wanted tags of the first directory, of the nested one (``*_nested``) and of the position's."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(_take(tiff, 0, 4))
    if order is None:
        raise Malformed("no TIFF header")
    seen: set[int] = set()
    root = _directory(tiff, order, struct.unpack(order + "I", _take(tiff, 4, 4))[0], ROOT_TAGS | {EXIF_POINTER: "_exif", GPS_POINTER: "_gps"}, seen)

    def sub(key: str, wanted: dict[int, str]) -> dict[str, list]:
        at = root.get(key)
        if not at:
            return {}
        if not (at[0] or "").isdigit():
            raise Malformed("a directory's place is no number")
        return _directory(tiff, order, int(at[0]), wanted, seen)

    nested, gps = sub("_exif", ROOT_TAGS), sub("_gps", GPS_TAGS)
    first = lambda d, k: d[k][0] if d.get(k) else None
    out: dict[str, object] = {}
    for k in ("model", "lens", "time", "focal"):
        out[k], out[k + "_nested"] = first(root, k), first(nested, k)
    out |= {k: first(root, k) for k in ("width", "height", "orientation")}
    out |= {k: gps.get(k) if k in ("lat", "lon") else first(gps, k) for k in GPS_TAGS.values()}
    return out


def jpeg_parts(data: bytes) -> tuple[int | None, int | None, bytes]:
    """Width, height and the joined Exif payload of the segments before the first scan."""
    at, size, exif = 2, (None, None), b""
    while True:
        if _take(data, at, 1) != b"\xff":
            raise Malformed("no segment where one should start")
        marker = _take(data, at + 1, 1)[0]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker in (0xD9, 0xDA):
            return *size, exif
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            n = struct.unpack(">H", _take(data, at + 2, 2))[0]
            if n < 2:
                raise Malformed("a segment shorter than its own length")
            body = _take(data, at + 4, n - 2)
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", _take(body, 1, 4))
                size = (width, height)
            elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
                exif += body[6:]
            at += 2 + n


def png_parts(data: bytes) -> tuple[int | None, int | None, bytes]:
    """Width, height and Exif chunk."""
    at, size, exif = 8, (None, None), b""
    while True:
        n, kind = struct.unpack(">I4s", _take(data, at, 8))
        if kind == b"IEND":
            return *size, exif
        body = _take(data, at + 8, n)
        if kind == b"IHDR":
            size = struct.unpack(">II", _take(body, 0, 8))
        elif kind == b"eXIf":
            exif = body
        at += 12 + n


def file_tags(data: bytes | None) -> dict[str, object]:
    """The tags of one file."""
    if data is None:
        return {}
    data = bytes(data)
    try:
        if data[:4] in (b"II*\0", b"MM\0*"):
            return tiff_tags(data)
        if data[:2] == b"\xff\xd8":
            width, height, exif = jpeg_parts(data)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, exif = png_parts(data)
        else:
            raise Malformed("unknown format")
        return (tiff_tags(exif) if exif else {}) | {"width": width, "height": height}
    except Malformed as wrong:
        return {"problem": str(wrong)}


def raw_tags(content: Column) -> Column:
    """Struct of the tags as they stand in the file."""

    @F.pandas_udf(TAG_SCHEMA)
    def read(column: pd.Series) -> pd.DataFrame:
        rows = [file_tags(v) for v in column]
        out = pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in FIELDS})
        for k in ("width", "height", "orientation"):
            number = pd.to_numeric(out[k], errors="coerce")
            out[k] = number.where((number.abs() < 2**31) & (number % 1 == 0)).astype("Int32")
        return out

    return read(content)


def photo_metadata(files: DataFrame) -> DataFrame:
    """``files(content, ...)`` -> the other columns and each photo's metadata; ``content`` is dropped.

    Camera, lens, time and focal length come from the first directory that has them.  Position, its sigmas and attitude come
    from the vendor's packet where it has them, the rest from the tags; ``gps_source`` and ``rtk_status`` tell which.
    """
    bound_batches(files.sparkSession)
    d = files.withColumns({"_tag": raw_tags(F.col("content")), "_vendor": scalars.vendor_record(F.col("content"))})
    t, v = (lambda k: F.col(f"_tag.{k}")), (lambda k: F.col(f"_vendor.{k}"))
    text = lambda k: F.trim(scalars.metadata_value(t(k), t(k + "_nested"), F.lit("")))
    d = d.withColumn("_gps", scalars.gps_record(t("lat"), t("lat_ref"), t("lon"), t("lon_ref"), t("altitude"), t("altitude_ref")))
    place = {k: F.coalesce(v(k), F.col(f"_gps.{k}")) for k in ("lat", "lon", "altitude")}
    source = F.when(v("source") != "", v("source")).when(place["lat"].isNotNull() & place["lon"].isNotNull(), "EXIF").otherwise("")
    made = {
        "width": t("width"), "height": t("height"), "orientation": F.coalesce(F.nullif(t("orientation"), F.lit(0)), F.lit(1)),
        "captured_at": scalars.metadata_value(t("time"), t("time_nested"), F.lit("")), "camera_model": text("model"), "lens_model": text("lens"),
        "focal_length_mm": scalars.finite_float(F.coalesce(t("focal"), t("focal_nested"))), **place,
        **{k: v(k) for k in ("sigma_x", "sigma_y", "sigma_z", "roll", "pitch", "yaw")}, "gps_source": source,
        "rtk_status": F.when(v("rtk_status") != "NONE", v("rtk_status")).when(source != "", "GPS").otherwise("NONE"), "problem": t("problem"),
    }
    kept = [c for c in files.columns if c != "content" and c not in made]
    return d.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(k) for k, c in made.items()])
