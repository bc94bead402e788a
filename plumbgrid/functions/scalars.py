"""Scalar functions on metadata, geometry and text: pure column expressions without actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- metadata -----------------------------------------------------------------------------------------------------


def metadata_value(top: Column, nested: Column, default: Column) -> Column:
    """First of the top-level and nested values that is neither null nor empty, else the default."""
    return F.coalesce(F.nullif(top, F.lit("")), F.nullif(nested, F.lit("")), default)


def finite_float(text: Column) -> Column:
    """A number, or null where the text is none or not finite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def vendor_attribute(content: Column, name: str) -> Column:
    """A quoted attribute within the first MiB of a file's text; either kind of quote, any letter case."""
    head = F.decode(F.substring(content, 1, 1 << 20), "ISO-8859-1")
    return F.nullif(F.regexp_extract(head, rf"(?is)\b{name}\s*=\s*([\"'])(.*?)\1", 2), F.lit(""))


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as signed degrees; south and west are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def altitude_reference(raw: Column) -> Column:
    """The integer written in the text, or that of a single byte 0 or 1; null otherwise."""
    byte = F.when((F.length(raw) == 1) & F.ascii(raw).isin(0, 1), F.ascii(raw))
    return F.coalesce(F.trim(raw).try_cast("int"), byte)


def signed_altitude(altitude: Column, reference: Column) -> Column:
    return F.when(reference == 1, -F.abs(altitude)).otherwise(altitude)


def rtk_class(status: Column, flag: Column, lat: Column, lon: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """RTK_FIX, RTK_FLOAT, GPS or NONE; a fix needs all sigmas, 0.05 horizontally and 0.10 vertically at most."""
    rtk = F.upper(F.coalesce(status, F.lit(""))).contains("RTK") | (F.coalesce(flag, F.lit("")) != "")
    fix = (F.greatest(sx, sy) <= 0.05) & (sz <= 0.10) & sx.isNotNull() & sy.isNotNull() & sz.isNotNull()
    return (
        F.when(rtk & fix, "RTK_FIX").when(rtk, "RTK_FLOAT").when(lat.isNotNull() & lon.isNotNull(), "GPS").otherwise("NONE")
    )


def gps_record(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column, altitude: Column, altitude_ref: Column) -> Column:
    """Struct ``lat, lon, altitude`` from arrays of degrees, minutes and seconds as text.

    A missing part is null; one that is there but malformed makes the whole record null, as one wrong tag casts doubt on
    the others.
    """
    number = lambda a, k: F.get(a, k).try_cast("double")
    wrong = lambda a: a.isNotNull() & ((F.size(a) != 3) | reduce(lambda x, y: x | y, [number(a, k).isNull() for k in range(3)]))
    value = lambda a, ref: gps_decimal(number(a, 0), number(a, 1), number(a, 2), F.coalesce(ref, F.lit("")))
    height = finite_float(altitude)
    parts = {"lat": value(lat, lat_ref), "lon": value(lon, lon_ref), "altitude": F.when(altitude_reference(altitude_ref) == 1, -height).otherwise(height)}
    sound = ~(wrong(lat) | wrong(lon))
    return F.struct(*[F.when(sound, c).alias(n) for n, c in parts.items()])


# fixed values: attributes that drones write into a photo's metadata packet, and the names of their columns
VENDOR_NUMBERS = {
    "lat": "GpsLatitude", "lon": "GpsLongitude", "altitude": "AbsoluteAltitude", "sigma_x": "RtkStdLon", "sigma_y": "RtkStdLat", "sigma_z": "RtkStdHgt",
    "roll": "GimbalRollDegree", "pitch": "GimbalPitchDegree", "yaw": "GimbalYawDegree",
}


def vendor_record(content: Column, prefix: str = "drone-dji:") -> Column:
    """Struct of the vendor's position, its sigmas, attitude, ``rtk_status`` and ``source``; nulls and NONE without any."""
    get = lambda name: F.trim(vendor_attribute(content, prefix + name))
    n = {k: finite_float(get(name)) for k, name in VENDOR_NUMBERS.items()}
    status = rtk_class(get("GpsStatus"), get("RtkFlag"), n["lat"], n["lon"], n["sigma_x"], n["sigma_y"], n["sigma_z"])
    source = F.when(n["lat"].isNotNull() & n["lon"].isNotNull(), "vendor").otherwise("")
    return F.struct(*[c.alias(k) for k, c in n.items()], status.alias("rtk_status"), source.alias("source"))


# EXIF orientation: what a viewer has to do (fixed values of the format)
ORIENTATION = {
    2: "mirror horizontally",
    3: "rotate 180",
    4: "mirror vertically",
    5: "mirror horizontally, rotate 270",
    6: "rotate 90",
    7: "mirror horizontally, rotate 90",
    8: "rotate 270",
}


def orientation_label(code: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), list(ORIENTATION.items())[1:], F.when(code == 2, ORIENTATION[2])).otherwise("")


def capture_time(text: Column) -> Column:
    """Capture time in either notation, as ISO text; "" (which sorts first) where it cannot be read."""
    t = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    )
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


# --- names --------------------------------------------------------------------------------------------------------


def normalized_name(name: Column) -> Column:
    """Slashes forward, then all leading dots and slashes off."""
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), "^[./]+", "")


def safe_name(name: Column, default: str = "project") -> Column:
    """Usable as a file name: runs of characters that file systems refuse become one underscore."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit(default))


PAIR_BASE = 2147483647  # fixed value of the match database format


def pair_id(a: Column, b: Column) -> Column:
    """Packed id of an unordered image pair."""
    return F.least(a, b).cast("long") * PAIR_BASE + F.greatest(a, b)


def pair_members(pair: Column) -> tuple[Column, Column]:
    second = F.pmod(pair, F.lit(PAIR_BASE).cast("long"))
    return F.floor((pair - second) / PAIR_BASE).cast("long"), second


# --- geodesy and geometry -----------------------------------------------------------------------------------------

WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)


def ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of WGS-84 longitude and latitude (degrees) and ellipsoidal height (metres)."""
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1.0 - WGS84_E2 * F.sin(la) ** 2)
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1.0 - WGS84_E2) + h) * F.sin(la)


def local_enu(lon: Column, lat: Column, h: Column, origin: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """East, north and up (metres) from ``origin`` (lon, lat, h)."""
    o = [F.lit(float(v)) for v in origin]
    dx, dy, dz = (a - b for a, b in zip(ecef(lon, lat, h), ecef(*o)))
    la, lo = F.radians(o[1]), F.radians(o[0])
    return (
        -F.sin(lo) * dx + F.cos(lo) * dy,
        -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz,
        F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz,
    )


def valid_geodetic(lon: Column, lat: Column, h: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return ok(lon) & ok(lat) & ok(h) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)


def camera_center(q: tuple[Column, ...], t: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """``-R'T`` of a pose given by quaternion (w, x, y, z) and translation; the quaternion is normalised."""
    n = F.sqrt(q[0] ** 2 + q[1] ** 2 + q[2] ** 2 + q[3] ** 2)
    r = rotation_rows(*[c / n for c in q])
    return tuple(-(r[0][k] * t[0] + r[1][k] * t[1] + r[2][k] * t[2]) for k in range(3))


def view_direction(q: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    n = F.sqrt(q[0] ** 2 + q[1] ** 2 + q[2] ** 2 + q[3] ** 2)
    return rotation_rows(*[c / n for c in q])[2]


def rotation_rows(w: Column, x: Column, y: Column, z: Column) -> list[tuple[Column, Column, Column]]:
    return [
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    ]


def straight_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((p - q) ** 2 for p, q in zip(a, b)), F.lit(0.0)))


# --- review labels ------------------------------------------------------------------------------------------------

MIN_SHARPNESS, MAX_CLIPPED = 80.0, 0.08


def photo_warnings(sharpness: Column, dark: Column, bright: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(sharpness < MIN_SHARPNESS, "blurred"),
        F.when(dark > MAX_CLIPPED, "too dark"),
        F.when(bright > MAX_CLIPPED, "too bright"),
    )


def quality_ok(sharpness: Column, dark: Column, bright: Column) -> Column:
    return (sharpness >= MIN_SHARPNESS) & (dark <= MAX_CLIPPED) & (bright <= MAX_CLIPPED)


def exposure_label(dark: Column, bright: Column) -> Column:
    return F.when((dark <= MAX_CLIPPED) & (bright <= MAX_CLIPPED), "ok").otherwise("check")


def photo_status(valid: Column, selected: Column, warnings: Column) -> Column:
    """invalid before excluded before review before ok."""
    return (
        F.when(~valid, "invalid").when(~selected, "excluded").when(F.coalesce(warnings, F.lit("")) != "", "review").otherwise("ok")
    )


# Message parts of native tools that tell what failed (fixed values: their texts and exit codes)
OUT_OF_MEMORY = ("out of memory", "cudaerrormemoryallocation", "cuda_error_out_of_memory", "cuda error 2", "failed to allocate")
RETRY_FUSION = ("3221225495", "-1073741801", "0xc0000017", "3221226505", "-1073740791", "0xc0000409", "bad allocation", "std::bad_alloc")
RETRY_TEXTURE = ("3221226505", "0xc0000409", "atlas size:", "baking texture", "out of memory", "bad allocation", "std::bad_alloc")


def _any_of(message: Column, parts: tuple[str, ...]) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def is_out_of_memory(message: Column) -> Column:
    return _any_of(message, OUT_OF_MEMORY)


def is_retryable_fusion(message: Column) -> Column:
    return _any_of(message, OUT_OF_MEMORY + RETRY_FUSION)


def is_retryable_texture(message: Column) -> Column:
    return _any_of(message, RETRY_TEXTURE)


def stage_of(text: Column, phrases: list[tuple[str, str]], default: str = "") -> Column:
    """Stage of the first phrase, in the order given, that the text contains."""
    out = F.when(F.lit(False), "")
    for phrase, stage in phrases:
        out = out.when(text.contains(phrase), stage)
    return out.otherwise(default)


def view_progress(line: Column) -> tuple[Column, Column]:
    """The two numbers of ``Processing view a / b``, null elsewhere."""
    at = lambda k: F.regexp_extract(line, r"Processing view\s+(\d+)\s*/\s*(\d+)", k).try_cast("int")
    return at(1), at(2)


def telemetry(line: Column) -> Column:
    """Struct of a five-column telemetry line (memory in MB becomes GB, three digits); null if any field is unreadable."""
    p = F.split(line, r"\s*,\s*")
    num = lambda k: F.trim(F.get(p, F.lit(k))).try_cast("double")
    row = F.struct(
        F.trim(F.get(p, F.lit(0))).alias("name"), num(1).alias("utilization"), F.round(num(2) / 1024, 3).alias("used_gb"),
        F.round(num(3) / 1024, 3).alias("total_gb"), num(4).alias("temperature"),
    )
    return F.when((F.size(p) == 5) & num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull() & num(4).isNotNull(), row)


def workspace_bytes(width: Column, height: Column, size: Column, max_dim: int, geometric: bool) -> Column:
    """Bytes that the dense maps of one photo take, plus its own size; halves round to even."""
    scale = F.least(F.lit(1.0), F.lit(float(max_dim)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1).cast("long"), F.bround(v * scale).cast("long"))
    return side(width) * side(height) * (34 if geometric else 24) + size.cast("long")


def image_pixel(wx: Column, wy: Column, offset: tuple[float, float], scale: float, width: int, height: int) -> tuple[Column, Column]:
    """A widget position as an image pixel, clamped to the image."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, F.lit(float(top - 1))))
    return clamp((wx - offset[0]) / scale, width), clamp((wy - offset[1]) / scale, height)
