"""Smaller sources: photo discovery, control CSV, dense maps, block configurations, event lines, manifests, caches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.functions.scalars import valid_geodetic

PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")


def discover_photos(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Photo files by extension, in any letter case, sorted by lower-cased path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    own = files.where(F.lower("path").rlike(r"\.(" + "|".join(PHOTO_EXTENSIONS) + r")$"))
    return own.select("path", "modificationTime", "length", *(["content"] if content else [])).orderBy(F.lower("path"))


def _first(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns that exist."""
    have = {c.lower().lstrip("﻿"): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_control_csv(spark: SparkSession, path: str) -> DataFrame:
    """Control and check points from a CSV with aliased headings.

    ``role`` is check for ``check`` (or its Chinese name), else control.  Rows with longitude and latitude are geographic.
    ``problem`` names what makes a row unusable: no model coordinates, no target, or no valid geographic position.
    """
    d = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    num = lambda *names: _first(d, *names).try_cast("double")
    lon, lat = num("longitude", "lon"), num("latitude", "lat")
    geo = lon.isNotNull() & lat.isNotNull()
    target = [F.when(geo, g).otherwise(c) for g, c in ((lon, num("x", "target_x")), (lat, num("y", "target_y")), (num("height", "altitude"), num("z", "target_z")))]
    sigma = [num(f"sigma_{c}") for c in "xyz"]
    full = sigma[0].isNotNull() & sigma[1].isNotNull() & sigma[2].isNotNull()
    out = d.select(
        F.coalesce(_first(d, "point_id", "id"), F.lit("")).alias("point_id"),
        F.when(F.lower(_first(d, "role")).isin("check", "检查点"), "check").otherwise("control").alias("role"),
        *[num(f"model_{c}").alias(f"m{c}") for c in "xyz"],
        *[t.alias(f"t{c}") for t, c in zip(target, "xyz")],
        *[F.when(full, s).alias(f"s{c}") for s, c in zip(sigma, "xyz")],
        geo.alias("geographic"),
        F.coalesce(_first(d, "target_crs", "crs"), F.when(~geo, "LOCAL_CARTESIAN")).alias("crs"),
        F.monotonically_increasing_id().alias("seq"),  # order in the file
    )
    no_model = F.col("mx").isNull() | F.col("my").isNull() | F.col("mz").isNull()
    no_target = F.col("tx").isNull() | F.col("ty").isNull() | F.col("tz").isNull()
    off = F.col("geographic") & ~valid_geodetic(F.col("tx"), F.col("ty"), F.col("tz"))
    return out.withColumn("problem", F.when(no_model, "no model coordinates").when(no_target, "no target coordinates").when(off, "position out of range"))


def check_mixing(control: DataFrame) -> DataFrame:
    """Refuse tables in which a projected target follows a geographic one; the other order is let pass."""
    order = control.agg(F.min(F.when(F.col("geographic"), F.col("seq"))).alias("first"), F.max(F.when(~F.col("geographic"), F.col("seq"))).alias("last")).first()
    if order["first"] is not None and order["last"] is not None and order["last"] > order["first"]:
        raise ValueError("projected targets must not follow geographic ones")
    return control


def dense_map_valid(content: Column, length: Column) -> Column:
    """``width&height&channels&`` and at least that many 32-bit values behind it."""
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    n = lambda k: F.regexp_extract(head, r"^(\d{1,9})&(\d{1,9})&(\d{1,3})&", k).try_cast("long")
    header = F.length(F.regexp_extract(head, r"^(\d{1,9}&\d{1,9}&\d{1,3}&)", 1))
    size = F.try_multiply(F.try_multiply(n(1), n(2)), n(3) * 4)
    return F.coalesce((n(1) > 0) & (n(2) > 0) & (n(3) > 0) & (length >= header + size), F.lit(False))


def dense_maps(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``name, depth, normal``: validity of the depth and normal maps of a kind (photometric or geometric)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}.bin").load(root)
    m = files.select(
        F.regexp_extract("path", r"/(depth_maps|normal_maps)/", 1).alias("folder"), F.regexp_extract("path", rf"/(?:depth_maps|normal_maps)/(.+)\.{kind}\.bin$", 1).alias("name"),
        dense_map_valid(F.col("content"), F.col("length")).alias("valid"), "length",
    ).where("folder != ''")
    has = lambda f: F.coalesce(F.max(F.when(F.col("folder") == f, F.col("valid"))), F.lit(False))
    return m.groupBy("name").agg(has("depth_maps").alias("depth"), has("normal_maps").alias("normal"), F.sum("length").alias("bytes"))


def pending_maps(names: DataFrame, maps: DataFrame) -> DataFrame:
    """Names without both maps valid."""
    return names.join(maps.where("depth and normal").select("name"), "name", "left_anti")


def releasable_maps(blocks: DataFrame, finished: int) -> DataFrame:
    """Names that no block after ``finished`` uses, so that their maps can go."""
    return blocks.groupBy("name").agg(F.max("block").alias("last_block")).where(F.col("last_block") <= finished)


def read_name_source_pairs(lines: DataFrame) -> DataFrame:
    """``pos, value`` lines of a source configuration -> ``name, sources``; an odd number of lines is refused."""
    clean = lines.where(F.trim("value") != "").select(F.col("pos").alias("line"), F.trim("value").alias("value"))
    from plumbgrid.operators.captures import positions

    n = positions(clean, "line").select("value", "pos").withColumns({"row": F.floor(F.col("pos") / 2), "side": F.pmod("pos", F.lit(2))})
    if clean.count() % 2:
        raise ValueError("a reference without sources")
    g = n.groupBy("row").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("s"))
    return g.select("name", F.split("s", r"\s*,\s*").alias("sources"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value`` of a small text file, byte-order mark removed."""
    w = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("t"))
    return w.select(F.posexplode(F.split("t", r"\r?\n")).alias("pos", "value"))


def read_fusion_names(spark: SparkSession, path: str) -> DataFrame:
    n = read_numbered_lines(spark, path).select("pos", F.trim("value").alias("name")).where("name != ''")
    if n.count() != n.select("name").distinct().count():
        raise ValueError("repeated names")
    return n


EVENT = "type string, time double, value double, message string, stage string, details string"


def parse_events(lines: DataFrame, *carried: str) -> DataFrame:
    """JSON event lines (batch or stream): known fields; lines that are no event become log events with the raw text."""
    e = lines.select(*carried, "value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    bad = F.col("e.type").isNull()
    return e.select(
        *carried,
        F.when(bad, "log").otherwise(F.col("e.type")).alias("type"), F.col("e.time").alias("time"), F.col("e.value").alias("value"), F.when(bad, F.col("value")).otherwise(F.col("e.message")).alias("message"), "e.stage"
    )


def read_manifest(spark: SparkSession, path: str, newest: int = 4) -> dict:
    """A JSON document with a version that this code knows."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if int(doc.get("version", 1)) > newest:
        raise ValueError("the project is of a newer version")
    return doc


def reusable_cache(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """A Parquet cache that was written for the same inputs, else None."""
    try:
        seen = spark.read.text(f"{path}/fingerprint", wholetext=True).first()
    except Exception:  # noqa: BLE001  nothing there yet
        return None
    return spark.read.parquet(f"{path}/rows") if seen and seen[0].strip() == fingerprint else None


def write_cache(df: DataFrame, path: str, fingerprint: str) -> None:
    """Rows first, fingerprint last: a cache cut short never counts."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")
