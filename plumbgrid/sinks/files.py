"""Writers.  Tables go through Spark's committers; single-file formats are assembled from ordered parts."""

from __future__ import annotations

import html
import json
import os
import struct
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.sources.ply import FUSED


def atomic_write(path: str, data: bytes) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, draft = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(draft, path)


def write_json(path: str, document: dict) -> None:
    atomic_write(path, json.dumps(document, ensure_ascii=False, indent=2).encode())


def _rows(df: DataFrame) -> Iterator:
    """Rows in order, a partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def _stream(path: str, header: bytes, chunks: Iterator[bytes]) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, draft = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "wb") as f:
        f.write(header)
        for c in chunks:
            f.write(c)
    os.replace(draft, path)


def _packed(points: DataFrame, dtype: list[tuple[str, str]]) -> DataFrame:
    """``part, data``: records of each partition as one binary, packed by the executors in id order."""
    import pandas as pd

    names = [n for n, _ in dtype]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.zeros(len(b), dtype=dtype)
            for n in names:
                a[n] = b[n].to_numpy()
            yield pd.DataFrame({"data": [a.tobytes()]})

    return points.repartitionByRange("point_id").sortWithinPartitions("point_id").select(*names).mapInPandas(run, "data binary")


def write_ply(points: DataFrame, path: str, comments: tuple[str, ...] = ()) -> int:
    """``point_id, x, y, z, r, g, b`` as a binary PLY (doubles and bytes) in id order."""
    d = points.select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("int").alias(c) for c in "rgb"])
    n = d.count()
    lines = ["ply", "format binary_little_endian 1.0", *[f"comment {c}".encode("ascii", "replace").decode() for c in comments], f"element vertex {n}"]
    lines += [f"property double {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")] + ["end_header"]
    packed = _packed(d, [*[(c, "<f8") for c in "xyz"], *[(c, "u1") for c in "rgb"]])
    _stream(path, ("\n".join(lines) + "\n").encode(), (bytes(r["data"]) for r in _rows(packed)))
    return n


def write_fused_ply(points: DataFrame, path: str) -> int:
    """Oriented points as 27-byte records."""
    n = points.count()
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"] + [f"property {'float' if t == '<f4' else 'uchar'} {c}" for c, t in FUSED] + ["end_header"]
    _stream(path, ("\n".join(lines) + "\n").encode(), (bytes(r["data"]) for r in _rows(_packed(points, FUSED))))
    return n


def las_records(points: DataFrame, scale: float = 0.001) -> tuple[DataFrame, list[float]]:
    """Quantised coordinates and 16-bit colours; offsets are the floors of the smallest coordinates."""
    low = points.agg(*[F.floor(F.min(c)).cast("double") for c in "xyz"]).first()
    offsets = [float(v or 0.0) for v in low]
    q = [F.bround((F.col(c) - o) / scale).cast("int").alias(f"i{c}") for c, o in zip("xyz", offsets)]
    return points.select("point_id", *q, *[(F.col(c).cast("int") * 257).alias(f"{c}16") for c in "rgb"]), offsets


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> int:
    """LAS 1.2, point format 3, scale 0.001."""
    rec, offsets = las_records(points, scale)
    s = rec.agg(F.count("*"), *[F.min(f"i{c}") for c in "xyz"], *[F.max(f"i{c}") for c in "xyz"]).first()
    n, low, high = s[0], [v or 0 for v in list(s)[1:4]], [v or 0 for v in list(s)[4:7]]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, 2, b"plumbgrid".ljust(32, b"\0"), b"plumbgrid".ljust(32, b"\0"), 1, 2024, 227, 227, 0, 3, 34, n, n, 0, 0, 0, 0)
    head += struct.pack("<12d", *[scale] * 3, *offsets, *[v for a, b, o in zip(high, low, offsets) for v in (a * scale + o, b * scale + o)])
    dtype = [("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("pad", "V8"), ("t", "<f8"), ("r16", "<u2"), ("g16", "<u2"), ("b16", "<u2")]
    own = [(c, t) for c, t in dtype if c not in ("pad", "t")]

    def widen(data: bytes) -> bytes:
        a = np.frombuffer(data, dtype=own)
        out = np.zeros(len(a), dtype=dtype)
        for c, _ in own:
            out[c] = a[c]
        return out.tobytes()

    _stream(path, head, (widen(bytes(r["data"])) for r in _rows(_packed(rec, own))))
    return n


CONSTRAINT_COLUMNS = ("type", "label", "point_id", "role", "metres", "model_x", "model_y", "model_z", "target_x", "target_y", "target_z", "sigma_x", "sigma_y", "sigma_z", "crs", "source", "note")


def constraint_rows(distances: DataFrame, observations: DataFrame) -> DataFrame:
    """One table of 17 columns: a distance gives two rows (A carries the metres, B only the end point), a point one."""
    full = lambda df, **have: df.select(*[have.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in CONSTRAINT_COLUMNS])
    side = lambda p, end, metres: full(
        distances, type=F.lit("distance"), label=F.col("label"), point_id=F.lit(end), metres=metres, model_x=F.col(f"{p}x"), model_y=F.col(f"{p}y"), model_z=F.col(f"{p}z"), source=F.col("source")
    )
    points = full(
        observations, type=F.lit("coordinate"), point_id=F.col("point_id"), role=F.col("role"), crs=F.col("crs"),
        **{f"model_{c}": F.col(f"m{c}") for c in "xyz"}, **{f"target_{c}": F.col(f"t{c}") for c in "xyz"}, **{f"sigma_{c}": F.col(f"s{c}") for c in "xyz"},
    )
    return side("a", "A", F.col("actual")).unionByName(side("b", "B", F.lit(None))).unionByName(points)


def measurement_rows(measurements: DataFrame) -> DataFrame:
    return measurements.select("kind", "label", "value", "unit", "point_count")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


LIMITATIONS = (
    "Accuracy is only as good as the control it is fitted to.",
    "Check points are independent of the fit only if they were not used as control.",
    "Scale from distances alone leaves position and orientation arbitrary.",
    "Filtered clouds are not a substitute for the measured surface.",
)


def accuracy_document(title: str, transform: dict, control: dict | None, check: dict | None, warnings: str) -> dict:
    return {"title": title, "transform": transform, "control": control, "check": check, "warnings": [w for w in warnings.split("; ") if w], "limitations": list(LIMITATIONS)}


def html_report(document: dict) -> str:
    """A report page; tables for control and check points only where there are any; everything is escaped."""
    esc = lambda v: html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
    out = [f"<!doctype html><meta charset='utf-8'><title>{esc(document['title'])}</title><h1>{esc(document['title'])}</h1>"]
    for part in ("control", "check"):
        if (document.get(part) or {}).get("n"):
            rows = "".join(f"<tr><th>{esc(k)}</th><td>{esc(v)}</td></tr>" for k, v in document[part].items())
            out.append(f"<h2>{part.capitalize()} points</h2><table>{rows}</table>")
    for name in ("warnings", "limitations"):
        if document[name]:
            out.append(f"<h2>{name.capitalize()}</h2><ul>" + "".join(f"<li>{esc(w)}</li>" for w in document[name]) + "</ul>")
    return "\n".join(out)


def export_project(points: DataFrame, folder: str, document: dict, constraints: DataFrame | None = None, calibrated: bool = False) -> list[str]:
    """Point cloud, constraint table, report as JSON and HTML, LAS only where calibrated, and a ZIP of all."""
    os.makedirs(folder, exist_ok=True)
    made = ["points.ply", "accuracy.json", "report.html"]
    write_ply(points, f"{folder}/points.ply", (document["title"],))
    write_json(f"{folder}/accuracy.json", document)
    atomic_write(f"{folder}/report.html", html_report(document).encode())
    if calibrated:
        write_las(points, f"{folder}/points.las")
        made.append("points.las")
    if constraints is not None:
        lines = [",".join(CONSTRAINT_COLUMNS)] + [",".join("" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"' for v in r) for r in _rows(constraints)]
        atomic_write(f"{folder}/constraints.csv", ("﻿" + "\r\n".join(lines) + "\r\n").encode())
        made.append("constraints.csv")
    with zipfile.ZipFile(f"{folder}/export.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name in made:
            z.write(f"{folder}/{name}", name)
    return [*made, "export.zip"]


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``block, kind, id, line``: lines of a Wavefront file; indices count from 1 and run on over the blocks.

    ``vertices(block, id, x, y, z)`` and ``faces(block, face_id, a, b, c)`` with numbers local to the block.  Texture
    coordinates ``u, v`` and normals ``nx, ny, nz`` of the vertices are written, and named by the faces, if they are there.
    """
    from plumbgrid.operators.blocks import vertex_offsets

    offsets = vertex_offsets(vertices.groupBy("block").agg(F.count("*").alias("vertex_count"))).select("block", "offset")
    has = lambda *c: set(c) <= set(vertices.columns)
    given = [("v", "xyz")] + [("vt", "uv")] * has("u", "v") + [("vn", ("nx", "ny", "nz"))] * has("nx", "ny", "nz")
    text = lambda tag, cols: F.format_string(" ".join([tag, *["%.6f"] * len(cols)]), *[F.col(c).cast("double") for c in cols])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text(tag, cols).alias("line")) for k, (tag, cols) in enumerate(given)])).alias("one")
    v = vertices.select("block", F.col("id").cast("long").alias("id"), each).select("block", "one.kind", "id", "one.line")
    corner = {1: "{0}", 2: "{0}/{0}" if has("u", "v") else "{0}//{0}", 3: "{0}/{0}/{0}"}[len(given)]
    at = lambda c: F.format_string(corner.replace("{0}", "%1$d"), (F.col(c) + F.col("offset") + 1).cast("long"))
    f = faces.join(offsets, "block").select("block", F.lit(len(given)).alias("kind"), F.col("face_id").cast("long").alias("id"), F.concat_ws(" ", F.lit("f"), *[at(c) for c in "abc"]).alias("line"))
    return v.unionByName(f)


def material_lines(texture: str, name: str = "surface") -> list[str]:
    """A material library with one unlit material that shows ``texture``."""
    return [f"newmtl {name}", "Kd 1 1 1", "Ks 0 0 0", "illum 1", f"map_Kd {texture}"]


def polygon_indices(faces: DataFrame) -> DataFrame:
    """Index runs as the ASCII scene format wants them: the last of each polygon is its bitwise complement."""
    return faces.select("face_id", F.array("a", "b", -F.col("c") - 1).alias("indices"))


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """One text file per partition, in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_names(names: DataFrame, path: str) -> None:
    names.select("name").coalesce(1).write.mode("overwrite").text(path)


def emit_events(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


MESH_FORMATS = ("obj", "fbx")

# fixed values: words of the ASCII scene format
_SCENE_HEAD = ("; FBX 7.4.0 project file", "FBXHeaderExtension: {", "  FBXVersion: 7400", "}", "Objects: {", '  Geometry: 1, "Geometry::mesh", "Mesh" {')
_SCENE_TAIL = ('  Model: 2, "Model::mesh", "Mesh" {', "    Version: 232", "  }", "}", "Connections: {", '  C: "OO",1,2', '  C: "OO",2,0', "}")


def scene_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """``section, id, line``: an ASCII scene of one mesh; vertex numbers run from 0 without gaps, in order of ``id``.

    ``vertices(id, x, y, z)`` and ``faces(face_id, a, b, c)`` by those numbers.  In order of section and id the lines are
    the file; lists are as long as the tables, each row a line of its own.
    """
    spark = vertices.sparkSession
    n = vertices.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    m = faces.agg(F.count("*").alias("n"), F.max("face_id").alias("last")).first()
    fixed = [(0, k, x) for k, x in enumerate((*_SCENE_HEAD, f"    Vertices: *{3 * n['n']} {{ a: "))]
    fixed += [(2, 0, f"    }} PolygonVertexIndex: *{3 * m['n']} {{ a: ")] + [(4, k, x) for k, x in enumerate(("    }", "  }", *_SCENE_TAIL))]
    comma = lambda c, last: F.when(F.col(c) == F.lit(last), "").otherwise(",")
    v = vertices.select(F.lit(1).alias("section"), F.col("id").cast("long").alias("id"), F.concat(F.format_string("%.6f,%.6f,%.6f", *[F.col(c).cast("double") for c in "xyz"]), comma("id", n["last"])).alias("line"))
    runs = polygon_indices(faces).select(F.lit(3).alias("section"), F.col("face_id").cast("long").alias("id"), F.concat(F.array_join(F.transform("indices", lambda i: i.cast("string")), ","), comma("face_id", m["last"])).alias("line"))
    return spark.createDataFrame(fixed, "section int, id long, line string").unionByName(v).unionByName(runs)


def export_mesh(vertices: DataFrame, faces: DataFrame, folder: str, kind: str, texture: str | None = None) -> str:
    """Text parts under ``folder/kind`` that make the file when they are put together by name.

    ``obj`` takes vertices and faces by block, and a material library beside it if a ``texture`` is named; ``fbx`` one
    mesh, with numbers that run through.
    """
    if kind not in MESH_FORMATS:
        raise ValueError(f"format {kind} is not written")
    if kind == "obj":
        lines = obj_lines(vertices, faces)
        if texture:
            first = vertices.agg(F.min("block")).first()[0]
            use = vertices.sparkSession.createDataFrame([(first, -1, k, x) for k, x in enumerate(("mtllib surface.mtl", "usemtl surface"))], "block string, kind int, id long, line string")
            lines = use.withColumn("block", F.col("block").cast(dict(vertices.dtypes)["block"])).unionByName(lines)
            vertices.sparkSession.createDataFrame([(x,) for x in material_lines(texture)], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/mtl")
        write_lines(lines, f"{folder}/obj", "block", "kind", "id")
    else:
        write_lines(scene_lines(vertices, faces), f"{folder}/fbx", "section", "id")
    return f"{folder}/{kind}"
