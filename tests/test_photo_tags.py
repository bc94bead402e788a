"""Photo metadata from hand-made files in both byte orders, whole, cut, looping and odd."""

import struct
import zlib

import pytest

from plumbgrid.sources import photo_tags as pt


def tiff(order, root, exif=(), gps=(), loop=False):
    """A TIFF block of directories of (tag, kind, count, packed value)."""
    blocks = [list(root), list(exif), list(gps)]
    here = [8]
    for k, entries in enumerate(blocks):
        extra = 2 * (bool(exif) or loop) * (k == 0) + 2 * bool(gps) * (k == 0)
        here.append(here[-1] + 6 + 12 * (len(entries) + extra // 2) + sum(len(v) for *_, v in entries if len(v) > 4))
    u = lambda code, *v: struct.pack(order + code, *v)
    if exif or loop:
        blocks[0].append((0x8769, 4, 1, u("I", 8 if loop else here[1])))
    if gps:
        blocks[0].append((0x8825, 4, 1, u("I", here[2])))
    out = (b"II" if order == "<" else b"MM") + u("HI", 42, 8)
    for k, entries in enumerate(blocks):
        if not entries:
            continue
        far = here[k] + 6 + 12 * len(entries)
        body, data = u("H", len(entries)), b""
        for tag, kind, count, value in entries:
            if len(value) <= 4:
                body += u("HHI", tag, kind, count) + value.ljust(4, b"\0")
            else:
                body += u("HHII", tag, kind, count, far + len(data))
                data += value
        out = out.ljust(here[k], b"\0") + body + u("I", 0) + data
    return out


def ratios(order, *v):
    return b"".join(struct.pack(order + "II", a, b) for a, b in v)


def sample(order, lat=((30, 1), (15, 1), (1800, 100))):
    p = lambda code, v: struct.pack(order + code, v)
    root = [(0x110, 2, 9, b"Camera X\0"), (0x112, 3, 1, p("H", 6))]
    exif = [(0x9003, 2, 20, b"2024:05:06 07:08:09\0"), (0x920A, 5, 1, ratios(order, (245, 10))), (0xA434, 2, 4, b"L 1\0")]
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, ratios(order, *lat)), (3, 2, 2, b"E\0"), (4, 5, 3, ratios(order, (120, 1), (0, 1), (0, 1))), (5, 1, 1, b"\1"), (6, 5, 1, ratios(order, (125, 10)))]
    return tiff(order, root, exif, gps)


def jpeg(block, split=None):
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    parts = [block[:split], block[split:]] if split else [block]
    app = b"".join(seg(0xE1, b"Exif\0\0" + x) for x in parts if x)
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + b"\xff" + app + seg(0xC2, b"\x08" + struct.pack(">HH", 30, 40) + b"\3" + b"\0" * 9) + b"\xff\xda\0\x02pixels\xff\xd9"


def png(block):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 30, 8, 2, 0, 0, 0)) + chunk(b"eXIf", block) + chunk(b"IEND", b"")


WHOLE = {"width": 40, "height": 30, "orientation": 6, "captured_at": "2024:05:06 07:08:09", "camera_model": "Camera X", "lens_model": "L 1", "focal_length_mm": 24.5, "gps_source": "EXIF", "rtk_status": "GPS", "problem": None}


def read(spark, contents):
    d = spark.createDataFrame([(k, None if c is None else bytearray(c), "x") for k, c in enumerate(contents)], "id int, content binary, width string")
    return [r.asDict() for r in pt.photo_metadata(d).orderBy("id").collect()]


def test_both_orders_and_formats(spark):
    rows = read(spark, [jpeg(sample("<")), jpeg(sample(">")), png(sample("<")), png(sample(">")), jpeg(sample("<"), split=100)])
    for r in rows:
        assert {k: r[k] for k in WHOLE} == WHOLE
        assert r["lat"] == pytest.approx(-(30 + 15 / 60 + 18 / 3600)) and r["lon"] == 120.0 and r["altitude"] == -12.5


def test_plain_tiff(spark):
    root = [(0x100, 4, 1, struct.pack(">I", 7)), (0x101, 3, 1, struct.pack(">H", 5)), (0x110, 2, 3, b"AB\0"), (0x9003, 2, 20, b"2020:01:01 00:00:00\0")]
    r, = read(spark, [tiff(">", root)])
    assert (r["width"], r["height"], r["camera_model"], r["captured_at"], r["orientation"], r["gps_source"]) == (7, 5, "AB", "2020:01:01 00:00:00", 1, "")


def test_vendor_packet_goes_first(spark):
    packet = b'<x drone-dji:GpsLatitude="+1.5" drone-dji:GpsLongitude="2.5" drone-dji:GimbalYawDegree="90"/>'
    body = b"http://ns.adobe.com/xap/1.0/\0" + packet
    whole = jpeg(sample("<"))
    r, = read(spark, [whole[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + whole[2:]])
    assert (r["lat"], r["lon"], r["yaw"], r["gps_source"], r["altitude"]) == (1.5, 2.5, 90.0, "vendor", -12.5)


def test_broken_files_have_a_problem_and_no_tags(spark):
    whole = jpeg(sample("<"))
    looping = jpeg(tiff("<", [(0x110, 2, 3, b"AB\0")], loop=True))
    words = jpeg(tiff("<", [(0x8769, 2, 4, b"abc\0")]))
    contents = [whole[:n] for n in range(2, whole.index(b"\xff\xda"))] + [looping, words, b"", b"GIF89a", jpeg(b"XX*\0" + b"\0" * 20), whole[:2] + b"\xff\xe1\0\1", png(sample("<"))[:60]]
    for r in read(spark, contents):
        assert r["problem"] and r["camera_model"] == "" and r["lat"] is None and r["width"] is None and r["rtk_status"] == "NONE"


def test_odd_values(spark):
    none, zero, huge = read(spark, [None, jpeg(sample(">", lat=((30, 1), (15, 0), (0, 1)))), tiff("<", [(0x100, 4, 1, b"\xff\xff\xff\xff"), (0x112, 2, 2, b"x\0")])])
    assert none["problem"] is None and none["camera_model"] == "" and none["orientation"] == 1
    assert zero["lat"] is None and zero["lon"] is None and zero["altitude"] is None and zero["camera_model"] == "Camera X"  # one wrong part, no position
    assert huge["width"] is None and huge["orientation"] == 1
    assert pt.photo_metadata(spark.createDataFrame([], "content binary")).count() == 0
