import base64
import gzip
import hashlib
import json
import random

import numpy as np
import pytest

from plumbgrid.llm import bpe, warc
from plumbgrid.llm.queries import op6_warc, op7_bpe, tokenizer_file
from plumbgrid.workspace import Workspace


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/", "x"), (5, "http://b c\r\nd/", "x"), (3, None, "x"), (7, "http://e/", None), (8, "http://f/", ""), (9, "http://g/", "é\r\n\r\nWARC/1.1\r\n" * 40000), (10, "u", "z" * 70000), (10, "u", "z" * 70000), (11, "u", "z" * 70000), (None, "n", "x"), (None, "n", "only")]


def expected(pages, least=0):
    top = {}
    for i, _, h in pages:
        d = (h or "").encode()
        top[d] = max(top.get(d, -1), -1 if i is None else i)
    out = []
    for i, _, h in pages:
        d = (h or "").encode()
        same = len(d) < least or (-1 if i is None else i) == top[d]
        out.append((i, len(d), sha(d), "response" if same else "revisit", None if same else top[d], True))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "k", 1) for p in PAGES], "page_id long, url string, html string, digest string, r_id int")
    assert sorted(map(tuple, warc.archive_round_trip(df, least).collect()), key=str) == expected(PAGES, least)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_payloads_and_segments(spark):
    ws = Workspace(spark, "t")
    rnd = random.Random(1)
    pages = [(i, "u", "".join(rnd.choice("aé\r\n0") for _ in range(rnd.randrange(3000)))) for i in range(40)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), ws.path("a"), segment_bytes=100)
    got = {r["id"]: r for r in warc.read_archives(spark, ws.path("a")).collect()}
    for i, _, h in pages:
        r = got[warc.record_id(i, sha(h.encode()))]
        assert bytes(r["payload"]) == h.encode() and r["ok"]


def test_broken_segments(spark, tmp_path):
    def write(name, records):
        with gzip.open(tmp_path / name, "wb") as f:
            f.write(b"".join(r + b"\r\n\r\n" for r in records))

    whole = warc.page_records(1, "u", b"q" * 500, None, 100)
    write("a.warc.gz", whole[:2] + whole[3:])
    other = warc.page_records(2, "u", b"w" * 500, None, 100)
    write("b.warc.gz", other[3:] + other[:3])
    (tmp_path / "c.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in warc.page_records(3, "u", b"plain", None, 1000) + warc.page_records(4, "u", b"cut", None, 60)[1:]))
    got = {r["id"].split(":")[2]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert not got["1"]["ok"] and got["1"]["payload"] is None
    assert got["2"]["ok"] and bytes(got["2"]["payload"]) == b"w" * 500
    assert got["3"]["ok"] and got["4"]["kind"] == "continuation" and not got["4"]["ok"]
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"))


def test_many_members_and_pieces(spark, tmp_path):
    """A file of one gzip member per record, as archives usually are, is read in linear time."""
    records = [warc.page_records(i, "u", (b"%d " % i) * (i % 700), None, 1 << 20)[0] + b"\r\n\r\n" for i in range(2000)]
    (tmp_path / "m.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert {int(r["id"].split(":")[2]): bytes(r["payload"]) for r in got} == {i: (b"%d " % i) * (i % 700) for i in range(2000)}
    raw = b"".join(records[:50])
    whole = list(warc.parse_records(raw))
    for n in (1, 3, 1000):
        assert list(warc.parse_records(raw[i : i + n] for i in range(0, len(raw), n))) == whole
    with pytest.raises(ValueError):
        list(warc.plain_pieces(gzip.compress(b"x" * 1000)[:-9]))


def test_query_reassembles_segments(spark, data):
    """Pages beyond a segment's size are cut and joined again on the way of the query."""
    ws = Workspace(spark, "t")
    pages = spark.read.parquet(f"{data}/pages.parquet")
    warc.write_archives(pages, ws.path("a"))
    kinds = [r["kind"] for f in spark.read.format("binaryFile").load(ws.path("a") + "/*.gz").collect() for r in [{"kind": h["warc-type"]} for h, _ in warc.parse_records(warc.plain_pieces(bytes(f["content"])))]]
    assert kinds.count("continuation") > 0.05 * len(kinds)


def test_chunked_framing():
    for data in (b"", b"a", bytes(range(256)) * 100):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    assert warc.dechunked(b"5\r\nabc\r\n") is None and warc.dechunked(b"zz\r\n") is None


def test_warc_query(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op6_warc(spark, data).collect()), key=str) == expected(pages)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return bpe.Codec(f.read())


PIECES = ["a", "The", ".", ",", ";!", "the", "ing", "s", "'s", "'", "''", " ", "é", "́", "1", "!", "<|endoftext|>", "<|endo", "<|ENDOFTEXT|>", "|>", "Σ", "İ", "日本", "\u0085", "😀", "tion", "'ll", "...", "\n", "\t", "J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y", "\u030a", "É", "ñ", "Ü", "×", "²", "'S", "9"]


@pytest.mark.parametrize("seed", range(6))
def test_tree_and_leaf_equal_the_library(library, codec, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(bpe, "WINDOW", rnd.choice([2, 4, 16, 64]))
    for _ in range(60):
        some = rnd.sample(PIECES, rnd.choice([2, 4, 8, len(PIECES)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.choice([1, 30, 300, 900])))
        want = library.encode(text, add_special_tokens=False).ids
        raw = text.encode()
        spans = codec.grown(raw, rnd.choice([4, 16, 200]))
        assert spans[:, 0].tolist() == want
        for ids in (codec.leaf(raw), codec.encode(raw, 50)):
            assert np.frombuffer(ids, "<u4").tolist() == want and codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["J\u030c x", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "A\u0591\u030a B", "Aé", "a\u0344b A\u0344B"])
def test_capitals_with_combining_marks(library, codec, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(codec.leaf(text.encode()), "<u4").tolist() == want
    assert codec.grown(text.encode(), 3)[:, 0].tolist() == want


def test_other_patterns_are_left_to_the_library(library):
    """A tokenizer that keeps letters and marks together must not be split by the known pattern."""
    from tokenizers import Tokenizer

    with open(tokenizer_file(), encoding="utf-8") as f:
        spec = json.loads(f.read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"
    own = Tokenizer.from_str(json.dumps(spec))
    codec = bpe.Codec(json.dumps(spec))
    for text in ("Word, word. it's 10% a.b", "x" * 50 + ".,;" * 20):
        assert np.frombuffer(codec.encode(text.encode(), 8), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_much_of_the_text_goes_through_the_tree(data, spark):
    sizes = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").selectExpr("octet_length(text)").where("text is not null").collect()]
    assert sum(s for s in sizes if s > bpe.LEAF_BYTES) > 0.4 * sum(sizes)


def rows_of(library, texts):
    out = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_query(spark, data, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op7_bpe(spark, data).collect()), key=str) == rows_of(library, docs)


def test_bpe_edges(spark, library):
    long = "unsplit" * 3000
    texts = [(1, None), (2, ""), (2, "same id"), (3, long), (3, long), (None, "null id " * 3000), (4, " \u0085 "), (5, "é" * 9000 + " tail")]
    df = spark.createDataFrame([(i, t, "h", 0) for i, t in texts], "doc_id long, text string, h string, piece int")
    got = bpe.encode_texts(df, tokenizer_file(), leaf_bytes=100, spread_bytes=1000).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == rows_of(library, texts)
    assert all(len(r["ids"]) == r["n_tokens"] and hashlib.sha256(bytes(r["decoded"])).hexdigest() == r["decoded_sha256"] for r in got)
    assert bpe.encode_texts(df.limit(0), tokenizer_file()).count() == 0
