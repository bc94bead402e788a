import collections
import random

import numpy as np
import pytest

from plumbgrid.llm import quality
from plumbgrid.llm.queries import op8_quality

SYMBOLS = set("#*$%&|<>")


def stats(text):
    text = text or ""
    w = text.encode().split()
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    return len(w), sum(len(x.decode()) for x in w), sum(x in SYMBOLS for x in text), dup, len(cover)


ODD = [None, "", " \t\n", "a", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 50, "line\nline\n \nline two\nline", "#*$%&|<> é ü\x0bz", "tab\tsep\x0cform\rret", "w " * 5000 + "end", "one\ntwo\none\n", "a\x85b c d"]


def test_statistics_against_brute_force(spark):
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, w string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.text_statistics(df).collect()}
    assert got == {i: stats(t) for i, t in enumerate(texts)}


def test_query_statistics_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in op8_quality(spark, data).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r, s = rows[d["doc_id"]], stats(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert all(rows[i]["kept"] or rows[i]["base_failed"] for i in good)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 9))) for _ in range(n))


def test_outliers_go_and_groups_are_separate(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, rnd.randrange(50, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in prose(rnd, 150).split()), "en", "s") for i in range(30)]
    rows += [(2000 + i, " ".join(w + "$$$" for w in prose(rnd, 150).split()), "xx", None) for i in range(60)]  # usual there
    rows += [(3000, prose(rnd, 100), "yy", "lone"), (3001, " ".join(["$$$$"] + prose(rnd, 50).split()), None, "lone")]
    r = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r[i]["kept"] for i in range(300)) and not any(r[1000 + i]["kept"] for i in range(30)) and all(r[2000 + i]["kept"] for i in range(60))
    assert r[3000]["kept"] and r[3000]["distance"] is None and r[3001]["kept"]


def test_small_groups_are_judged_by_pools(spark):
    """Groups too small for an estimate: their language judges, else their source, else all documents."""
    rnd = random.Random(2)
    bad = lambda: " ".join(w + "$$$" for w in prose(rnd, 150).split())
    rows = [(i, prose(rnd, rnd.randrange(50, 400)), "en", f"s{i % 20}") for i in range(200)]
    rows += [(300 + i, prose(rnd, rnd.randrange(50, 400)), f"l{i % 20}", "web") for i in range(200)]
    rows += [(1000, bad(), "en", "s3"), (1001, bad(), "l5", "web"), (1002, bad(), "zz", "lone"), (1003, bad(), None, None)]
    rows += [(2000, prose(rnd, 100), "en", "s3"), (2001, prose(rnd, 100), "l5", "web"), (2002, prose(rnd, 100), "zz", "lone"), (2003, prose(rnd, 100), None, None)]
    schema = "doc_id long, text string, lang string, source string"
    r = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, schema)).collect()}
    assert len(r) == len(rows) and all(r[i]["kept"] for i in r if not 1000 <= i < 1004)
    for k, judge in enumerate(["language", "source", "all", "all"]):
        for i in (1000 + k, 2000 + k):
            assert r[i]["judged_by"] == judge and r[i]["distance"] is None and r[i]["pool_distance"] is not None
        assert not r[1000 + k]["kept"]
    few = quality.quality(spark.createDataFrame(rows[:20], schema)).collect()
    assert all(x["kept"] and x["judged_by"] is None for x in few)


def test_estimate_is_near_the_bulk(spark):
    """Concentration ends at a subset whose determinant no step from it lowers."""
    from plumbgrid.workspace import Workspace

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(400, 4)), rng.normal(loc=9, size=(60, 4))])
    df = spark.createDataFrame([("a", "b", *map(float, v)) for v in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")
    r = quality.outlier_distances(df, 0.75, 5, Workspace(spark, "t")).first()
    assert np.allclose([r[f"m{i}"] for i in range(4)], 0, atol=0.25) and 330 < r["n_used"] <= 410


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert quality.quality(spark.createDataFrame([], schema)).count() == 0
    r = quality.quality(spark.createDataFrame([(None, None, None, None), (1, "x", "e", "s"), (1, "x", "e", "s")], schema)).collect()
    assert len(r) == 3 and all(x["base_failed"] and not x["kept"] for x in r)
    assert quality._chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
