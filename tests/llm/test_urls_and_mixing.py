import collections

import pytest
from pyspark.sql import functions as F

from plumbgrid.llm import mixing, url_filter
from plumbgrid.llm.queries import URL_RULES, op1_url_filter


def rules(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "action string, host string, path string")


def brute(url, rows):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in rows if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


URLS = [
    "http://A.Example.ORG/es/1", "https://example.org/en/123?x#y", "https://xexample.org/es/", "http://example.com/de/#a", "http://com/fr/", "nothing", "", None, "://", "http://a.b.c.com?q/fr/", "http://org", "http://org/",
    "HTTP://ÄÖ.org/x", "http://" + "a." * 3000 + "org/" + "p" * 5000, "http://example.org/en/1", "http://example.org/en/1",
]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i // 2, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = collections.Counter(tuple(r) for r in url_filter.judge_urls(pages, rules(spark)).collect())
    assert got == collections.Counter((i // 2, *brute(u, URL_RULES)) for i, u in enumerate(URLS))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/"), (1, None)], "page_id long, url string")
    assert url_filter.judge_urls(pages, rules(spark)).count() == 3
    assert url_filter.judge_urls(pages.limit(0), rules(spark)).count() == 0
    bare = url_filter.judge_urls(pages, rules(spark).limit(0), "block").collect()
    assert [r["verdict"] for r in bare] == ["block"] * 3


def test_ties_and_conflicting_rules(spark):
    rows = [("allow", "a.com", "/x"), ("block", "A.com", "/x"), ("allow", None, None), (None, "a.com", "/xx")]
    got = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.com/xx"), (2, "http://b.de/")], "page_id long, url string"), rules(spark, rows))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == {1: ("a.com/x", "block"), 2: (None, "allow")}


def test_shuffled_rules_agree(spark, data, monkeypatch):
    want = sorted(map(tuple, op1_url_filter(spark, data).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, op1_url_filter(spark, data).collect())) == want


def fill(sizes, weights, cap):
    left, out = dict(enumerate(zip(sizes, weights))), {}
    total = float(sum(sizes))
    while left:
        level = total / sum(w for _, w in left.values())
        over = [k for k, (s, w) in left.items() if level * w > cap * s]
        if not over:
            return [out.get(k, level * w if k in left else 0) if k in out else level * left[k][1] for k, w in enumerate(weights)]
        for k in over:
            out[k] = cap * left.pop(k)[0]
            total -= out[k]
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10, 1000, 5], [7, 7, 7, 7], [1, 1, 5000, 3, 2], [0, 10], [0, 0]])
def test_water_filling(spark, sizes):
    rows = [(chr(97 + i), s) for i, s in enumerate(sizes)]
    w = [(1.0, 2.0, 3.0)[i % 3] for i in range(len(sizes))]
    t = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").collect()
    assert [r["target"] for r in t] == pytest.approx(fill(sizes, w, 3.0) if sum(sizes) else [0.0] * len(sizes))


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.when(F.pmod("id", F.lit(50)) > 0, F.expr("repeat('w ', cast(1 + id % 23 as int))")).alias("text"),
        F.when(F.pmod("id", F.lit(3)) == 0, "a").when(F.pmod("id", F.lit(31)) == 1, "b").when(F.pmod("id", F.lit(7)) == 2, None).otherwise("c").alias("source"), F.lit(1).alias("target"), F.lit("x").alias("u"),
    )
    a = mixing.mix(docs).collect()
    assert len(a) == 600 and sorted(map(tuple, a)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in a:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[(r["source_size"], r["target"])][0] += r["taken"]
    for (size, target), (taken, _) in per.items():
        assert abs(taken - target) <= 24 and target <= 3 * size + 1e-6
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["reps"] for r in a)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None), (1, "", None), (None, "\t", "s")], schema)).collect()
    assert [x["taken"] for x in r] == [0, 0, 0] and all(x["target"] == 0 for x in r)
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s")], schema)).collect()
    assert [x["taken"] for x in one] == [3, 3]
