"""The corpus operators applied to the driver's tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from . import bpe, brown, embeddings, filter_audit, mixing, passages, quality, runs, secret_scan, simhash, token_counts, url_filter, warc
from .text import UPPER, n_words

#: Keys over which a group of equal documents is spread in the count query.
SPREAD = 64
#: The rules of the URL query: (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def tokenizer_file() -> str:
    """Vocabulary of the BPE query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_file(), full=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents counted by two tokenizer versions, copies deleted, one version's counts revised."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    ws = Workspace(spark, "op4")
    sized = docs.select(
        "doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), n_words(F.col("text")).alias("words"),
        F.coalesce(F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]|[,.]")), F.lit(0)).cast("long").alias("marks"),
    )
    sized = ws.keep(sized, "sized")
    ledger = token_counts.TokenLedger(spark, ws.path("ledger"))
    keyed = sized.select("doc_id", "source", "lang", "words", "marks")
    versions = {"words": F.col("words"), "marks": F.col("marks")}
    first = [keyed.select("doc_id", F.lit(v).alias("version"), F.lit(1).alias("seq"), F.lit("insert").alias("op"), "source", "lang", c.alias("n_tokens")) for v, c in versions.items()]
    ledger.commit("load", first[0].unionByName(first[1]))
    heads = sized.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("c")).where("c > 1")
    # a group of copies is spread over ``SPREAD`` keys, its head repeated for each
    salts = F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("salt")
    own = sized.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("salt"))
    copies = own.join(heads.select("digest", "head", salts), ["digest", "salt"]).where("doc_id != head").select("doc_id")
    gone = copies.select("doc_id", F.explode(F.array(*map(F.lit, versions))).alias("version"), F.lit(1).alias("seq"), F.lit("delete").alias("op"))
    gone = gone.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_tokens", "long"))])
    ledger.commit("copies", gone)
    revised = keyed.select("doc_id", F.lit("marks").alias("version"), F.lit(1).alias("seq"), F.lit("revise").alias("op"), "source", "lang", (F.col("words") + F.col("marks")).alias("n_tokens"))
    ledger.commit("marks-2", revised)
    ledger.commit("copies", gone)  # a repeated commit changes nothing
    return ledger.totals()


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(_table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are repositories, their sources the owners."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("owner"))
    out = secret_scan.secret_spans(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, n, points = F.col("words"), F.size("words"), F.length("text")
    filters = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(w)) < 65 * n,
        "C": 100 * (points - F.length(F.translate("text", UPPER, ""))) > 5 * points,
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit_texts(docs, _table(spark, sf_dir, "labels"), filters, "E", flags)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of one document in ten are made periodic first, by the id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.greatest(F.col("n"), F.lit(1))
    a = F.pmod(g, n)
    docs = runs.with_periodic_tails(_table(spark, sf_dir, "documents"), a, 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))), h % 10 == 0)
    return runs.collapse_runs(docs, with_text=False).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_embeddings": op3_embeddings,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_brown": op9_brown,
    "op10_passages": op10_passages,
    "op11_secrets": op11_secrets,
    "op12_filter_audit": op12_filter_audit,
    "op13_runs": op13_runs,
}

_OP1 = r"""
WITH rules(action, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                               ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT row_number() OVER () AS rid, page_id,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
      FROM pages),
m AS (SELECT p.*, action, rh || rp AS rule,
             row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, action DESC) AS k
      FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""

# the water level is found by SQL over the sources; the cut takes the words of the smallest keyed hashes
_OP5 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w, source_size * 3.0 AS cap FROM s),
l AS (SELECT w.*, cap / w.w AS ratio FROM w),
v AS (SELECT a.source, a.ratio,
             ((SELECT sum(source_size) FROM l)::DOUBLE - coalesce((SELECT sum(cap) FROM l b WHERE b.ratio < a.ratio), 0)) /
             (SELECT sum(w) FROM l b WHERE b.ratio >= a.ratio) AS level FROM l a),
f AS (SELECT min(level) FILTER (WHERE ratio = (SELECT min(ratio) FROM v WHERE level <= ratio)) AS level FROM v),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f), ratio)::DOUBLE * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS whole FROM t),
n AS (SELECT *, greatest(0.0, target - whole * source_size) AS need FROM r),
g AS (SELECT source, u, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, u),
c AS (SELECT source, u, size, sum(size) OVER (PARTITION BY source ORDER BY u) AS upto FROM g),
k AS (SELECT n.source, c.u, need, upto - c.size AS before, c.size FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source
      WHERE need > 0 AND upto >= need QUALIFY row_number() OVER (PARTITION BY n.source ORDER BY c.u) = 1),
x AS (SELECT n.source, source_size, target, whole,
             CASE WHEN n.need <= 0 THEN '' WHEN k.u IS NULL THEN 'g' WHEN (k.need - before) * 2 > k.size THEN k.u || 'g' ELSE k.u END AS cut
      FROM n LEFT JOIN (SELECT source, u, need, before, size FROM k) k ON n.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (whole + (u < cut)::BIGINT)::INTEGER AS reps, (size * (whole + (u < cut)::BIGINT))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                  len(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]|[,.]')) AS marks,
                  doc_id = min(doc_id) OVER (PARTITION BY text) OR text IS NULL AS head FROM documents),
k AS (SELECT doc_id, source, lang, 'words' AS version, words AS n FROM d WHERE head
      UNION ALL SELECT doc_id, source, lang, 'marks', words + marks FROM d WHERE head)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM k GROUP BY ALL
"""

# base32 by five-bit groups of the digest's binary digits
_OP6 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right((('0x' || hex[i])::INTEGER::BIT)::VARCHAR, 4)), '') AS bits,
             max(page_id) OVER (PARTITION BY hex) AS chief FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5),
           lambda k: bits[i * 5 + k + 1]::INTEGER * (16 >> k)))::INTEGER]), '') AS payload_digest,
       CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = chief THEN NULL ELSE chief END AS refers_to, true AS ok
FROM b
"""

_OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win FROM w, unnest(range(1, greatest(len(words) - 18, 1))) AS r(i)),
late AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM late, unnest(range(0, 20)) AS r(k)),
per AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN words
              ELSE list_transform(list_filter(range(1, len(words) + 1), lambda j: NOT list_contains(js, j)), lambda j: words[j]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN per USING (doc_id)
"""

# spans are found from the gaps between matches; tokens clear of them stay where one source alone holds their value
_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
pats(kind, ord, re, least) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12),
  ('access', 1, '(AKIA[A-Z0-9]+)', 18), ('hex', 2, '([0-9a-f]+)', 16), ('owned', 3, '([A-Za-z0-9+/_-]+)', 16)),
cut AS (SELECT rid, doc_id, source, kind, ord, least, re, regexp_extract_all(t, re) AS ms, list_transform(string_split_regex(t, re), lambda x: length(x)) AS gaps
        FROM d, pats WHERE regexp_matches(t, re)),
one AS (SELECT cut.*, i, ms[i] AS m, list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
        FROM cut, unnest(range(1, len(ms) + 1)) AS r(i) WHERE length(ms[i]) >= least),
hit AS (SELECT rid, doc_id, source, kind, ord, s::BIGINT AS s, (s + length(m))::BIGINT AS e, regexp_extract(m, re, 1) AS v FROM one WHERE length(regexp_extract(m, re, 1)) >= least),
good AS (SELECT * FROM hit h WHERE ord < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8
         AND NOT EXISTS (FROM hit b WHERE b.rid = h.rid AND b.ord < 3 AND b.s < h.e AND h.s < b.e))),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS k FROM good GROUP BY v),
fin AS (SELECT good.* FROM good JOIN own USING (v) WHERE ord < 3 OR k = 1),
per AS (SELECT rid, count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM fin GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""

# every order is applied to the counts of documents by the filters they fail
_OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), min(w.doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN g USING (doc_id)),
cells AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
                 count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
m AS (SELECT part, fails, n, good, toxic, filter_order, step, filter_order[step] AS own, regexp_matches(fails, '[' || filter_order[1:step] || ']') AS gone_now,
             step > 1 AND regexp_matches(fails, '[' || filter_order[1:greatest(step - 1, 1)] || ']') AS gone_before
      FROM cells, o, unnest(range(1, 6)) AS r(step)),
s AS (SELECT part, filter_order, step::INTEGER AS step, any_value(own) AS own, coalesce(sum(n) FILTER (WHERE NOT gone_now), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE gone_now AND NOT gone_before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE gone_before AND contains(fails, own)), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE gone_now AND NOT gone_before), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE gone_now AND NOT gone_before), 0)::BIGINT AS toxic_lost
      FROM m GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op11_secrets": _OP11,
    "op12_filter_audit": _OP12,
    "op10_passages": _OP10,
    "op1_url_filter": _OP1,
    "op4_token_counts": _OP4,
    "op6_warc": _OP6,
    "op5_mixing": _OP5,
}
