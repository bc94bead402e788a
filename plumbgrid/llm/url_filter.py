"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

Each URL is expanded into the expressions ``host suffix + path prefix``; a rule is one such expression.  The join key is
a 32-bit prefix of the expression's SHA-256; what meets there is confirmed by the full digest, and the longest fitting
rule decides.  Only label counts and prefix lengths that occur among the rules are expanded, so no expression that
could fit is left out and a URL with thousands of labels or characters costs no more than the rule shapes.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, pick

#: Rules are broadcast up to this many; above it the join shuffles both sides on the hash prefix.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _digest(host: Column, path: Column) -> Column:
    """Digest of an expression with its seam marked, so that only an equal host and an equal path agree."""
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _key(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """``rules(action, host, path)`` -> one row per hash prefix with the rules that share it.

    Hosts are lower-cased (A-Z); null host or path counts as empty, null actions are ignored.  Of a repeated expression
    with both actions, block wins.  ``n_labels`` and ``n_path`` tell the shapes behind each prefix.
    """
    r = pick(rules, "action", "host", "path").where("action is not null")
    r = r.select(
        "action", ascii_lower(F.coalesce("host", F.lit(""))).alias("rh"), F.coalesce("path", F.lit("")).alias("rp")
    )
    r = r.groupBy("rh", "rp").agg(F.max("action").alias("action"))
    r = r.withColumn("digest", _digest(F.col("rh"), F.col("rp")))
    rule = F.struct(
        "digest", (F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("n_host"), "action", F.concat("rh", "rp").alias("rule")
    )
    return r.groupBy(_key(F.col("digest")).alias("rkey")).agg(
        F.collect_list(rule).alias("rules"),
        F.collect_set(F.size(_labels(F.col("rh")))).alias("n_labels"),
        F.collect_set(F.length("rp")).alias("n_path"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages(page_id, url)`` and ``rules(action, host, path)`` -> ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (code points of host
    and path together, then of the host, then block before allow) gives the verdict.  Nothing fitting: rule null and
    ``default``.  Null URLs and those without ``://`` have an empty host and path.  Every input row gives one output
    row, repeated rows and null ids included.  No rules: all get the default.  Other columns are ignored.
    """
    ready = prepare_rules(rules)
    # label counts and path lengths that rules have: distinct small integers, a few hundred in any rule list
    shape = ready.agg(
        F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("n_labels")))).alias("l"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("n_path")))).alias("p"),
    ).first()
    base = pick(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["n"]:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, shape["l"])), lambda k: k <= F.size("labels")),
        lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, shape["p"])), lambda k: k <= F.length("path")),
        lambda k: F.substring(F.col("path"), F.lit(1), k),
    )
    digests = F.flatten(F.transform("suffixes", lambda s: F.transform("prefixes", lambda p: _digest(s, p))))
    wide = (
        base.withColumn("labels", _labels(F.col("host")))
        .select("page_id", "host", "path", suffixes.alias("suffixes"), prefixes.alias("prefixes"))
        .select("page_id", "host", "path", F.posexplode_outer(digests).alias("k", "own"))
    )
    side = ready.select("rkey", "rules")
    met = wide.join(F.broadcast(side) if shape["n"] <= BROADCAST_RULES else side, _key(F.col("own")) == F.col("rkey"), "left")
    fitting = F.filter("rules", lambda r: r["digest"] == F.col("own"))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["n"], r["n_host"], r["action"], r["rule"])))
    # one row per URL's first expression counts the rows themselves, so that equal rows come back as often as they went in
    judged = (
        met.groupBy("page_id", "host", "path")
        .agg(F.max(best).alias("best"), F.count(F.when(F.coalesce("k", F.lit(0)) == 0, 1)).alias("n"))
        .select("page_id", "host", "path", "best", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("i"))
    )
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
