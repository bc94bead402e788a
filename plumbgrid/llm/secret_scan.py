"""Secret scan with corpus-wide ownership frequency.

Patterns find values that look like credentials.  A value is told by its digest; over the corpus, digests are counted by
the distinct repositories and owners that hold them.  What many owners hold is an example that was copied widely; what a
single owner holds and looks alive is a credential of that owner.  The patterns' own findings stay as they are and get a
verdict; tokens that stand without a keyword or a known shape become findings only if their ownership says so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import claim, slices, trim

#: The kinds of findings in their order; a token that only its ownership makes a finding comes last.
ASSIGN, ACCESS, HEX, OWNED = range(4)
KINDS = ("assign", "access", "hex", "owned")
#: The patterns.  Letters of the keyword are taken in either case, and ASCII only.
ASSIGN_PATTERN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# maximal runs: a run that is too short has no longer one within it, so the bound may stand in the pattern
ACCESS_PATTERN = r"AKIA[A-Z0-9]{14,}"
HEX_PATTERN = r"[0-9a-f]{16,}"
TOKEN_PATTERN = r"[A-Za-z0-9+/_-]{16,}"

#: A token looks alive with a letter, a digit and this many different characters.
ALIVE_CHARACTERS = 8
#: A value of more owners than the first number is shared, from the second number on an example.
MOST_OWNERS, EXAMPLE_OWNERS = 1, 3
#: Values with more than one in so many of all occurrences are set apart by a broadcast of at most as many digests.
HEAVY_SHARE = 4096
SLICE_BYTES = 1 << 20


def find_spans(text: str, patterns: tuple[re.Pattern, ...]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """A text -> the base findings ``(start, kind, end, value)`` in order, and the tokens ``(start, end, value)`` clear of them."""
    assign, access, hexes, tokens = patterns
    base = [(m.start(), ASSIGN, m.end(), m.group(2)) for m in assign.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    base += [(m.start(), ACCESS, m.end(), m.group()) for m in access.finditer(text)]
    base += [(m.start(), HEX, m.end(), m.group()) for m in hexes.finditer(text)]
    base.sort()
    alone, k, reach = [], 0, 0
    for m in tokens.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        value = m.group()
        if reach <= m.start() and len(set(value)) >= ALIVE_CHARACTERS and re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            alone.append((m.start(), m.end(), value))
    return base, alone


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("digest", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("text_digest", pa.binary()), ("spans", pa.list_(_SPAN))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("secrets")
    patterns = tuple(re.compile(p, re.ASCII) for p in (ASSIGN_PATTERN, ACCESS_PATTERN, HEX_PATTERN, TOKEN_PATTERN))
    digest = lambda v: hashlib.sha256(v.encode()).digest()[:16]
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            names, spans = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base, alone = find_spans(text, patterns)
                own = [{"start": s, "end": e, "kind": k, "digest": digest(v)} for s, k, e, v in base]
                own += [{"start": s, "end": e, "kind": OWNED, "digest": digest(v)} for s, e, v in alone]
                spans.append(own)
                names.append(digest(text) if own else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), pa.array(names, pa.binary()), pa.array(spans, _FOUND.field("spans").type)], schema=_FOUND)
    trim()


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, owner)`` -> a row for each row: ``doc_id, owner, text_digest`` and the ``spans`` (start, end, kind, digest of the value).

    Starts and ends are code points of the text; kinds are numbered as in ``KINDS``, tokens without a pattern as ``owned``.
    """
    span = "array<struct<start: long, end: long, kind: int, digest: binary>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("owner").cast("string").alias("owner"), "text").mapInArrow(_scan, f"doc_id long, owner string, text_digest binary, spans {span}")


def ownership(occurrences: DataFrame) -> DataFrame:
    """``occurrences(digest, owner, repo)`` -> ``digest, n_repos, n_owners, n`` by distinct repositories and owners.

    A repository is one of its owner: equal names under two owners are two.  Null owners are one owner, null names one
    repository.  Repeats go before anything of one digest meets, so a common value is counted in partial sums.
    """
    each = occurrences.groupBy("digest", "owner", "repo").agg(F.count("*").alias("n"))
    owners = each.groupBy("digest", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n"))


def verdict_of(n_owners: Column) -> Column:
    return F.when(n_owners <= MOST_OWNERS, "owned").when(n_owners < EXAMPLE_OWNERS, "shared").otherwise("example")


def scan_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text, owner, repo)`` -> the spans of every row, and the ownership of every value.

    The second table is ``digest, n_repos, n_owners, n, verdict``; verdicts are ``owned`` (one owner), ``shared`` and
    ``example`` (three owners or more).  Both are written tables of the call's workspace.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    found = ws.keep(found_spans(docs), "spans")
    values = found.where("size(spans) > 0").select("owner", F.col("doc_id").alias("repo"), F.explode("spans.digest").alias("digest"))
    stats = ownership(values).withColumn("verdict", verdict_of(F.col("n_owners")))
    return found, ws.keep(stats, "ownership")


def owned_tokens(found: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens that their ownership makes findings: ``doc_id, owner, text_digest, start, end``, once for equal rows.

    Values with a large share of all occurrences are never a single row's, but they may be a single owner's: they are
    judged by a broadcast of at most ``HEAVY_SHARE`` digests, all others by a join in which no key is large.
    """
    token = F.explode(F.filter("spans", lambda s: s["kind"] == OWNED)).alias("s")
    tokens = found.where(F.exists("spans", lambda s: s["kind"] == OWNED)).select("doc_id", "owner", "text_digest", token)
    tokens = tokens.select("doc_id", "owner", "text_digest", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.digest").alias("digest")).distinct()
    total = stats.agg(F.sum("n")).first()[0] or 0
    floor = total // HEAVY_SHARE + 1  # at most HEAVY_SHARE values occur so often
    heavy, light = stats.where(F.col("n") >= floor), stats.where(F.col("n") < floor)
    own = F.col("verdict") == "owned"
    often = tokens.join(F.broadcast(heavy.where(own).select("digest")), "digest", "left_semi")
    rest = tokens.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light.where(own).select("digest"), "digest", "left_semi")
    return often.unionByName(rest).drop("digest")


def secret_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, owner)`` -> ``doc_id, n_assign, n_access, n_hex, base, spans``, a row for each row.

    A document is a repository of its owner.  ``base`` lists the patterns' matches as ``kind:start:end`` (the whole match,
    code points, end exclusive) by start, then kind, joined by commas; ``spans`` adds the owned tokens, which overlap no
    match.  Widely copied tokens are not added; matches stay whoever holds their value.

    Null and empty texts have no findings.  Null ids and owners are values of their own; equal rows get equal results.
    Other columns are ignored.  No rows give no rows.
    """
    found, stats = scan_corpus(docs)
    added = owned_tokens(found, stats)
    key = ["doc_id", "owner", "text_digest"]
    # the tokens of one text: bounded by the text
    added = added.groupBy(*key).agg(F.collect_list(F.struct("start", F.lit(OWNED).alias("kind"), "end")).alias("added"))
    added = added.select(*[F.col(c).alias(f"a_{c}") for c in key], "added")
    bare, rest = found.where(~F.exists("spans", lambda s: s["kind"] == OWNED)), found.where(F.exists("spans", lambda s: s["kind"] == OWNED))
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in key]
    met = bare.withColumn("added", F.lit(None).cast("array<struct<start: long, kind: int, end: long>>")).unionByName(rest.join(added, same, "left").select(*found.columns, "added"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["kind"] < OWNED), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    every = F.array_sort(F.concat(F.col("base"), F.coalesce("added", F.expr("array()").cast("array<struct<start: long, kind: int, end: long>>"))))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = met.withColumn("base", base)
    return out.select("doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"), said(F.col("base")).alias("base"), said(every).alias("spans"))


def secret_values(docs: DataFrame) -> DataFrame:
    """Ownership of every value found in ``docs(doc_id, text, owner)``: ``digest`` (hex), ``n_repos``, ``n_owners``, ``n``, ``verdict``."""
    return scan_corpus(docs)[1].select(F.lower(F.hex("digest")).alias("digest"), "n_repos", "n_owners", "n", "verdict")
