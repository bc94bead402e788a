"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words that repeats with smallest period q, is at least ``LEAST`` words and ``REPEATS`` periods long
and cannot be extended.  Its first and last ``length - q`` words are equal stretches, and as the length is at least
``max(LEAST, REPEATS * q)``, that overlap is at least ``OVERLAP`` words.  So every word of a run lies in a k-gram, k =
``OVERLAP``, that occurs twice in its document; words outside such k-grams part the text into segments, and a run lies in one
of them.  Most texts have no segment at all.

Segments are halved level by level.  A run is found at the middle that it crosses: for each period up to a third of the
node, the words around the middle are compared with those one period on (and one period back), forward and backward.
All nodes of a level, over all documents of a slice, are compared at once; lengths of common stretches come from exact
ranks of the stretches of 1, 2, 4, ... words, so nothing hangs on hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import bound_batches

from .passages import _joined, _mix, _word_hashes
from .text import claim, pick, slices, to_bytes, trim, words

LEAST, REPEATS = 24, 3
SLICE_BYTES = 1 << 20


def overlap_of(least: int, repeats: int) -> int:
    """Words that the two equal stretches of a run share at least: length - q for length >= max(least, repeats * q)."""
    return least - least // repeats


def repeated_segments(hashes: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several documents and the ends of these -> starts and stops of the stretches covered by repeated k-grams.

    A k-gram is told by its hash and its document; two different ones with one hash would only let more words through.
    """
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(ends, np.arange(n - k + 1), side="right")
    inside = np.arange(n - k + 1) + k <= ends[doc]
    at = np.flatnonzero(inside)
    gram = _mix(_joined(hashes, k)[at] + _mix(doc[at].astype(np.uint64)))
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(at) + 1, dtype=bool)
    again[1:-1] = same
    hit = at[order[again[:-1] | again[1:]]]
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    on = np.cumsum(cover)[:n] > 0
    on = np.concatenate(([False], on, [False]))
    starts, stops = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    # covered stretches of two documents may touch: cut them at the documents' ends
    cuts = ends[:-1]
    owner = np.searchsorted(stops, cuts, side="right")
    inner = cuts[(owner < len(starts)) & (starts[np.minimum(owner, len(starts) - 1)] < cuts)] if len(starts) else cuts[:0]
    return np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((stops, inner)))


def _ranks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """``ranks[j][i]`` is a number of the stretch of 2^j words at i; equal numbers mean equal stretches."""
    out, size = [ids.astype(np.int32)], 1
    while size * 2 <= longest:
        low = out[-1]
        pairs = (low[:-size].astype(np.int64) << 32) | low[size:].astype(np.int64)
        out.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        size *= 2
    return out


def _forward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the texts from i and from j on have in common; the array ends with a word of its own, which stops all."""
    total = np.zeros(len(i), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[level], 1 << level
        while True:
            a, b = i + total, j + total
            ok = (a < len(rank)) & (b < len(rank))
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            total += ok * size
            if level < len(ranks) - 1 or not ok.any():
                break
    return total


def _backward(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the texts up to i and up to j have in common at their ends."""
    total = np.zeros(len(i), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, size = ranks[level], 1 << level
        while True:
            a, b = i - total - size, j - total - size
            ok = (a >= 0) & (b >= 0)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            total += ok * size
            if level < len(ranks) - 1 or not ok.any():
                break
    return total


def periodic_runs(ids: np.ndarray, lows: np.ndarray, highs: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Segments ``[lows, highs)`` of the numbered words ``ids`` -> rows of start, length, smallest period, in order.

    No run may pass the end of its segment: a word of its own must follow each (and precede the first).  ``repeats`` is 2 at least.
    """
    found = []
    big = highs - lows >= least
    lows, highs = lows[big], highs[big]
    if not len(lows):
        return np.zeros((0, 3), np.int64)
    ranks = _ranks(ids, int((highs - lows).max()))
    probe = min(3, len(ranks) - 1)  # of the shared words around a middle, a stretch of 8 lies on one side
    reach = 1 << probe if overlap_of(least, repeats) >= 2 << probe else 0
    while len(lows):
        middle = (lows + highs) // 2
        most = (highs - lows) // repeats
        m = np.repeat(middle, most)
        p = np.arange(len(m)) - np.repeat(np.cumsum(most) - most, most) + 1
        for i, j in ((m, m + p), (m - p, m)):  # one period right of the middle, one period left of it
            ok = (i >= 0) & (j < len(ids))
            if reach:
                rank = ranks[probe]
                f = ok & (j < len(rank))
                f[f] = rank[i[f]] == rank[j[f]]
                b = ok & (i >= reach)
                b[b] = rank[i[b] - reach] == rank[j[b] - reach]
                ok = f | b
            i, j, q = i[ok], j[ok], p[ok]
            if not len(i):
                continue
            start, stop = i - _backward(ranks, i, j), j + _forward(ranks, i, j)
            good = stop - start >= np.maximum(least, repeats * q)
            found.append(np.stack((start[good], (stop - start)[good], q[good]), axis=1))
        lows, highs = np.concatenate((lows, middle)), np.concatenate((middle, highs))
        big = highs - lows >= least
        lows, highs = lows[big], highs[big]
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), dtype=bool)  # of one stretch, the smallest period: the others are its multiples
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_texts(texts: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """Runs of each text (its words joined by single spaces): rows of start, length, period."""
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    long = np.flatnonzero(counts >= least)
    if not len(long):
        return out
    big = b" ".join([texts[i] for i in long.tolist()]) + b" "
    ends = np.cumsum(counts[long])
    at, stop, hashes = _word_hashes(big)
    lows, highs = repeated_segments(hashes, ends, overlap_of(least, repeats))
    if not len(lows):
        return out
    # surviving words are numbered by their text; each segment is followed by a number of its own
    number: dict[bytes, int] = {}
    ids, starts = [], []
    for lo, hi in zip(lows.tolist(), highs.tolist()):
        starts.append(len(ids))
        ids += [number.setdefault(w, len(number)) for w in big[at[lo] : stop[hi - 1]].split(b" ")]
        ids.append(-1)
    array = np.array(ids, dtype=np.int64)
    own = np.flatnonzero(array < 0)
    array[own] = len(number) + np.arange(len(own))
    starts_ = np.array(starts)
    rows = periodic_runs(array, starts_, starts_ + highs - lows, least, repeats)
    if not len(rows):
        return out
    segment = np.searchsorted(starts_, rows[:, 0], side="right") - 1
    place = rows[:, 0] - starts_[segment] + lows[segment]
    doc = np.searchsorted(ends, place, side="right")
    rows = np.column_stack((place - (ends - counts[long])[doc], rows[:, 1], rows[:, 2]))
    for d in np.unique(doc).tolist():
        out[int(long[d])] = rows[doc == d]
    return out


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for the words that a run contains after its first period."""
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover)[:n] > 0


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string()),
])


def _detect(least: int, repeats: int, with_text: bool):
    schema = _OUT if with_text else pa.schema(list(_OUT)[:-1])

    def best(runs: np.ndarray) -> tuple:
        """Greatest length / period, compared as fractions; then the smallest start, then the smallest period."""
        top = None
        for s, length, q in runs.tolist():
            if top is None or length * top[2] > top[1] * q:
                top = (s, length, q)
        return (*top, 1000 * top[1] // top[2]) if top else (None,) * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("runs")
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [b" ".join(t.split()) if t else b"" for t in to_bytes(batch.column("text"))]
                rows = []
                for d, t, runs in zip(batch.column("doc_id").to_pylist(), texts, runs_of_texts(texts, least, repeats)):
                    n, left = (t.count(b" ") + 1 if t else 0), t
                    if len(runs):
                        left = b" ".join([w for w, gone in zip(t.split(b" "), dropped_words(n, runs).tolist()) if not gone])
                    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs.tolist())
                    row = (d, n, len(runs), *best(runs), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                    rows.append((*row, left.decode()) if with_text else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        trim()

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, with_text: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, collapsed]``.

    A row for each row, whatever its id: null ids, repeated ids and equal rows are judged each on its own text.  ``start`` to
    ``exponent_milli`` tell the run with the greatest exponent (ties: smallest start, then period), all null without a run.
    ``collapsed`` has the kept words joined by one space: each run leaves its first period, unless another run takes that
    too.  Null, empty and short texts have no runs.  Other columns are ignored.  No rows give no rows.

    Nothing is shuffled.  A task holds a slice of about a megabyte of text, or one longer text: about 4 bytes a surviving
    word for each doubling of the longest segment.
    """
    if repeats < 2 or least < 2 * repeats:
        raise ValueError("repeats must be 2 at least and least 2 * repeats at least")
    bound_batches(docs.sparkSession)
    kinds = {pa.int64(): "long", pa.string(): "string"}
    fields = list(_OUT)[: None if with_text else -1]
    text = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return text.mapInArrow(_detect(least, repeats, with_text), ", ".join(f"{f.name} {kinds[f.type]}" for f in fields))


def with_periodic_tails(docs: DataFrame, start: Column, period: Column, when: Column) -> DataFrame:
    """``docs(doc_id, text)`` where words from number ``start`` on become repetitions of the ``period`` words there, in rows with ``when``.

    The expressions may use ``doc_id`` and ``n``, the number of words.  Rows without words stay as they are.
    """
    base = pick(docs, "doc_id", "text").withColumn("w", words(F.col("text"))).withColumn("n", F.size("w").cast("long"))
    base = base.withColumn("a", start.cast("int")).withColumn("p", period.cast("int"))
    tail = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return base.select("doc_id", F.when(when & (F.col("n") > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
