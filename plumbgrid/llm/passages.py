"""Substring deduplication by super-k-mer partitioning.

A window is ``WIDTH`` consecutive words.  Its minimiser is the smallest mixed hash among its runs of ``MINI`` words;
consecutive windows with one minimiser travel together, as one packed string, to the minimiser's bucket; strings of one
task that share a bucket are compressed together.  Equal strings are merged before they travel (keeping the earliest
place), so copies cost one string per task.  In its bucket every window of every distinct string is sorted by hash,
equal hashes are compared as text, and the earliest window of each word sequence is reported to its document; all
windows that nobody reports start later than an equal one.

A bucket that outgrows its limit is not held: its windows go on, one row each, to an aggregation by window text, which
spills and spreads like any other.  Memory is bounded by slices, buckets and single documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import claim, pick, slices, to_bytes, trim

WIDTH, MINI = 20, 3
LONGEST_RUN = 256
SLICE_BYTES, MERGE_BYTES, CHUNK_BYTES, BUCKET_BYTES = 1 << 20, 16 << 20, 2 << 20, 32 << 20
LEAST_BUCKETS, BUCKET_MEAN = 1024, 8 << 20
PART_BYTES = 64 << 20  # of strings, before compression, for a task
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications, wrapping)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _word_hashes(big: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``big``: words that are each followed by one space -> starts, ends and 64-bit hashes of the words.

    Works through a megabyte at a time, as the bytes are widened to 64 bits.
    """
    raw = np.frombuffer(big, dtype=np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    powers = np.full(int((ends - starts).max()) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    hashes = np.empty(len(starts), dtype=np.uint64)
    w = 0
    while w < len(starts):
        stop = max(w + 1, int(np.searchsorted(starts, starts[w] + (1 << 20))))
        a, b = starts[w], ends[stop - 1] + 1
        size = ends[w:stop] - starts[w:stop] + 1
        place = np.arange(b - a) - np.repeat(starts[w:stop] - a, size)
        hashes[w:stop] = np.add.reduceat((raw[a:b].astype(np.uint64) + np.uint64(1)) * powers[place], starts[w:stop] - a)
        w = stop
    return starts, ends, _mix(hashes)


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every ``n`` consecutive entries of ``h``, by doubling."""
    out, have, block, size, step = None, 0, h, 1, _STEP
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:  # put the block of ``size`` after the ``have`` entries so far
                m = len(h) - have - size + 1
                out, have = out[:m] * step + block[have : have + m], have + size
        if have == n:
            return out
        block, size, step = block[: len(block) - size] * step + block[size:], size * 2, np.uint64(int(step) ** 2 % 2**64)


def _window_min(v: np.ndarray, n: int) -> np.ndarray:
    size, low = 1, v
    while size * 2 <= n:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    rest = n - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


_PACKED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _pack(d: np.ndarray, h: np.ndarray, pos: np.ndarray, strings: list[bytes]) -> bytes:
    """Strings of one bucket with their places, compressed; ids as differences."""
    head = np.array([len(d)], "<i8").tobytes() + np.diff(d, prepend=0).astype("<i8").tobytes() + h.astype("<i8").tobytes() + pos.astype("<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"\n".join(strings))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    d = np.cumsum(np.frombuffer(raw, "<i8", n, 8))
    h = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    return d, h, np.frombuffer(raw, "<i4", n, 8 + 16 * n), raw[8 + 20 * n :].split(b"\n")


def _super_kmers(buckets: int):
    """Texts -> packed strings by bucket; equal strings are merged until ``MERGE_BYTES`` are held."""

    def flush(held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
        strings = list(held)
        d, h, pos, mini = (np.array(c, dtype=np.int64) for c in zip(*held.values()))
        bucket = (_mix(mini.view(np.uint64) + _BASE) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        blobs = [_pack(d[g], h[g], pos[g], [strings[i] for i in g.tolist()]) for g in groups]
        numbers = [bucket[g[0]] for g in groups]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("super-k-mers")
        held: dict[bytes, tuple] = {}
        room = 0
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [b" ".join(t.split()) if t else b"" for t in to_bytes(batch.column("text"))]
                counts = [t.count(b" ") + 1 for t in texts]
                rows = [(t, n, d, h) for t, n, d, h in zip(texts, counts, batch.column("d").to_pylist(), batch.column("h").to_pylist()) if n >= WIDTH]
                if not rows:
                    continue
                big = b" ".join([r[0] for r in rows]) + b" "
                n = np.array([r[1] for r in rows])
                last = np.cumsum(n)
                starts, ends, hashes = _word_hashes(big)
                low = _window_min(_mix(_joined(hashes, MINI)), WIDTH - MINI + 1)
                doc = np.repeat(np.arange(len(rows)), n)[: len(low)]
                valid = np.arange(len(low)) + WIDTH <= last[doc]
                new = valid.copy()
                new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
                at = np.flatnonzero(new)
                nth = np.arange(len(low)) - at[np.maximum(np.cumsum(new) - 1, 0)]
                new |= valid & (nth % LONGEST_RUN == 0)  # very long runs are cut
                at = np.flatnonzero(new)
                stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
                first = (last - n)[doc[at]]
                for a, b, k, pos, mini in zip(starts[at].tolist(), ends[stop + WIDTH - 1].tolist(), doc[at].tolist(), (at - first).tolist(), low[at].view(np.int64).tolist()):
                    s = big[a:b]
                    place = (rows[k][2], rows[k][3], pos, mini)
                    was = held.get(s)
                    if was is None:
                        held[s] = place
                        room += b - a + 100
                    elif place < was:
                        held[s] = place
                if room > MERGE_BYTES:
                    yield from flush(held)
                    held, room = {}, 0
        if held:
            yield from flush(held)
        held = {}
        trim()

    return run


_NOVEL = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("s", pa.binary())])


def _first_windows(d: np.ndarray, h: np.ndarray, pos: np.ndarray, strings: list[bytes]) -> pa.RecordBatch | None:
    """Whole buckets -> runs of windows that are the earliest of their word sequence."""
    order = np.lexsort((pos, h, d)).tolist()
    seen: set[bytes] = set()
    keep = [i for i in order if not (strings[i] in seen or seen.add(strings[i]))]
    big = b" ".join([strings[i] for i in keep]) + b" "
    n = np.array([strings[i].count(b" ") + 1 for i in keep])
    last = np.cumsum(n)
    starts, ends, hashes = _word_hashes(big)
    owner = np.repeat(np.arange(len(keep)), n)
    at = np.arange(len(owner) - WIDTH + 1)
    at = at[at + WIDTH <= last[owner[: len(at)]]]  # windows within one string, in the order of documents and places
    w = _joined(hashes, WIDTH)[at]
    rank = np.argsort(w, kind="stable")
    ws = w[rank]
    lead = np.ones(len(ws), dtype=bool)
    lead[1:] = ws[1:] != ws[:-1]
    novel = np.zeros(len(ws), dtype=bool)
    novel[rank[lead]] = True
    for i in np.flatnonzero(~lead).tolist():  # equal hashes: equal texts?  If not, it leads a group of its own
        a, j = at[rank[i]], i - 1
        text = big[starts[a] : ends[a + WIDTH - 1]]
        b = at[rank[j]]
        if text != big[starts[b] : ends[b + WIDTH - 1]]:
            while j >= 0 and ws[j] == ws[i]:
                b = at[rank[j]]
                if text == big[starts[b] : ends[b + WIDTH - 1]]:
                    break
                j -= 1
            else:
                novel[rank[i]] = True
    hit = np.flatnonzero(novel)
    if not len(hit):
        return None
    word = at[hit]
    own = owner[word]
    fresh = np.ones(len(hit), dtype=bool)
    fresh[1:] = (np.diff(word) != 1) | (np.diff(own) != 0)
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(hit)))
    src = np.array(keep)[own[begin]]
    place = pos[src] + word[begin] - (last - n)[own[begin]]
    return pa.RecordBatch.from_arrays(
        [pa.array(d[src]), pa.array(h[src]), pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32)), pa.nulls(len(src), pa.binary())], schema=_NOVEL
    )


def _buckets(limit: int):
    """Packed strings in order of their buckets -> earliest windows; strings of outgrown buckets pass through."""

    def through(part: tuple) -> pa.RecordBatch:
        d, h, pos, strings = part
        cols = [pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(pos, pa.int32()), pa.nulls(len(d), pa.int32()), pa.array(strings, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, schema=_NOVEL)

    def work(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        d, h, pos = (np.concatenate([p[k] for p in parts]) for k in range(3))
        out = _first_windows(d, h, pos, [s for p in parts for s in p[3]])
        if out is not None:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("buckets")
        done: list[tuple] = []  # of complete buckets
        held: list[tuple] = []  # of the current one
        done_bytes = held_bytes = 0
        current, passing = None, False
        for whole in batches:
            for bucket, blob in zip(whole.column("bucket").to_pylist(), whole.column("blob")):
                if bucket != current:
                    done, done_bytes = done + held, done_bytes + held_bytes
                    held, held_bytes, current, passing = [], 0, bucket, False
                    if done_bytes > CHUNK_BYTES:
                        yield from work(done)
                        done, done_bytes = [], 0
                part = _unpack(blob.as_py())
                if passing:
                    yield through(part)
                    continue
                held.append(part)
                held_bytes += sum(map(len, part[3]))
                if held_bytes > limit:
                    yield from map(through, held)
                    held, held_bytes, passing = [], 0, True
        if done or held:
            yield from work(done + held)
        done, held = [], []
        trim()

    return run


_WINDOWS = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("s", pa.binary())])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "s", 256 << 10):
            out = []
            for d, h, pos, s in zip(*[batch.column(c).to_pylist() for c in ("d", "h", "pos", "s")]):
                w = s.split(b" ")
                out += [(d, h, pos + i, b" ".join(w[i : i + WIDTH])) for i in range(len(w) - WIDTH + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _WINDOWS.types)], schema=_WINDOWS)


def _cut(with_text: bool, carry: tuple[str, ...]):
    names = [("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    labels = [n for n, _ in names] + ["kept_text"] * with_text + list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("cut")
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sizes, removed, digests, kept = [], [], [], []
                for text, novel in zip(to_bytes(batch.column("text")), batch.column("novel").to_pylist()):
                    w = (text or b"").split()
                    spare = max(0, len(w) - WIDTH + 1)
                    runs = np.array(novel or [], dtype=np.int64)
                    gone = 0
                    if int((runs & 0xFFFFFFFF).sum()) < spare:
                        fresh = np.zeros(spare + 1, dtype=np.int32)
                        np.add.at(fresh, runs >> 32, 1)
                        np.add.at(fresh, (runs >> 32) + (runs & 0xFFFFFFFF), -1)
                        late = np.flatnonzero(np.cumsum(fresh)[:spare] == 0)
                        cover = np.zeros(len(w) + 1, dtype=np.int32)
                        cover[late] += 1
                        cover[late + WIDTH] -= 1
                        drop = np.cumsum(cover)[: len(w)] > 0
                        gone = int(drop.sum())
                        sizes.append(len(w))
                        w = [x for x, out in zip(w, drop.tolist()) if not out]
                    else:
                        sizes.append(len(w))
                    left = b" ".join(w)
                    removed.append(gone)
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if gone else text)
                cols = [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                if with_text:
                    cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*cols, *[batch.column(f"c{k}") for k in range(len(carry))]], names=labels)

    return run, "doc_id long, h long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text


def remove_repeats(docs: DataFrame, with_text: bool = True, carry: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, h, n_words, n_removed, kept_sha256[, kept_text]`` and the carried columns, a row for each row.

    A word goes if a window covers it whose word sequence also starts earlier: in a smaller ``doc_id``, or before in
    the same text; windows are judged on the input.  Null ids come last.  Rows with one id but different texts are
    ordered by the texts' hash (63 bits of ``h``); wholly equal rows count as one document and share their result.  Null and short
    texts lose nothing.  ``kept_text`` is the text itself where nothing was removed, else the kept words joined by one
    space.  Other columns are ignored.  No rows give no rows.
    """
    ws = Workspace(docs.sparkSession, "passages")
    kinds = dict(docs.dtypes)
    extra = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    # 63 bits of the text's hash; the sign tells rows without an id, which come last, from those with the largest one
    half = F.shiftrightunsigned(F.xxhash64("text"), 1)
    d = d.withColumn("h", F.when(F.col("doc_id").isNull(), half).otherwise(half.bitwiseOR(F.lit(-(2**63)))))
    d = d.withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1)))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-3 * total // BUCKET_MEAN))  # strings take about three times the text
    packed = d.select("d", "h", "text").mapInArrow(_super_kmers(buckets), "bucket int, blob binary")
    dealt = packed.repartition(ws.parts(3 * total, PART_BYTES), "bucket").sortWithinPartitions("bucket")
    found = ws.keep(dealt.mapInArrow(_buckets(bucket_bytes), "d long, h long, pos int, n int, s binary"), "found")
    del packed, dealt
    ws.release()
    outgrown = found.where("s is not null").select("d", "h", "pos", "s").mapInArrow(_single_windows, "d long, h long, pos int, s binary")
    least = outgrown.groupBy("s").agg(F.min(F.struct("d", "h", "pos")).alias("m")).select("m.*", F.lit(1).alias("n"))
    runs = found.where("s is null").select("d", "h", "pos", "n").unionByName(least)
    packed_run = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    novel = runs.groupBy("d", "h").agg(F.collect_list(packed_run).alias("novel"))
    cut, schema = _cut(with_text, carry)
    own = d.join(novel, ["d", "h"], "left").select("doc_id", "h", "text", "novel", *[f"c{k}" for k in range(len(carry))])
    return own.mapInArrow(cut, schema + "".join(f", `{c}` {kinds[c]}" for c in carry))
