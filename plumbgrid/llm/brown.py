"""Language-model scores from a Brown class-based bigram model.

Every word belongs to one class; the model's probability of a text is the product, over its words and a final end token,
of a class transition probability and the word's share of its class.  Classes come from exchange clustering: a word
moves to the class that raises the class bigram likelihood of the whole training corpus most.  The exchange runs in
synchronous rounds; in each, every word of a fixed, hashed half sees the counts of the other words' classes as they
stand and moves, the halves taking turns, which keeps words from swapping back and forth.  Sweeps over both halves go on
until no word moves or the likelihood stands.

All training words take part, however rare or long.  The ``hot_words`` most frequent ones go first: they are a broadcast
of bounded size, which turns texts into numbers once, and their neighbours beyond it count as one context, "rare".  Then
all other words are exchanged by the same rule among the classes of the hot ones.  Their context counts lie in a table
of packed buckets, a row for each, so that no task or driver ever holds the vocabulary.  The final transitions count
every pair of neighbours under the classes of both words, pairs of two rare words by joins.

Context counts cover all training texts and travel as one compressed row per task and block (or bucket) of words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import Workspace

from .text import claim, pick, slices, to_bytes, trim

HOT_WORDS, HOT_BYTES, CLASSES = 131_072, 64, 30
SWEEPS = 12  # at most, of each of the two exchanges; four and one stand on the tables at hand
STANDS = 1e-2  # nats a word pair; a sweep that raises the likelihood by less is the last
ALPHA, BETA = 0.1, 5.0  # added to word counts; strength of the class unigram behind class transitions
SHARE = 0.25  # of the class unigram in a transition, as classes fit the pairs they were made from
COUNTER_WORDS = 400_000  # distinct words that a task counts before it hands them on
BLOCK_WORDS = 512
BUCKET_TOKENS = 200_000  # rare tokens in a bucket, about
HELD_TOKENS = 1 << 21  # rare tokens that a task gathers before it packs them
CHUNK = 2048  # words whose classes are compared at once


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("brown-count")
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "c"])

    for whole in batches:
        for b in slices(whole, "text", 4 << 20):
            for t in to_bytes(b.column("text")):
                if t:
                    held.update(t.lower().split())
                    if len(held) > COUNTER_WORDS:
                        yield flush()
                        held.clear()
    if held:
        yield flush()


def _number(shared):
    """Texts -> numbers of hot words (little-endian, ``len(hot)`` for all others) and the other words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-number")
        ranks = {w: i for i, w in enumerate(shared.value)}
        cold = len(ranks)
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                ids, rest = [], []
                for t in to_bytes(b.column("text")):
                    words = (t or b"").lower().split()
                    own = np.fromiter((ranks.get(w, cold) for w in words), dtype="<i4", count=len(words))
                    ids.append(own.tobytes())
                    rest.append(b" ".join([words[i] for i in np.flatnonzero(own == cold).tolist()]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(ids, pa.binary()), pa.array(rest, pa.binary())], names=["doc_id", "held_out", "ids", "cold"])

    return run


def _strings(batch: pa.RecordBatch, cold: int) -> Iterator[np.ndarray]:
    """Word numbers of many texts in a row, each text with an end (``cold + 1``) before and the last one after."""
    out, room = [], 0
    for x in batch.column("ids"):
        v = np.frombuffer(x.as_buffer() or b"", dtype="<i4")
        out += [np.array([cold + 1], dtype=np.int32), v]
        room += len(v) + 1
        if room > 1 << 21:
            yield np.concatenate([*out, [cold + 1]])
            out, room = [], 0
    if out:
        yield np.concatenate([*out, [cold + 1]])


def _line(batch: pa.RecordBatch, cold: int) -> np.ndarray:
    """As ``_strings``, all texts of a batch at once: text ``k`` lies between ends ``k`` and ``k + 1``."""
    end = np.array([cold + 1], dtype=np.int32)
    return np.concatenate([x for t in batch.column("ids") for x in (end, np.frombuffer(t.as_buffer() or b"", dtype="<i4"))] + [end])


def _pack(at: np.ndarray, counts: np.ndarray) -> bytes:
    raw = np.array([len(at)], "<i8").tobytes() + np.diff(at, prepend=0).astype("<i4").tobytes() + counts.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.cumsum(np.frombuffer(raw, "<i4", k, 8).astype(np.int64)), np.frombuffer(raw, "<i8", k, 8 + 4 * k)


def _merged(classes: int):
    """Rows in order of (block, merger) -> one payload for each; its size no longer depends on the number of tasks."""
    width = 2 * (classes + 2) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, table = None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(table)
            return pa.RecordBatch.from_arrays([pa.array([current[0]], pa.int32()), pa.array([_pack(at, table[at])], pa.binary())], names=["block", "payload"])

        for batch in batches:
            for key, payload in zip(zip(batch.column("block").to_pylist(), batch.column("merger").to_pylist()), batch.column("payload")):
                if key != current:
                    if current is not None:
                        yield done()
                    current, table = key, np.zeros(BLOCK_WORDS * width, dtype=np.int64)
                at, n = _unpack(payload.as_py())
                table[at] += n
        if current is not None:
            yield done()

    return run


def _contexts(classes_of, classes: int, hot: int, words: bool):
    """Training texts -> per task the class pair counts, and if asked for the packed context counts of word blocks.

    A word's row holds its successors' classes, its predecessors' classes, and how often it follows itself.
    """
    m, width = classes + 2, 2 * (classes + 2) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-contexts")
        cls = np.concatenate((classes_of.value, [classes, classes + 1])).astype(np.int32)
        pairs = np.zeros(m * m, dtype=np.int64)
        table = np.zeros((hot + 2) * width if words else 0, dtype=np.int32)  # the last two rows, rare and end, are not used
        for batch in batches:
            for ids in _strings(batch, hot):
                c = cls[ids]
                pairs += np.bincount(c[:-1] * m + c[1:], minlength=m * m)
                if not words:
                    continue
                at = ids * width if hot * width < 1 << 30 else ids.astype(np.int64) * width
                left, right = at[:-1] + c[1:], at[1:] + (c[:-1] + m)
                both = np.sort(np.concatenate((left, right)))  # counted in order: many times faster than at random places
                last = np.flatnonzero(np.append(both[1:] != both[:-1], True))
                table[both[last]] += np.diff(last, prepend=-1).astype(np.int32)
                same = np.flatnonzero(ids[:-1] == ids[1:])
                np.subtract.at(table, left[same], 1)
                np.subtract.at(table, right[same], 1)
                np.add.at(table, at[same] + (width - 1), 1)
        hit = np.flatnonzero(pairs)
        blocks, payloads = [], []
        for b in range(-(-hot // BLOCK_WORDS) if words else 0):
            part = table[b * BLOCK_WORDS * width : min(hot, (b + 1) * BLOCK_WORDS) * width]
            at = np.flatnonzero(part)
            if len(at):
                blocks.append(b)
                payloads.append(_pack(at, part[at]))
        n = len(hit)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * n + blocks, pa.int32()), pa.array([None] * n + payloads, pa.binary()), pa.array([*hit.tolist(), *[None] * len(blocks)], pa.int32()), pa.array([*pairs[hit].tolist(), *[None] * len(blocks)], pa.int64())],
            names=["block", "payload", "pair", "n"],
        )
        del table
        trim()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """Of class pairs: the sum of N log N over pairs less that over left and right class totals."""
    return float(_xlogx(n.astype(float)).sum() - _xlogx(n.sum(axis=1).astype(float)).sum() - _xlogx(n.sum(axis=0).astype(float)).sum())


def _side_gain(n: np.ndarray, counts: np.ndarray, other: np.ndarray, k0: np.ndarray, same: np.ndarray, classes: int) -> np.ndarray:
    """What the pairs with the words' contexts on one side add if a word joins each class.

    ``n[j]``: pair counts of context class ``j`` with each class; ``counts``: the words' contexts on this side, ``other``
    those on the other side; what the words themselves have added to ``n`` (unless ``k0`` is negative) is taken off first.
    """
    w, j = np.nonzero(counts)
    out = np.zeros((len(counts), classes))
    if not len(w):
        return out
    s = counts[w, j].astype(float)[:, None]
    table = n[:, :classes].astype(float)
    gain = (_xlogx(table + 1) - _xlogx(table))[j]  # as most counts are one
    k = k0[w]
    more = np.flatnonzero((s[:, 0] != 1) | (j == k))  # other counts, or a context in the word's own class
    b = table[j[more]]
    own = np.flatnonzero(j[more] == k[more])
    b[own] -= other[w[more[own]], :classes]
    inside = np.flatnonzero((k[more] >= 0) & (k[more] < classes))
    b[inside, k[more[inside]]] -= s[more[inside], 0] + np.where(j[more[inside]] == k[more[inside]], same[w[more[inside]]], 0)
    gain[more] = _xlogx(b + s[more]) - _xlogx(b)
    rest = np.setdiff1d(np.flatnonzero((k >= 0) & (k < classes)), more, assume_unique=True)
    one = table[j[rest], k[rest]] - 1.0
    gain[rest, k[rest]] = _xlogx(one + 1) - _xlogx(one)
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    out[w[first]] = np.add.reduceat(gain, first, axis=0)
    return out


def best_classes(n: np.ndarray, current: np.ndarray, succ: np.ndarray, pred: np.ndarray, same: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that raises the class bigram likelihood most, all other words staying.

    ``n``: class pair counts; ``succ``/``pred``: counts of the class after/before the word, without itself; ``same``:
    how often the word follows itself.  ``current`` is negative for words that ``n`` does not count yet, and may be a
    class beyond ``classes``, which words can leave but not join.  Ties keep the current class, else the smallest number
    wins; words without contexts stay.
    """
    out = current.copy()
    rows, cols, diag = n.sum(axis=1).astype(float), n.sum(axis=0).astype(float), n.diagonal()[:classes].astype(float)
    for a in range(0, len(current), CHUNK):
        k0, s, p, d = (x[a : a + CHUNK] for x in (current, succ, pred, same))
        k0, at = k0.astype(np.int64), np.arange(len(k0))
        gain = _side_gain(n.T, s, p, k0, d, classes) + _side_gain(n, p, s, k0, d, classes)
        inside = np.flatnonzero((k0 >= 0) & (k0 < classes))
        k = k0[inside]
        s, p, d = s[:, :classes].astype(float), p[:, :classes].astype(float), d.astype(float)[:, None]
        out_n = succ[a : a + CHUNK].sum(axis=1)[:, None] + d
        in_n = pred[a : a + CHUNK].sum(axis=1)[:, None] + d
        b = np.repeat(diag[None], len(k0), axis=0)
        b[inside, k] -= s[inside, k] + p[inside, k] + d[inside, 0]
        gain += _xlogx(b + s + p + d) - _xlogx(b + s) - _xlogx(b + p) + _xlogx(b)
        fresh = np.flatnonzero(k0 < 0)
        for total, own, back in ((rows, out_n, p), (cols, in_n, s)):
            r = np.repeat(total[None, :classes], len(k0), axis=0)
            r[inside, k] -= own[inside, 0]
            r[fresh] += back[fresh]  # what the word adds to the totals of its neighbours' classes, wherever it goes
            gain -= _xlogx(r + own) - _xlogx(r)
        top = gain.argmax(axis=1)
        stay = np.zeros(len(k0), dtype=bool)
        stay[inside] = gain[inside, top[inside]] <= gain[inside, k] + 1e-9
        stay |= (out_n + in_n)[:, 0] == 0
        out[a : a + CHUNK] = np.where(stay, k0, top)
    return out


def _exchange(classes_of, pairs, classes: int, hot: int, parity: int | None):
    """Context counts by block -> (word, class) of the words whose turn it is; all of them without ``parity``."""
    m, width = classes + 2, 2 * (classes + 2) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pairs.value
        current, table = None, None

        def done() -> pa.RecordBatch:
            first = current * BLOCK_WORDS
            ids = np.arange(first, min(first + BLOCK_WORDS, hot))
            if parity is not None:
                ids = ids[((ids * 2654435761 >> 7) & 1) == parity]
            rows = table[ids - first]
            new = best_classes(n, classes_of.value[ids].astype(np.int64), rows[:, :m], rows[:, m : 2 * m], rows[:, -1], classes)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(new, pa.int64())], names=["w", "k"])

        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                if block != current:
                    if current is not None:
                        yield done()
                    current, table = block, np.zeros((BLOCK_WORDS, width), dtype=np.int64)
                at, n_at = _unpack(payload.as_py())
                table.reshape(-1)[at] += n_at
        if current is not None:
            yield done()

    return run


def _sums(found: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for r in found.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # ``size`` rows at most
        out[r["pair"]] = r["n"]
    return out


_FOUND = "block int, payload binary, pair int, n long"


def cluster(train: DataFrame, hot: int, classes: int, sweeps: int, ws: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Class of every hot word and the class pair counts (rare words: class ``classes``, ends: ``classes + 1``)."""
    sc = train.sparkSession.sparkContext
    m = classes + 2
    own = np.full(hot, classes, dtype=np.int64)
    own[: min(hot, classes)] = np.arange(min(hot, classes))  # the most frequent words are the first members
    before: list[float] = []
    for k in range(1 + 2 * sweeps):
        shared = sc.broadcast(own)
        found = ws.keep(train.mapInArrow(_contexts(shared, classes, hot, True), _FOUND), f"contexts{k}")
        n = _sums(found, m * m).reshape(m, m)
        before.append(likelihood(n) / max(1, n.sum()))
        if k > 2 and k % 2 and before[k] - before[k - 2] < STANDS:
            ws.drop(f"contexts{k}")
            return own, n
        pairs = sc.broadcast(n)
        parts = found.where("block is not null")
        size = ws.size(f"contexts{k}")
        mergers = max(1, -(-size // (64 << 20)))
        if mergers > 1:  # a first level, so that no task reads what all tasks have found of a block
            parts = parts.select("block", F.pmod(F.xxhash64("payload"), F.lit(mergers)).cast("int").alias("merger"), "payload")
            parts = parts.repartition(ws.parts(size), "block", "merger").sortWithinPartitions("block", "merger").mapInArrow(_merged(classes), "block int, payload binary")
        blocks = parts.select("block", "payload").repartition(ws.parts(size // mergers), "block").sortWithinPartitions("block")
        moved = blocks.mapInArrow(_exchange(shared, pairs, classes, hot, (k - 1) % 2 if k else None), "w long, k long").toArrow()  # hot words at most
        new = own.copy()
        new[moved.column("w").to_numpy()] = moved.column("k").to_numpy()
        ws.drop(f"contexts{k}")
        still, own = bool((new == own).all()), new
        if still and k and k % 2 == 0:
            return own, n
    final = ws.keep(train.mapInArrow(_contexts(sc.broadcast(own), classes, hot, False), _FOUND), "pairs")
    return own, _sums(final, m * m).reshape(m, m)


def _pack_bucket(words: list[bytes], sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Words with the codes of their contexts (right: class, left: ``side`` more) and how often each was met."""
    head = np.array([len(words), len(codes)], "<i8").tobytes() + sizes.astype("<i4").tobytes() + codes.astype("<u2").tobytes() + counts.astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b" ".join(words))


def _unpack_bucket(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    w, e = np.frombuffer(raw, "<i8", 2).tolist()
    a = 16 + 4 * w
    b = a + 2 * e
    return raw[b + 8 * e :].split(b" "), np.frombuffer(raw, "<i4", w, 16), np.frombuffer(raw, "<u2", e, a), np.frombuffer(raw, "<i8", e, b)


def _rare_contexts(classes_of, classes: int, hot: int, buckets: int):
    """Training texts -> packed contexts of rare words by bucket; the own word as a neighbour has a code of its own."""
    m = classes + 2
    side = m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rare")
        cls = np.concatenate((classes_of.value, [classes, classes + 1])).astype(np.int64)
        index: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(index)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), dtype=np.int64)
            place[order] = np.arange(len(words))
            all_keys = np.concatenate(keys)
            met, counts = np.unique(place[all_keys // (2 * side)] * (2 * side) + all_keys % (2 * side), return_counts=True)
            of, codes = np.divmod(met, 2 * side)
            sizes = np.bincount(of, minlength=len(words))
            ends = np.cumsum(sizes)
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(words)]
            blobs, numbers = [], []
            for a, b in zip(cuts, cuts[1:]):
                x, y = int(ends[a] - sizes[a]), int(ends[b - 1])
                blobs.append(_pack_bucket([words[i] for i in order[a:b].tolist()], sizes[a:b], codes[x:y], counts[x:y]))
                numbers.append(int(bucket[order[a]]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "payload"])

        for whole in batches:
            for b in slices(whole, "ids", 8 << 20):
                rare = b" ".join(to_bytes(b.column("cold"))).split()
                if not rare:
                    continue
                ids = _line(b, hot)
                at = np.flatnonzero(ids == hot)
                own = np.fromiter((index.setdefault(w, len(index)) for w in rare), dtype=np.int64, count=len(rare))
                right, left = cls[ids[at + 1]], cls[ids[at - 1]]
                twice = np.flatnonzero((np.diff(at) == 1) & (own[1:] == own[:-1]))
                right[twice], left[twice + 1] = m, m
                keys += [own * (2 * side) + right, own * (2 * side) + side + left]
                held += len(rare)
                if held > HELD_TOKENS:
                    yield from flush()
                    index, keys, held = {}, [], 0
        if held:
            yield from flush()
        index, keys = {}, []
        trim()

    return run


_RARE = "bucket int, payload binary, classes binary, pair int, n long"


def _rare_batch(bucket: int | None, payload: bytes | None, own: np.ndarray | None, sums: np.ndarray) -> pa.RecordBatch:
    hit = np.flatnonzero(sums)
    one, none = int(payload is not None), [None] * len(hit)
    cols = [[bucket] * one + none, [payload] * one + none, [own.astype("<i2").tobytes()] * one + none if own is not None else none, [None] * one + hit.tolist(), [None] * one + sums[hit].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()))], names=["bucket", "payload", "classes", "pair", "n"])


def _one_row(side: int):
    """Packed contexts in order of their buckets -> one row a bucket, its words without a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rows")
        current, index, keys, times = None, {}, [], []

        def done() -> pa.RecordBatch:
            met, back = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.zeros(len(met), dtype=np.int64)
            np.add.at(counts, back, np.concatenate(times))
            of, codes = np.divmod(met, 2 * side)
            blob = _pack_bucket(list(index), np.bincount(of, minlength=len(index)), codes, counts)
            return _rare_batch(current, blob, np.full(len(index), -1), np.zeros(0, dtype=np.int64))

        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if bucket != current:
                    if current is not None:
                        yield done()
                    current, index, keys, times = bucket, {}, [], []
                words, sizes, codes, counts = _unpack_bucket(payload.as_py())
                own = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
                keys.append(np.repeat(own, sizes) * (2 * side) + codes)
                times.append(counts)
        if current is not None:
            yield done()
        trim()

    return run


def _dense(sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successors, predecessors and self-repetitions of the words of a bucket."""
    out = np.zeros((len(sizes), 2 * (m + 1)), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), codes] = counts
    return out[:, :m], out[:, m + 1 : 2 * m + 1], out[:, m]


def _join_classes(pairs, classes: int, parity: int | None):
    """Buckets -> the same with new classes for the words whose turn it is, what they add to the pair counts, and sums.

    After the ``m * m`` pairs come, for each class, its words, tokens, words seen once and words that follow themselves, and last how many moved.
    """
    m = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rare-exchange")
        n = pairs.value
        sums = np.zeros(m * m + 4 * classes + 1, dtype=np.int64)
        for batch in batches:
            for bucket, payload, held in zip(batch.column("bucket").to_pylist(), batch.column("payload"), batch.column("classes")):
                blob = payload.as_py()
                words, sizes, codes, counts = _unpack_bucket(blob)
                own = np.frombuffer(held.as_py(), "<i2").astype(np.int64)
                ends = np.cumsum(sizes)
                bits = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) >> 20 & 1
                for a in range(0, len(words), CHUNK):
                    b = min(a + CHUNK, len(words))
                    x, y = int(ends[a] - sizes[a]), int(ends[b - 1])
                    s, p, d = _dense(sizes[a:b], codes[x:y], counts[x:y], m)
                    turn = np.arange(b - a) if parity is None else np.flatnonzero(bits[a:b] == parity)
                    new = own[a:b].copy()
                    new[turn] = best_classes(n, new[turn], s[turn], p[turn], d[turn], classes)
                    sums[-1] += int((new != own[a:b]).sum())
                    own[a:b] = new
                    part = np.zeros((m, m), dtype=np.int64)
                    np.add.at(part, new, s)
                    np.add.at(part.T, new, p)
                    np.add.at(part, (new, new), d)
                    sums[: m * m] += part.reshape(-1)
                    c = s.sum(axis=1) + d
                    for k, x in enumerate((np.ones(len(c), dtype=np.int64), c, (c == 1).astype(np.int64), d)):
                        np.add.at(sums, m * m + k * classes + new, x)
                yield _rare_batch(bucket, blob, own, np.zeros(0, dtype=np.int64))
        yield _rare_batch(None, None, None, sums)
        trim()

    return run


def exchange_rare(train: DataFrame, own: np.ndarray, n: np.ndarray, tokens: int, classes: int, sweeps: int, ws: Workspace) -> tuple[DataFrame, np.ndarray]:
    """Buckets of the rare words with their classes, and the sums that come with them."""
    sc = train.sparkSession.sparkContext
    m, size = classes + 2, (classes + 2) ** 2 + 4 * classes + 1
    buckets = max(16, -(-tokens // BUCKET_TOKENS))
    packed = ws.keep(train.where(F.length("cold") > 0).mapInArrow(_rare_contexts(sc.broadcast(own), classes, len(own), buckets), "bucket int, payload binary"), "rare-packed")
    dealt = packed.repartition(ws.parts(4 * ws.size("rare-packed")), "bucket").sortWithinPartitions("bucket")
    table = ws.keep(dealt.mapInArrow(_one_row(m + 1), _RARE), "rare0")
    ws.drop("rare-packed")
    firm = n.copy()
    firm[classes], firm[:, classes] = 0, 0  # pairs with a rare word are counted under that word's class
    total, before, sums = firm, [], np.zeros(size, dtype=np.int64)
    for k in range(1 + 2 * sweeps):
        rows = table.where("bucket is not null")
        table = ws.keep(rows.mapInArrow(_join_classes(sc.broadcast(total), classes, (k - 1) % 2 if k else None), _RARE), f"rare{k + 1}")
        ws.drop(f"rare{k}")
        sums = _sums(table, size)
        total = firm + sums[: m * m].reshape(m, m)
        before.append(likelihood(total) / max(1, total.sum()))
        if k and k % 2 == 0 and (before[k] - before[k - 2] < STANDS or not sums[-1]):
            break
    return table.where("bucket is not null"), sums


def _rare_words(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rare-words")
        for batch in batches:
            for payload, held in zip(batch.column("payload"), batch.column("classes")):
                words, sizes, codes, counts = _unpack_bucket(payload.as_py())
                s, _, d = _dense(sizes, codes, counts, m)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(s.sum(axis=1) + d, pa.int64()), pa.array(np.frombuffer(held.as_py(), "<i2").astype(np.int32))], names=["w", "c", "k"])

    return run


def _rare_pairs(hot: int):
    """Numbered texts -> neighbouring rare words, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rare-pairs")
        for whole in batches:
            for b in slices(whole, "ids", 8 << 20):
                rare = b" ".join(to_bytes(b.column("cold"))).split()
                if len(rare) < 2:
                    continue
                ids = _line(b, hot)
                at = np.flatnonzero(ids == hot)
                row = (np.cumsum(ids == hot + 1) - 1)[at]
                first = np.flatnonzero(np.diff(at) == 1)
                places = first.tolist()
                rows = b.column("row").take(pa.array(row[first]))
                train = b.column("held_out").take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([rows, train, pa.array([rare[i] for i in places], pa.binary()), pa.array([rare[i + 1] for i in places], pa.binary())], names=["row", "held_out", "w1", "w2"])

    return run


@dataclass
class Model:
    """Classes of the hot words and of the others (``w, c, k``, a row for each), and the class counts."""

    hot: list[bytes]
    counts: np.ndarray  # of the hot words
    own: np.ndarray  # classes of the hot words
    rare: DataFrame
    pairs: np.ndarray  # class pair counts; the last class holds the ends, the one before it nothing
    words: np.ndarray  # distinct words of each class
    tokens: np.ndarray
    unknown: int  # the class that unknown words belong to: of those with most words seen once
    ends: int
    total: int  # training tokens
    distinct: int

    def transitions(self) -> np.ndarray:
        """log10 of the probability of a class after another; none for the empty class."""
        into = self.pairs.sum(axis=0)
        held = np.append(self.masses() > 0, [False, True])  # a class without words is never next
        prior = np.where(held, into + 0.1, 0.0)
        prior = prior / prior.sum()
        with np.errstate(divide="ignore"):
            own = (self.pairs + BETA * prior) / (self.pairs.sum(axis=1, keepdims=True) + BETA)
            out = np.log10((1 - SHARE) * own + SHARE * prior)
        out[-2], out[:, ~held] = 0.0, 0.0  # pairs with a rare word are added where its class is known
        return out

    def masses(self) -> np.ndarray:
        """What word counts plus ``ALPHA`` are divided by in each class."""
        return self.tokens + ALPHA * (self.words + (np.arange(len(self.words)) == self.unknown))

    def bottom(self) -> float:
        return self.total + ALPHA * (self.distinct + 1)


def fit(docs: DataFrame, ws: Workspace, hot_words: int = HOT_WORDS, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the numbered texts and their pairs of neighbouring rare words with both classes, by row."""
    sc = docs.sparkSession.sparkContext
    d = pick(docs, "doc_id", "text")
    kind = dict(d.dtypes)["doc_id"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    d = d.withColumn("held_out", held)
    counts = d.where("not held_out").select("text").mapInArrow(_count_words, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = ws.keep(counts, "counts")
    ends = d.where("not held_out").count()
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.where(F.length("w") <= HOT_BYTES).orderBy(F.desc("c"), "w").limit(hot_words).toArrow()  # bounded in rows and bytes
    names, c = top.column("w").to_pylist(), np.array(top.column("c").to_pylist(), dtype=np.int64)
    ws.drop("counts")
    hot, m = len(names), classes + 2
    numbered = d.mapInArrow(_number(sc.broadcast(names)), f"doc_id {kind}, held_out boolean, ids binary, cold binary")
    numbered = ws.keep(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    train = numbered.where("not held_out")
    own, n = cluster(train.select("ids"), hot, classes, sweeps, ws)
    rare_tokens = int(total["n"] or 0) - int(c.sum())
    table, sums = exchange_rare(train.select("ids", "cold"), own, n, rare_tokens, classes, sweeps, ws)
    rare = ws.keep(table.select("payload", "classes").mapInArrow(_rare_words(m), "w binary, c long, k int"), "rare-words")
    words, tokens, once, twice = sums[m * m : -1].reshape(4, classes)
    words = words + np.bincount(own[own < classes], minlength=classes)
    tokens = tokens + np.bincount(own[own < classes], weights=c[own < classes], minlength=classes).astype(np.int64)
    once = once + np.bincount(own[(own < classes) & (c == 1)], minlength=classes)
    unknown = int(once.argmax())

    met = numbered.where(F.length("cold") > 0).select("row", "held_out", "ids", "cold").mapInArrow(_rare_pairs(hot), "row long, held_out boolean, w1 binary, w2 binary")
    linked = ws.keep(met, "rare-pairs")
    for i in (1, 2):
        known = rare.select(F.col("w").alias(f"w{i}"), F.col("k").alias(f"k{i}"))
        linked = linked.join(known, f"w{i}", "left").withColumn(f"k{i}", F.coalesce(f"k{i}", F.lit(unknown))).drop(f"w{i}")
    linked = ws.keep(linked, "linked")
    pairs = n.copy()
    pairs[classes], pairs[:, classes] = 0, 0
    lone = sums[: m * m].reshape(m, m).copy()  # rare words beside hot ones and ends; beside each other they are counted below
    lone[classes], lone[:, classes] = 0, 0
    lone[np.arange(classes), np.arange(classes)] -= twice  # counted below as well
    pairs += lone
    for r in linked.where("not held_out").groupBy("k1", "k2").agg(F.count("*").alias("n")).collect():  # classes squared at most
        pairs[r["k1"], r["k2"]] += r["n"]
    return Model(names, c, own, rare, pairs, words, tokens, unknown, ends, int(total["n"] or 0) + ends, total["v"] + (ends > 0)), numbered, linked


def _score(shared, hot: int, classes: int):
    """Tokens, known ones and both scores of a text, as far as its hot words and ends go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trans, emit, base, end_known, end_base = shared.value
        cls = np.concatenate((own, [classes, classes + 1])).astype(np.int64)
        emit, base = np.append(emit, [0.0, 0.0]), np.append(base, [0.0, 0.0])
        for batch in batches:
            out = []
            for x in batch.column("ids"):
                v = np.frombuffer(x.as_buffer() or b"", dtype="<i4")
                c = np.concatenate(([classes + 1], cls[v], [classes + 1]))
                out.append((len(v) + 1, int((v < hot).sum()) + end_known, float(base[v].sum()) + end_base, float(trans[c[:-1], c[1:]].sum() + emit[v].sum())))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *cols], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _rare_tokens(classes_of, classes: int, hot: int):
    """Numbered texts -> rare words with the classes on their left and right, by row; none beside a rare word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("brown-rare-tokens")
        cls = np.concatenate((classes_of.value, [classes, classes + 1])).astype(np.int16)
        for whole in batches:
            for b in slices(whole, "ids", 4 << 20):
                rare = b" ".join(to_bytes(b.column("cold"))).split()
                ids = _line(b, hot)
                at = np.flatnonzero(ids == hot)
                rows = b.column("row").take(pa.array((np.cumsum(ids == hot + 1) - 1)[at]))
                yield pa.RecordBatch.from_arrays([rows, pa.array(rare, pa.binary()), pa.array(cls[ids[at - 1]]), pa.array(cls[ids[at + 1]])], names=["row", "w", "a", "b"])

    return run


def score_texts(docs: DataFrame, hot_words: int = HOT_WORDS, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    One row for each row.  Texts are lower-cased (A-Z) and end with one end token; the model and all counts come from
    the rows whose ``crc32`` of the id, as text, is not divisible by ten, the others are ``held_out`` (a null id trains).
    ``base_score`` is the smoothed unigram log10 probability, ``score`` the class model's, ``perplexity`` its inverse
    geometric mean per token.  ``n_known`` counts tokens seen in training.  Words that training has not seen share the
    place of one more word in the class with most words seen once.  Null and empty texts have the end token only.
    Without training rows all tokens are unknown.  Other columns are ignored.  No rows give no rows.
    """
    sc = docs.sparkSession.sparkContext
    ws = Workspace(docs.sparkSession, "brown")
    model, numbered, linked = fit(docs, ws, hot_words, classes, sweeps)
    kind, hot, m = dict(numbered.dtypes)["doc_id"], len(model.hot), classes + 2
    trans, mass, bottom = model.transitions(), model.masses(), model.bottom()
    emit = np.log10((model.counts + ALPHA) / mass[model.own])
    shared = sc.broadcast((model.own, trans, emit, np.log10((model.counts + ALPHA) / bottom), int(model.ends > 0), math.log10((model.ends + ALPHA) / bottom)))
    parts = numbered.select("row", "doc_id", "held_out", "ids").mapInArrow(_score(shared, hot, classes), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    step = F.lit(trans.reshape(-1).tolist())
    between = lambda a, b: F.when((F.col(a) == classes) | (F.col(b) == classes), 0.0).otherwise(F.get(step, F.col(a) * m + F.col(b)))
    rare = numbered.where(F.length("cold") > 0).select("row", "ids", "cold").mapInArrow(_rare_tokens(sc.broadcast(model.own), classes, hot), "row long, w binary, a short, b short")
    rare = rare.join(model.rare, "w", "left").select("row", "a", "b", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", F.lit(model.unknown)).alias("k"))
    own = F.log10((F.col("c") + ALPHA) / F.get(F.lit(mass.tolist()), "k"))
    rare = rare.select("row", (F.col("c") > 0).cast("long").alias("known"), F.log10((F.col("c") + ALPHA) / bottom).alias("b"), (own + between("a", "k") + between("k", "b")).alias("s"))
    more = rare.unionByName(linked.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("b"), between("k1", "k2").alias("s")))
    more = more.groupBy("row").agg(F.sum("known").alias("known"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    j = parts.join(more, "row", "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(b, F.lit(zero))).alias(a)
    j = j.select("doc_id", "held_out", "n_tokens", plus("n_known", "known", 0), F.lit(model.total).cast("long").alias("train_tokens"), plus("base_score", "b", 0.0), plus("score", "s", 0.0))
    return j.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
