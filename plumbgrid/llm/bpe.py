"""BPE encoding and decoding of whole texts by tree concatenation.

A text of more than ``LEAF_BYTES`` is halved, wherever the halves fall, until its pieces are small; the pieces are
encoded by themselves and joined pairwise up the tree.  At each join a window around the cut is encoded again; it grows
until, on both sides, a token that ends a word or several tokens in a row have the same ids and the same places in the
window as in the half.  What lies between these two places comes from the window, the rest from the halves; a window
that covers both halves settles every case.  Pieces of texts beyond ``SPREAD_BYTES`` are encoded in different tasks.

White space always separates words in the vocabularies used this way, so pieces and windows look words up in a bounded
two-generation table first.  Unknown words of printable ASCII and Latin-1 letters, which are in normal form whatever
stands beside them, go to the library's BPE model, split as the tokenizer's own pattern splits them; all other words go
through the whole tokenizer, many at a time.  Letter case is left to the tokenizer's order: normal form first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.workspace import bound_batches

from .text import CACHES, claim, pick, slices, to_bytes, trim

LEAF_BYTES = 4 << 10
SPREAD_BYTES = 32 << 10
TABLE = 160_000  # words in a generation of the table
LONGEST_KEPT = 256  # bytes; longer words are not kept
AGREE = 4  # tokens in a row that settle a side where no word ends
WINDOW = 64  # bytes on each side of a cut at first

# fixed values: the pattern of the tokenizer file whose words may be split here, and the same for the characters of EASY
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Printable ASCII and the letters of Latin-1 with upper and lower case: no mark combines among them.
EASY = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True  # what bytes.split() parts at


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies; printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _splits_as_known(spec: dict) -> bool:
    """Whether the tokenizer normalises, splits and merges in the way that ``SPLIT`` and the model alone reproduce."""
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    return (
        [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"]
        and norm[1]["pattern"] == {"Regex": "\\s+"}
        and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        and pre[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        and not pre[1]["add_prefix_space"]
        and not pre[1]["use_regex"]
        and model["type"] == "BPE"
        and not (model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"))
    )


class Codec:
    """A tokenizer with its word table; built once per worker process."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(spec)
        self.t.no_truncation()
        self.t.no_padding()
        self.model = self.t.model
        parsed = json.loads(spec)
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        size = self.t.get_vocab_size(with_added_tokens=True)
        tokens = [self.t.id_to_token(i) or "" for i in range(size)]
        self.pieces = [b" " + x.encode() for x in tokens]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.ends_word = np.array([bool(suffix) and x.endswith(suffix) for x in tokens])
        self.sizes = np.array([len(x.removesuffix(suffix) if suffix else x) for x in tokens], dtype=np.int64)  # a character a byte
        self.easy = _splits_as_known(parsed)
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        #: packed ids of words, by age
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: places of the tokens in words, in bytes, where they do not follow from the tokens' lengths
        self.places: dict[bytes, np.ndarray] = {}
        self.long_places: dict[bytes, np.ndarray] = {}  # of the piece at hand

    def _learn(self, unknown: list[bytes], found: dict[bytes, bytes], places: dict[bytes, np.ndarray]) -> None:
        """Encode distinct words, joined by spaces, and part the ids by the words' places."""
        at = 0
        while at < len(unknown):
            room, stop = 0, at
            while stop < len(unknown) and (room < 1 << 16 or stop == at):
                room += len(unknown[stop]) + 1
                stop += 1
            words = [w.decode("utf-8", "replace") for w in unknown[at:stop]]
            e = self.t.encode(" ".join(words), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in words])
            ids, offsets = e.ids, np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            owner = np.searchsorted(begins, offsets[:, 0], side="right") - 1
            bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
            packed = np.array(ids, dtype="<u4").tobytes()
            for k, (raw, w) in enumerate(zip(unknown[at:stop], words)):
                a, b = bounds[k], bounds[k + 1]
                place = offsets[a:b] - begins[k]
                if len(raw) != len(w):  # from characters to bytes
                    place = np.cumsum([0] + [len(c.encode()) for c in w])[np.minimum(place, len(w))]
                found[raw] = packed[4 * a : 4 * b]
                places[raw] = place.astype(np.int32)
            at = stop

    def _spell(self, text: str) -> bytes:
        """Packed ids of an easy word by the model alone, its parts through the table."""
        parts = SPLIT.findall(text.lower())
        packed = self.packed
        if len(parts) == 1:
            p = parts[0] if parts[0].isascii() else parts[0].encode().decode("latin-1").translate(self.letters)
            return b"".join([packed[x.id] for x in self.model.tokenize(p)])
        some = []
        for p in parts:
            raw = p.encode()
            e = self.young.get(raw) or self.old.get(raw)
            if e is None:
                e = self._spell(p)
                if len(raw) <= LONGEST_KEPT:
                    self.young[raw] = e
            some.append(e)
        return b"".join(some)

    def entries(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        if len(self.young) > TABLE:
            self.old, self.young = self.young, {}
            self.places = {w: v for w, v in self.places.items() if w in self.old}
        young, old, easy = self.young, self.old, self.easy
        extra: dict[bytes, bytes] = {}
        hard: list[bytes] = []
        packed, model = self.packed, self.model
        for w in set(words).difference(young):
            v = old.get(w)
            if v is None:
                if easy and w.isalpha() and w.islower():  # of bytes: a-z only
                    v = b"".join([packed[x.id] for x in model.tokenize(w.decode())])
                else:
                    t = w.decode("utf-8", "replace")
                    if not easy or b"<|" in w or not EASY.fullmatch(t):
                        hard.append(w)
                        continue
                    v = self._spell(t)
            (young if len(w) <= LONGEST_KEPT else extra)[w] = v
        if hard:
            self._learn([w for w in hard if len(w) <= LONGEST_KEPT], young, self.places)
            self._learn([w for w in hard if len(w) > LONGEST_KEPT], extra, self.long_places)
        return [young.get(w) or extra.get(w, b"") for w in words] if extra else list(map(young.__getitem__, words))

    def leaf(self, text: bytes) -> bytes:
        """Packed ids of one piece."""
        return b"".join(self.entries(text.split()))

    def spans(self, text: bytes) -> np.ndarray:
        """Rows (id, start, end) of a piece, in bytes."""
        words = text.split()
        self.long_places = {}
        some = self.entries(words)
        ids = np.frombuffer(b"".join(some), dtype="<u4")
        counts = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) >> 2
        gap = _SPACE[np.frombuffer(text, dtype=np.uint8)]
        begins = np.flatnonzero(~gap & np.append(True, gap[:-1])) if len(gap) else np.zeros(0, dtype=np.int64)
        last = np.cumsum(counts)
        size = self.sizes[ids]
        upto = np.append(0, np.cumsum(size))
        out = np.empty((len(ids), 3), dtype=np.int64)
        out[:, 0] = ids
        out[:, 1] = upto[:-1] + np.repeat(begins - upto[last - counts], counts)
        out[:, 2] = out[:, 1] + size
        for places in filter(None, (self.places, self.long_places)):
            for k in [k for k, w in enumerate(words) if w in places]:
                out[last[k] - counts[k] : last[k], 1:] = places[words[k]] + begins[k]
        return out

    def _settled(self, a: np.ndarray, b: np.ndarray, tail: bool) -> tuple[int, int] | None:
        """Positions in ``a`` and ``b`` up to which (``tail``: from which) a shared run of tokens is settled."""
        where = {tuple(x): i for i, x in enumerate(a.tolist())}
        ends, run, before, found = self.ends_word, 0, -1, None
        for k, x in enumerate(b.tolist()):
            i = where.get(tuple(x))
            if i is None:
                run = 0
                continue
            run = run + 1 if run and i == before + 1 else 1
            before = i
            if run >= AGREE or (run >= 2 and ends[x[0]]):
                found = (i, k)
                if tail:
                    break
        return found

    def join(self, left: np.ndarray, right: np.ndarray, text: bytes, begin: int, cut: int, end: int) -> np.ndarray:
        """Tokens of ``text[begin:end]`` from those of its halves, all with places in the whole text."""
        reach = WINDOW
        while True:
            lo, hi = max(begin, _floor(text, cut - reach)), min(end, _floor(text, cut + reach))
            w = self.spans(text[lo:hi])
            w[:, 1:] += lo
            whole_left, whole_right = lo == begin, hi == end
            l0 = np.searchsorted(left[:, 1], lo)
            r1 = np.searchsorted(right[:, 1], hi, side="right")
            a = None if whole_left else self._settled(left[l0:], w[w[:, 2] <= cut], tail=False)
            b = None if whole_right else self._settled(right[:r1], w[(skip := int(np.searchsorted(w[:, 1], cut))) :], tail=True)
            if (whole_left or a) and (whole_right or b):
                head, first = (left[:0], 0) if whole_left else (left[: l0 + a[0] + 1], a[1] + 1)
                last, rest = (len(w), right[:0]) if whole_right else (skip + b[1], right[b[0] :])
                if first <= last:
                    return np.concatenate((head, w[first:last], rest))
            reach *= 2

    def tree(self, text: bytes, cuts: list[int], leaves: list[np.ndarray]) -> np.ndarray:
        """Join neighbouring leaves, given with places in the whole text, level by level; ``cuts`` bound them."""
        while len(leaves) > 1:
            joined, bounds = [], [cuts[0]]
            for k in range(0, len(leaves) - 1, 2):
                joined.append(self.join(leaves[k], leaves[k + 1], text, cuts[k], cuts[k + 1], cuts[k + 2]))
                bounds.append(cuts[k + 2])
            if len(leaves) % 2:
                joined.append(leaves[-1])
                bounds.append(cuts[-1])
            leaves, cuts = joined, bounds
        return leaves[0]

    def grown(self, text: bytes, leaf_bytes: int) -> np.ndarray:
        """Rows (id, start, end) of a text by the tree over its pieces."""
        cuts = halves(text, leaf_bytes)
        leaves = []
        for a, b in zip(cuts, cuts[1:]):
            s = self.spans(text[a:b])
            s[:, 1:] += a
            leaves.append(s)
        return self.tree(text, cuts, leaves)

    def encode(self, text: bytes, leaf_bytes: int) -> bytes:
        """Packed ids of a text: one leaf, or a tree of them."""
        if len(text) <= leaf_bytes:
            return self.leaf(text)
        return self.grown(text, leaf_bytes)[:, 0].astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))[1:]


def _floor(text: bytes, at: int) -> int:
    """The start of the character that holds byte ``at``."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def halves(text: bytes, leaf_bytes: int) -> list[int]:
    """Places of the cuts, between characters, when a text is halved until every piece has about ``leaf_bytes`` at most."""
    mid = _floor(text, len(text) // 2)
    if len(text) <= leaf_bytes or mid == 0:
        return [0, len(text)]
    return halves(text[:mid], leaf_bytes) + [mid + c for c in halves(text[mid:], leaf_bytes)[1:]]


_CODECS: dict[str, Codec] = {}
CACHES["bpe"] = _CODECS.clear


def _codec(spec: str) -> Codec:
    claim("bpe")
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _done() -> None:
    """Idle workers outlive a task, so word tables go with it; the next task learns its words anew."""
    for c in _CODECS.values():
        c.forget()
    trim()


def _row(ids: bytes, decoded: bytes, full: bool) -> tuple:
    out = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return (*out, np.frombuffer(ids, dtype="<i4"), decoded) if full else out


def _types(full: bool):
    own = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.binary()] * full
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full
    return own, names, ddl


def _emit(keys: list[pa.Array], key_names: list[str], rows: list[tuple], full: bool) -> pa.RecordBatch:
    types, names, _ = _types(full)
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
    return pa.RecordBatch.from_arrays([*keys, *cols], names=[*key_names, *names])


def encode_texts(docs: DataFrame, tokenizer_file: str, full: bool = True, leaf_bytes: int = LEAF_BYTES, spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]``, a row for each row.

    The ids are those of the tokenizers library for the whole text without added special tokens, truncation or padding;
    ``decoded`` is its decoding with special tokens kept (UTF-8 bytes).  Digests cover the ids as little-endian 32-bit
    integers and the decoded bytes.  Null texts count as empty and have no tokens.  Ids may repeat or be null.  Other
    columns are ignored.  No rows give no rows.  The tokenizer file is read on the driver and broadcast; it must have no
    decoder of its own and drop white space between words, else ``ValueError``.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    parsed = json.loads(spec)
    if parsed.get("decoder") or '"behavior": "Removed"' not in json.dumps(parsed.get("pre_tokenizer")):
        raise ValueError("a tokenizer that drops white space and has no decoder is needed")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    ddl = _types(full)[2]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                yield _emit([b.column("doc_id")], ["doc_id"], [_row(i, codec.decode(i), full) for i in (codec.encode(t, leaf_bytes) for t in to_bytes(b.column("text")))], full)
        _done()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                for i, text in enumerate(to_bytes(b.column("text"))):
                    cuts = halves(text, spread_bytes)
                    one = [text[x:y] for x, y in zip(cuts, cuts[1:])]
                    ids = b.column("doc_id").slice(i, 1).take(pa.array([0] * len(one)))
                    hs = b.column("h").slice(i, 1).take(pa.array([0] * len(one)))
                    yield pa.RecordBatch.from_arrays([ids, hs, pa.array(range(len(one)), pa.int32()), pa.array(one, pa.binary())], names=["doc_id", "h", "piece", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                spans = [codec.grown(t, leaf_bytes).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.binary())], names=["doc_id", "h", "piece", "text", "spans"])
        _done()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            for i, parts in enumerate(b.column("parts").to_pylist()):
                texts = [p["text"] for p in parts]
                cuts = np.cumsum([0] + [len(t) for t in texts]).tolist()
                own = []
                for p, at in zip(parts, cuts):
                    s = np.frombuffer(p["spans"], dtype="<i4").reshape(-1, 3).astype(np.int64)
                    s[:, 1:] += at
                    own.append(s)
                ids = codec.tree(b"".join(texts), cuts, own)[:, 0].astype("<u4").tobytes()
                row = _row(ids, codec.decode(ids), full)
                yield _emit([b.column("doc_id").slice(i, 1), b.column("h").slice(i, 1)], ["doc_id", "h"], [row], full)
        _done()

    small = F.octet_length("text") <= spread_bytes
    direct = d.where(small).mapInArrow(short, f"doc_id {kind}, {ddl}")
    long = d.where(~small).withColumn("h", F.xxhash64("text"))
    part = long.mapInArrow(pieces, f"doc_id {kind}, h long, piece int, text binary").dropDuplicates(["doc_id", "h", "piece"])
    leaf = part.mapInArrow(leaves, f"doc_id {kind}, h long, piece int, text binary, spans binary")
    whole = leaf.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("piece", "text", "spans"))).alias("parts"))
    done = whole.mapInArrow(trees, f"doc_id {kind}, h long, {ddl}")
    rows = long.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"))
    again = rows.join(done, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("kh") == F.col("h"))).drop("k", "kh", "h")
    return direct.unionByName(again)
