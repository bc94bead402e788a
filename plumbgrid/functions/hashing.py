"""Wrapping 64-bit integer arithmetic, hashes and fingerprints as plain column expressions.

Spark's ANSI arithmetic raises on overflow, so 64-bit words are added and multiplied in halves and put together by
shifts, which drop what leaves the word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF = 0xFFFFFFFF


def _signed(value: int) -> int:
    value %= 1 << 64
    return value - (1 << 64) if value >= 1 << 63 else value


def word(value: int) -> Column:
    """An unsigned 64-bit constant as a signed one."""
    return F.lit(_signed(value)).cast("long")


def _low(a: Column) -> Column:
    return a.bitwiseAND(F.lit(_HALF).cast("long"))


def _high(a: Column) -> Column:
    return F.shiftrightunsigned(a, 32)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def wrap_add(a: Column, b: Column) -> Column:
    join = lambda x, low: F.shiftleft(_high(x) + _high(b) + _high(low), 32).bitwiseOR(_low(low))
    return let(a, lambda x: let(_low(x) + _low(b), lambda low: join(x, low)))


def wrap_mul(a: Column, k: int) -> Column:
    """``a * k`` modulo 2**64 for an unsigned constant ``k``."""
    k0, k1 = k & _HALF, k >> 32 & _HALF

    def half(x: Column, y: int) -> Column:
        """32 by 32 bits to 64 bits, in two 16-bit steps."""
        lo, hi = x.bitwiseAND(F.lit(0xFFFF).cast("long")), F.shiftrightunsigned(x, 16)
        return let(F.shiftleft(hi * F.lit(y).cast("long"), 16), lambda high: wrap_add(lo * F.lit(y).cast("long"), high))

    def product(x: Column) -> Column:
        cross = let(half(_low(x), k1), lambda c: wrap_add(half(_high(x), k0), c))
        return let(F.shiftleft(_low(cross), 32), lambda c: wrap_add(half(_low(x), k0), c))

    return let(a, product)


def split_mix(a: Column) -> Column:
    """SplitMix64 of a 64-bit word (published constants)."""
    fold = lambda x, n: let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))
    x = wrap_add(a.cast("long"), word(0x9E3779B97F4A7C15))
    x = wrap_mul(fold(x, 30), 0xBF58476D1CE4E5B9)
    x = wrap_mul(fold(x, 27), 0x94D049BB133111EB)
    return fold(x, 31)


def split_mix_words(a):
    """SplitMix64 of a NumPy array of unsigned words, for code that runs in tasks."""
    import numpy as np

    u = np.uint64
    x = a.astype(u) + u(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = np.bitwise_xor(x, x >> u(shift)) * u(factor)
    return np.bitwise_xor(x, x >> u(31))


def unsigned_mod(a: Column, n: Column) -> Column:
    """The unsigned word ``a`` modulo ``n`` (below 2**31)."""
    n = n.cast("long")
    base = F.pmod(F.lit(1 << 32).cast("long"), n)
    return let(a, lambda x: F.pmod(F.pmod(_high(x), n) * base + _low(x), n))


def unsigned_order(a: Column) -> Column:
    """A signed word that sorts as the unsigned ``a`` does."""
    return a.bitwiseXOR(word(1 << 63))


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; 64 if either is empty or null."""
    part = lambda c, k: F.conv(F.substring(c, k, 8), 16, 10).cast("long")
    bits = F.bit_count(part(a, 1).bitwiseXOR(part(b, 1))) + F.bit_count(part(a, 9).bitwiseXOR(part(b, 9)))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(64)).otherwise(bits).cast("int")


def difference_hash(grid: Column) -> Column:
    """16 hex digits of an 8 x 9 grey grid, given as 72 values row by row: a bit is set where the right value is larger."""
    bits = [F.when(grid[r * 9 + c + 1] > grid[r * 9 + c], 1 << (3 - c % 4)).otherwise(0) for r in range(8) for c in range(8)]
    digits = [F.lower(F.hex((bits[k] + bits[k + 1] + bits[k + 2] + bits[k + 3]).cast("long"))) for k in range(0, 64, 4)]
    return F.concat(*digits)


def quick_hash(content: Column, block: int = 65536) -> Column:
    """SHA-256 over the size (8 bytes, little-endian) and up to three distinct blocks: start, middle, end."""
    size = F.octet_length(content).cast("long")
    places = [F.lit(0).cast("long"), F.greatest(F.lit(0), size.cast("long") / 2 - block // 2).cast("long"), F.greatest(F.lit(0), size - block).cast("long")]
    piece = lambda p: F.substring(content, p.cast("int") + 1, F.lit(block))
    head = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(size, 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for k in range(8)]))
    second = F.when(places[1] > places[0], piece(places[1])).otherwise(F.lit(b""))
    third = F.when((places[2] > places[1]) & (places[2] > places[0]), piece(places[2])).otherwise(F.lit(b""))
    return F.sha2(F.concat(head, piece(places[0]), second, third), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def input_fingerprint(path: Column, size: Column, modified_ns: Column, digits: int = 64) -> Column:
    """SHA-256 of a file's case-folded path, size and modification time, cut to ``digits``."""
    return F.substring(F.sha2(F.concat_ws("|", F.lower(path), size.cast("string"), modified_ns.cast("string")), 256), 1, digits)
