"""Bit fingerprints as arrays of 32-bit words held in bigints, and distances between them.

A distance builder is a Python function from two word arrays to a Column;
operators take such functions as arguments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Widths of the published fingerprint layouts.
KEYS_BITS, KEYS_WORDS, KEYS_BYTES = 166, 6, 21
CIRCULAR_BITS, CIRCULAR_WORDS = 2048, 64
PART_BYTES = {"maccs": 21, "ecfp4": 256, "fcfp4": 256}
CLOSE = 0.2

UNROLLED_WORDS = 8
TOKEN_GAP = r"[^\p{L}\p{N}]+"
CACHED_TOKENS = 1 << 18

Distance = Callable[[Column, Column], Column]


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of letters and digits of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != ""))


def feature_bits(features: Column, n_bits: int = KEYS_BITS, digit: int = 1) -> Column:
    """Distinct bit numbers of string features: four hex digits of md5, from ``digit``, modulo ``n_bits``."""
    if n_bits > 1 << 16:
        raise ValueError("four hex digits reach 65536 bits")
    return F.array_distinct(
        F.transform(features, lambda t: (F.conv(F.substring(F.md5(t), digit, 4), 16, 10).cast("int") % n_bits))
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _packed_word(bits: Column, word: Column) -> Column:
    mine = F.filter(bits, lambda b: F.shiftright(b, 5) == word)
    return F.aggregate(mine, F.lit(0).cast("bigint"),
                       lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 32)))


def bits_to_words(bits: Column, n_words: int = KEYS_WORDS) -> Column:
    """Bit b sets bit ``b % 32`` of word ``b // 32``.

    Wide fingerprints first sort their bits into runs of 8 words.
    """
    def words_between(some: Column, first: Column, last: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda i: _packed_word(some, i))

    if n_words <= UNROLLED_WORDS:
        return _once(bits, lambda bs: words_between(bs, F.lit(0), F.lit(n_words - 1)))

    def run_of_words(bs: Column, run: Column) -> Column:
        first = run * 8
        return _once(F.filter(bs, lambda b: F.shiftright(b, 8) == run),
                     lambda few: words_between(few, first, F.least(first + 7, F.lit(n_words - 1))))

    runs = F.sequence(F.lit(0), F.lit((n_words - 1) // 8))
    return _once(bits, lambda bs: F.flatten(F.transform(runs, lambda r: run_of_words(bs, r))))


def text_words(text: Column, n_bits: int = KEYS_BITS, n_words: int = KEYS_WORDS, digit: int = 1) -> Column:
    """Hashed-token fingerprint of a text; NULL where the text has no token."""
    return _once(tokens(text), lambda parts: F.when(
        F.size(parts) > 0, bits_to_words(feature_bits(parts, n_bits, digit), n_words)))


class TokenBits(dict):
    """Bit number by token; the hash of a token that is not cached is taken again."""

    def __init__(self, n_bits: int, digit: int):
        super().__init__()
        self.n_bits, self.digit = n_bits, digit

    def __missing__(self, token: str) -> int:
        bit = int(hashlib.md5(token.encode()).hexdigest()[self.digit - 1:self.digit + 3], 16) % self.n_bits
        if len(self) < CACHED_TOKENS:
            self[token] = bit
        return bit


@lru_cache(maxsize=8)
def token_bits(n_bits: int, digit: int) -> TokenBits:
    """One cache per worker process and layout."""
    return TokenBits(n_bits, digit)


def pack_tokens(texts: pa.Array, n_bits: int, n_words: int, digit: int) -> pa.Array:
    """Fingerprint words of texts whose tokens stand between single blanks; null for texts without a token."""
    bit = token_bits(n_bits, digit)
    on = np.zeros((len(texts), 32 * n_words), bool)
    known = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        found = set((text.as_py() or "").split(" "))
        found.discard("")
        if found:
            known[i] = True
            on[i, list(map(bit.__getitem__, found))] = True
    words = np.packbits(on, axis=1, bitorder="little").view("<u4").astype(np.int64)
    ends = pa.array(np.arange(len(texts) + 1) * n_words, pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(words.ravel()), mask=pa.array(~known))


def encode_text(text: Column, n_bits: int = KEYS_BITS, n_words: int = KEYS_WORDS, digit: int = 1) -> Column:
    """The same words as :func:`text_words`, encoded in Arrow batches.

    Case and token borders are decided by the same JVM functions; a worker splits at blanks, looks its tokens up in a cache of hashes
    and sets the bits of a whole batch at once.
    """
    if n_bits > 1 << 16:
        raise ValueError("four hex digits reach 65536 bits")

    @F.arrow_udf("array<bigint>")
    def packed(texts: pa.Array) -> pa.Array:
        return pack_tokens(texts, n_bits, n_words, digit)

    return packed(F.regexp_replace(F.lower(text), TOKEN_GAP, " "))


def words_to_bytes(words: Column) -> Column:
    """Packed binary, four big-endian bytes per word."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 8, "0")), ""))


def bytes_to_words(packed: Column, n_words: int) -> Column:
    """Inverse of :func:`words_to_bytes`."""
    return F.array(*[
        F.conv(F.hex(F.substring(packed, 4 * i + 1, 4)), 16, 10).cast("bigint") for i in range(n_words)
    ])


def export_bytes(packed: Column, width: int = KEYS_BYTES) -> Column:
    """Non-null fixed-width form: a missing fingerprint becomes zero bytes at the output edge."""
    return F.coalesce(F.substring(packed, 1, width), F.unhex(F.lit("00" * width)))


def concat_words(*parts: Column) -> Column:
    """Composite fingerprint. Word arrays are already padded to whole words."""
    return F.concat(*parts)


def padded_bytes(width: int) -> int:
    """Width of a packed part once it fills whole 32-bit words."""
    return -(-width // 4) * 4


def concat_bytes(**parts: Column) -> Column:
    """Composite in packed form, from named parts; each is padded to whole words."""
    columns = []
    for name, packed in parts.items():
        width = PART_BYTES[name]
        columns += [packed, F.unhex(F.lit("00" * (padded_bytes(width) - width)))]
    return F.concat(*columns)


def composite_bytes(*parts: str) -> int:
    return sum(padded_bytes(PART_BYTES[p]) for p in parts)


def composite_bits(*parts: str) -> int:
    return 8 * composite_bytes(*parts)


def table_name(*parts: str) -> str:
    """Name of the search table of a composite, from its parts in layout order."""
    return "-".join(["index", *[p for p in PART_BYTES if p in parts]])


def basic_features(features: Column, rich: bool = False) -> Column:
    """The first two features of an array column, or all of them."""
    return features if rich else F.slice(features, 1, 2)


def _sum_bits(a: Column, b: Column, both: Callable[[Column, Column], Column], start: int, n_words: int) -> Column:
    if n_words <= UNROLLED_WORDS:
        return reduce(add, [F.bit_count(both(a[i], b[i])) for i in range(start, start + n_words)])
    left, right = F.slice(a, start + 1, n_words), F.slice(b, start + 1, n_words)
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(both(x, y))), F.lit(0), lambda s, x: s + x)


def popcount(words: Column, n_words: int = KEYS_WORDS) -> Column:
    """Number of set bits."""
    if n_words <= UNROLLED_WORDS:
        return reduce(add, [F.bit_count(words[i]) for i in range(n_words)])
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def shared_bits(a: Column, b: Column, n_words: int = KEYS_WORDS, start: int = 0) -> Column:
    return _sum_bits(a, b, lambda x, y: x.bitwiseAND(y), start, n_words)


def any_bits(a: Column, b: Column, n_words: int = KEYS_WORDS, start: int = 0) -> Column:
    return _sum_bits(a, b, lambda x, y: x.bitwiseOR(y), start, n_words)


def tanimoto(n_words: int = KEYS_WORDS, start: int = 0) -> Distance:
    """``1 - |a and b| / |a or b|`` over a slice of the words; NULL if both are empty."""
    def distance(a: Column, b: Column) -> Column:
        union = any_bits(a, b, n_words, start)
        return F.when(union > 0, F.lit(1.0) - shared_bits(a, b, n_words, start).cast("double") / union)

    return distance


tanimoto_keys = tanimoto(KEYS_WORDS)
tanimoto_circular = tanimoto(CIRCULAR_WORDS)
tanimoto_mixed = tanimoto(KEYS_WORDS + CIRCULAR_WORDS)


def tanimoto_conditional(a: Column, b: Column) -> Column:
    """Key distance if it exceeds 0.2, else 0.2 times the circular distance of the composite."""
    first = tanimoto(KEYS_WORDS)(a, b)
    second = tanimoto(CIRCULAR_WORDS, KEYS_WORDS)(a, b)
    return F.when(first > CLOSE, first).otherwise(F.lit(CLOSE) * second)
