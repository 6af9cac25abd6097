"""BPE encoding and decoding by batched numpy merge rounds.

The words of a piece of text are cut with class tables over code points, told apart by hash, and only words that a task has not seen
before are merged. Merging works on many words at once: their symbols lie in one flat array; every round looks up the pairs that
changed by binary search over the sorted pair keys, finds the lowest rank of each word and merges all its occurrences there.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.flat import flat_text, gather, pieces, prefix_hash, ramp, stretch_hash
from shotweave.llm.registry import query, table

NO_RANK = np.int64(1) << 40
CACHE_WORDS = 400_000
# The code points of the property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Endings that form a word of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, from the Unicode properties L and N."""
    table_ = np.zeros(0x110000, np.uint8)
    for block in range(0, 0x110000, 0x1000):
        text = "".join(map(chr, range(block, block + 0x1000)))
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, text):
                table_[block + m.start():block + m.end()] = value
    table_[WHITE] = SPACE
    return table_


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself if visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(extra))
        extra += b not in visible
    return out


class Vocabulary:
    """Merge table, byte symbols and special tokens of a BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        chars = byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        back = {c: b for b, c in enumerate(chars)}
        text = {i: t for t, i in vocab.items()}
        specials = {i: t for t, i in self.special.items()}
        spelled = [specials[i] if i in specials else bytes(back[c] for c in text.get(i, "").removesuffix(self.suffix))
                   for i in range(self.size)]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_offsets = np.cumsum([0, *map(len, spelled)])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[start:end]``, one after another, and their offsets. No word is empty."""
        counts = end - start
        word = np.repeat(np.arange(len(start)), counts)
        raw = data[np.repeat(start, counts) + ramp(counts)]
        sym = self.first[raw]
        tail = np.cumsum(counts) - 1
        sym[tail] = self.last[raw[tail]]
        rank = np.full(len(sym), NO_RANK)
        joined = np.flatnonzero(word[1:] == word[:-1])
        rank[joined] = self.rank_of(sym[joined], sym[joined + 1])
        done_word, done_sym = [], []
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[head, len(sym)])
            lowest = np.repeat(np.minimum.reduceat(rank, head), size)
            finished = lowest == NO_RANK
            if finished.any():
                done_word.append(word[finished])
                done_sym.append(sym[finished])
                live = ~finished
                word, sym, rank, lowest = word[live], sym[live], rank[live], lowest[live]
                if not len(sym):
                    break
            hit = rank == lowest
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) != 1]          # of overlapping occurrences every second one merges
            odd = (at - at[np.flatnonzero(run)][np.cumsum(run) - 1]) & 1
            at = at[odd == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            now = moved[at]
            word, sym, rank = word[keep], sym[keep], rank[keep]
            changed = np.zeros(len(sym), bool)
            changed[now] = True
            changed[now[now > 0] - 1] = True
            stale = np.flatnonzero(changed)
            rank[stale] = NO_RANK
            stale = stale[stale + 1 < len(sym)]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale] = self.rank_of(sym[stale], sym[stale + 1])
        word = np.concatenate(done_word) if done_word else word
        sym = np.concatenate(done_sym) if done_sym else sym
        order = np.argsort(word, kind="stable")
        return sym[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(start)))]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segments(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]):
    """Rows cut at special tokens: flags of the bytes where a segment begins, and (start, end, id) of each special token."""
    raw = data.tobytes()
    found = []
    if special and any(s in raw for s in special):
        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found += [(m.start(), m.end(), special[m.group()]) for m in pattern.finditer(raw, a, b)]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    for a, b, _ in found:
        begin[a] = begin[b] = True
    return begin, found


def split_words(data: np.ndarray, begin: np.ndarray, joined_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of the words between segment starts.

    With ``joined_space`` blanks belong to words (one blank goes before its word) and digits stay together; without, blanks are
    dropped and every digit is a word.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)             # byte offset of every code point
    n = len(cp)
    cls = char_classes()[cp]
    edge = np.r_[begin[at], True]
    before = np.r_[np.uint8(255), cls[:-1]]
    before[edge[:-1]] = 255
    after = np.r_[cls[1:], np.uint8(255)]
    after[edge[1:]] = 255
    start = before != cls
    if not joined_space:
        start |= cls == NUMBER
    quote = np.flatnonzero((cp == 39) & (before != OTHER) & (after == LETTER))
    if joined_space and len(quote):
        quote = quote[(before[quote] == 255) | (cp[np.maximum(quote - 1, 0)] != 32)]
    if len(quote):
        padded = np.r_[cp, np.zeros(3, np.uint32)]
        ends = np.r_[edge, True, True, True]
        for text in ENDINGS:
            hits = quote
            for k, c in enumerate(text, 1):
                hits = hits[(padded[hits + k] == ord(c)) & ~ends[hits + k]]
            start[hits + 1] = False
            nxt = hits + 1 + len(text)
            start[nxt[nxt < n]] = True
    if joined_space:
        last_blank = np.flatnonzero((cls == SPACE) & (after != SPACE) & (after != 255))
        start[last_blank] = True
        start[last_blank[cp[last_blank] == 32] + 1] = False
        first = np.flatnonzero(start)
        return at[first], np.r_[at[first[1:]], len(data)]
    first = np.flatnonzero(start)
    end = np.r_[at[first[1:]], len(data)]
    solid = cls[first] != SPACE
    return at[first][solid], end[solid]


def normal_form(data: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in NFC and lower case (special tokens as they are). Pure ASCII takes the short way."""
    if not len(data) or int(data.max()) < 128:
        marked = special and b"<|" in data.tobytes()
        if not marked:
            return np.where((data >= 65) & (data <= 90), data | 32, data), offsets
    raw = data.tobytes()
    names = re.compile("(" + "|".join(re.escape(s.decode()) for s in special) + ")")
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        parts = names.split(raw[a:b].decode("utf-8"))
        for i in range(0, len(parts), 2):
            parts[i] = unicodedata.normalize("NFC", parts[i]).replace("Σ", "σ").lower()
        out.append("".join(parts).encode("utf-8"))
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])


class Encoder:
    """Encodes pieces of text; words stay known between pieces, at most ``CACHE_WORDS`` of them."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, offsets = self.vocab.merge(data, start, end)
        self.where = np.r_[self.where, len(self.offsets) - 1 + np.arange(len(hashes))]
        self.offsets = np.r_[self.offsets, offsets[1:] + len(self.ids)]
        self.ids = np.r_[self.ids, ids]
        self.known = np.r_[self.known, hashes]
        order = np.argsort(self.known, kind="stable")
        self.known, self.where = self.known[order], self.where[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the row offsets in them."""
        v = self.vocab
        if v.lower:
            data, offsets = normal_form(data, offsets, v.special)
        begin, found = segments(data, offsets, v.special)
        start, end = split_words(data, begin, not v.lower)
        if found:
            a, b, _ = (np.array(x) for x in zip(*found))
            slot = np.searchsorted(a, start, side="right") - 1
            free = (slot < 0) | (start >= b[np.maximum(slot, 0)])
            start, end = start[free], end[free]
        hashes = stretch_hash(prefix_hash(data), start, end)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            self.learn(distinct[new], data, start[one[new]], end[one[new]])
            at = np.searchsorted(self.known, distinct)
        flat, counts = gather(self.ids, self.offsets, self.where[at][inverse] if len(at) else np.zeros(0, np.int64))
        if found:
            keys = np.r_[start, a]
            order = np.argsort(keys, kind="stable")
            ids = np.array([i for *_, i in found])
            pool, bounds = np.r_[flat, ids], np.cumsum(np.r_[0, counts, np.ones(len(ids), np.int64)])
            flat, counts = gather(pool, bounds, order)
            start = keys[order]
        rows = np.searchsorted(start, offsets)
        return flat, np.r_[0, np.cumsum(counts)][rows]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Text of every row of ids, as UTF-8; bytes that form no character become U+FFFD."""
        v = self.vocab
        flat, counts = gather(v.bytes, v.byte_offsets, ids)
        ends = np.r_[0, np.cumsum(counts)][offsets].tolist()
        raw = flat.tobytes()
        return [raw[a:b].decode("utf-8", "replace").encode("utf-8") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs``: the ids that the vocabulary file's own tokenizer gives (special
    tokens in a text are recognised, none are added; nothing is cut or padded). A null or empty text has no ids. Rows are
    independent, so repeated rows repeat; other columns are ignored; an empty table gives an empty one.

    One scan, no shuffle. Memory is bounded by a piece of about a megabyte (or one longer text) and the word cache.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        for piece in pieces(batches, "text"):
            ids, offsets = engine.encode(*flat_text(piece, "text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for rows of ids; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        for batch in batches:
            lists = [np.asarray(x or [], np.int64) for x in batch.column(1).to_pylist()]
            ids = np.concatenate([np.zeros(0, np.int64), *lists])
            texts = engine.decode(ids, np.cumsum([0, *map(len, lists)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())],
                                             names=["doc_id", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts encoded and decoded again in one pass, so that ids never leave the
    task. Nulls and the rest as in :func:`encode_texts`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = encoder(path)
        for piece in pieces(batches, "text"):
            ids, offsets = engine.encode(*flat_text(piece, "text"))
            raw = ids.astype("<u4").tobytes()
            ends = (offsets * 4).tolist()
            yield pa.RecordBatch.from_arrays([
                piece.column(0),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in engine.decode(ids, offsets)], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), vocabulary_path("byte_bpe_50k.json"))
