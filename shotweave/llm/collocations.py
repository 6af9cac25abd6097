"""Phrase collocations: frequent phrases counted by a double-array trie that every task walks over its text.

Words are counted first. Texts are then written once as numbers of frequent words, with gaps where a piece ends or a word is rare.
Level by level, a phrase becomes a candidate when the phrases without its last and without its first word are candidates where it
stands (so no frequent one is lost) and it stands often enough in all. All candidates of two and more words form one trie; its
walk counts them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.flat import flat_text, lower_ascii, mix, pieces, ramp
from shotweave.llm.registry import query, table
from shotweave.llm.scratch import Scratch
from shotweave.llm.spans import Tally, WordTable, flat_lists, list_chunks, runs_of, two_hashes
from shotweave.plans.ranking import running_totals

LONGEST = 5
LEAST = 100
TOP = 2000
DICTIONARY = 1 << 21
TRIE_PHRASES = 1 << 20
CHUNK_NUMBERS = 1 << 19
SHARD_PHRASES = 1 << 14
WIDE, DIGIT = 128, 10
MOST_TRIED, MOST_TRIES, ROOM = 128, 1024, 4
MOST_FLAGS = 1 << 25
FAN_IN = 64
UNKNOWN = "und"
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"


def lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def flags_of(members: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


def words_in(batch: pa.RecordBatch, seed: int = 0):
    """Words of ``batch(text, lang)``: two hashes over language and word, whether a piece ends before the word, its row, and the bytes
    with the places of the words."""
    data, offsets = flat_text(batch, "text")
    data = lower_ascii(data)
    ends = flags_of(PIECE_ENDS)[data]
    start, end, row = runs_of(~(ends | flags_of(GAPS)[data]), offsets)
    before = np.r_[0, np.cumsum(ends)]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (before[start[1:]] != before[end[:-1]]) | (row[1:] != row[:-1])
    langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    codes = np.array([lang_code(x) for x in langs.dictionary.to_pylist()] or [0], np.uint64)
    code = codes[langs.indices.to_numpy(zero_copy_only=False)][row] if len(row) else np.zeros(0, np.uint64)
    h, v = (mix(x ^ code) for x in two_hashes(data, start, end, seed))
    return h, v, fresh, row, (data, start, end)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang, word, c`` over ``docs(text, lang)``: words with at least ``least`` occurrences in their language, and one row with a null
    word for all its occurrences. Tasks sum before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def distinct(h, v, c, word, lang):
            order = np.lexsort((v, h))
            h, v = h[order], v[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])][:len(h)])
            at = order[new]
            return h[new], v[new], np.add.reduceat(c[order], new) if len(new) else c, word.take(pa.array(at)), lang.take(pa.array(at))

        def merged():
            columns = list(zip(*parts))
            arrays = [np.concatenate(c) for c in columns[:3]] + [pa.concat_arrays(c) for c in columns[3:]]
            return distinct(*arrays)

        for piece in pieces(batches, "text"):
            h, v, _, row, (data, start, end) = words_in(piece)
            if not len(h):
                continue
            order = np.lexsort((v, h))
            new = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (v[order][1:] != v[order][:-1])])
            at, counts = order[new], np.diff(np.r_[new, len(h)])
            lengths = end[at] - start[at]
            ends = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            word = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(data[np.repeat(start[at], lengths) + ramp(lengths)]))
            lang = piece.column(1).cast(pa.string()).take(pa.array(row[at]))
            parts.append((h[at], v[at], counts, word, lang))
            size += len(at)
            if size > 1 << 20:
                parts = [merged()]
                size = len(parts[0][0])
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([parts[0][4], parts[0][3], pa.array(parts[0][2])], names=["lang", "word", "c"])
                    parts, size = [], 0
        if parts:
            _, _, c, word, lang = merged()
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(c)], names=["lang", "word", "c"])

    found = docs.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    kept = F.when(F.col("c") >= least, F.col("word"))
    return found.groupBy("lang", kept.alias("word")).agg(F.sum("c").alias("c"))


def number_texts(docs: DataFrame, words: DataFrame, scratch: Scratch, dictionary: int = DICTIONARY) -> DataFrame:
    """``ids``: per text of ``docs(text, lang)`` the numbers of its words in ``words(lang, word, id)``, 0 between pieces and for other
    words. Runs of zeros are one, words with zeros on both sides are left out.

    ``dictionary`` words go to every task at a time; beyond that, further rounds read and write texts and numbers together.
    """
    spark = docs.sparkSession
    total = words.agg(F.max("id")).first()[0] or 0
    rounds = max(1, -(-total // dictionary))

    def round_of(rows, last: bool):
        langs = np.array([lang_code(r["lang"]) for r in rows], np.uint64)
        raw = [r["word"].encode() for r in rows]
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        known = spark.sparkContext.broadcast(WordTable(
            lambda seed: tuple(mix(x ^ langs) for x in two_hashes(data, ends[:-1], ends[1:], seed)),
            np.array([r["id"] for r in rows], np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = known.value
            for piece in pieces(batches, "text"):
                h, v, fresh, row, _ = words_in(piece, find.seed)
                number = find.find(h, v)
                if "ids" in piece.schema.names:
                    number = np.maximum(number, piece.column(2).flatten().to_numpy(zero_copy_only=False))
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
                if not last:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), lists], names=["text", "lang", "ids"])
                    continue
                x = np.insert(number, np.flatnonzero(fresh), 0)
                x_row = np.insert(row, np.flatnonzero(fresh), row[fresh])
                alone = (np.r_[0, x[:-1]] == 0) & (np.r_[x[1:], 0] == 0)
                x = np.where(alone, 0, x)
                keep = (x != 0) | (np.r_[0, x[:-1]] != 0)
                x, x_row = x[keep], x_row[keep]
                ends = np.searchsorted(x_row, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists], names=["ids"])

        return run

    out = docs.select("text", "lang")
    for number in range(rounds):
        rows = words.filter(F.col("id").between(number * dictionary + 1, (number + 1) * dictionary)).collect()
        last = number == rounds - 1
        step = out.mapInArrow(round_of(rows, last), "ids array<int>" if last else "text string, lang string, ids array<int>")
        written = scratch.write(step.filter(F.size("ids") > 0) if last else step)
        if number:
            scratch.drop(out)
        out = written
    return out


class Room:
    """Slots of a double array under construction. ``check`` is the parent of a slot, -1 where it is free; the last ``alphabet + 1`` slots
    stay free, so that any word may be added to any base."""

    def __init__(self, alphabet: int, check: np.ndarray):
        self.alphabet, self.check = alphabet, check
        self.rng = np.random.default_rng(len(check))

    def extend(self, slots: int) -> None:
        self.check = np.concatenate([self.check, np.full(slots, -1, np.int32)])

    def free(self) -> np.ndarray:
        low = self.alphabet + 1
        return low + np.flatnonzero(self.check[low:len(self.check) - low] < 0)

    def place(self, parents: np.ndarray, heads: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base of every parent and slot of every label; the labels of a parent start at its head and rise.

        Large groups get stretches of their own, so their labels should lie close together. The others try free places at random, all
        groups of about one size at a time; what fits is claimed, and groups that claim the same slot try again. Single labels
        take what is left.
        """
        counts = np.diff(np.r_[heads, len(labels)])
        first, span = labels[heads], labels[heads + counts - 1] - labels[heads] + 1
        base = np.zeros(len(heads), np.int64)
        own = np.flatnonzero(counts > MOST_TRIED)
        end = int(np.flatnonzero(self.check >= 0)[-1]) + 1
        base[own] = end + np.cumsum(span[own]) - span[own] - first[own]
        self.extend(max(0, end + self.alphabet + 1 - len(self.check)) + int(span[own].sum())
                    + ROOM * int(counts[counts <= MOST_TRIED].sum()) + 1024)
        self._claim(parents, heads, labels, counts, base, own)
        most = MOST_TRIED
        while most > 1:
            todo = np.flatnonzero((counts <= most) & (counts > most // 2))
            most //= 2
            tries = 4
            while len(todo):
                free = self.free()
                some = todo[:max(1, min((1 << 21) // (tries * 2 * most), len(free) // (8 * most)))]
                n = counts[some]
                goal = free[self.rng.integers(0, len(free), (len(some), tries))]
                fits = np.ones(goal.shape, bool)
                for j in range(1, int(n.max())):
                    row = np.flatnonzero(n > j)
                    fits[row] &= self.check[goal[row] + (labels[heads[some[row]] + j] - first[some[row]])[:, None]] < 0
                row = np.flatnonzero(fits.any(axis=1))
                base[some[row]] = goal[row, fits[row].argmax(axis=1)] - first[some[row]]
                done = some[row][self._claim(parents, heads, labels, counts, base, some[row])]
                if len(row) * 4 < len(some):
                    if tries < MOST_TRIES:
                        tries *= 4
                    elif not len(row):
                        self.extend(ROOM * int(counts[todo].sum()))
                failed = np.isin(some, done, invert=True)
                todo = np.r_[todo[len(some):], some[failed]]
        alone = np.flatnonzero(counts == 1)
        free = self.free()
        if len(free) < len(alone):
            self.extend(len(alone))
            free = self.free()
        base[alone] = free[:len(alone)] - first[alone]
        self.check[free[:len(alone)]] = parents[alone]
        return base, np.repeat(base, counts) + labels

    def _claim(self, parents, heads, labels, counts, base, groups: np.ndarray) -> np.ndarray:
        """Which of the groups hold all their slots; slots of the others are free again."""
        n = counts[groups]
        group = np.repeat(np.arange(len(groups)), n)
        slots = np.repeat(base[groups], n) + labels[np.repeat(heads[groups], n) + ramp(n)]
        self.check[slots] = -2 - group
        mine = self.check[slots] == -2 - group
        lost = np.bincount(group[~mine], minlength=len(groups)) > 0
        back = slots[mine & lost[group]]
        self.check[back] = -1
        self.check[slots[~lost[group]]] = parents[groups][group[~lost[group]]]
        return ~lost


@dataclass
class Trie:
    """Double array over word numbers: the child of slot ``s`` by word ``w`` is ``base[s] + w`` if ``check`` there is ``s``. Slots 1 to
    ``alphabet`` are the single words. ``number`` is the phrase of a slot, a row of ``phrases`` (words, padded with zeros).

    A slot with more than ``WIDE`` children has a base below zero: a step from it is one by ``w >> DIGIT`` from ``-base[s]`` and one by the
    rest. So no set of children is both large and scattered, and room for all is found without a search that grows with the array.
    """

    alphabet: int
    base: np.ndarray
    check: np.ndarray
    number: np.ndarray
    phrases: np.ndarray

    @classmethod
    def of(cls, alphabet: int, levels: list[np.ndarray]) -> Trie:
        """``levels[i]`` holds phrases of ``i + 2`` words; the first words of each are in the level before."""
        check = np.full(2 * alphabet + 2, -1, np.int32)
        check[:alphabet + 1] = 0
        trie = cls(alphabet, np.zeros(len(check), np.int32), check, np.full(len(check), -1, np.int32), np.zeros((0, LONGEST), np.int32))
        for phrases in levels:
            trie = trie.grown(phrases)
        return trie

    def grown(self, phrases: np.ndarray) -> Trie:
        """This trie with the phrases of one more level, whose slots and numbers come after those it has."""
        if not len(phrases):
            return self
        phrases = phrases[np.lexsort(phrases.T[::-1])]
        heads = np.flatnonzero(np.r_[True, (phrases[1:, :-1] != phrases[:-1, :-1]).any(axis=1)])
        stems, labels = phrases[heads, :-1], phrases[:, -1].astype(np.int64)
        # The slot of every head's phrase: words stand for themselves, longer ones were placed a level before.
        parents = stems[:, 0].astype(np.int64)
        for j in range(1, stems.shape[1]):
            parents, _ = self.step(parents, stems[:, j].astype(np.int64))
        room = Room(self.alphabet, self.check)
        counts = np.diff(np.r_[heads, len(phrases)])
        wide = np.repeat(counts > WIDE, counts)
        # A wide parent's children hang from one slot for each of the first digits.
        split = np.flatnonzero(wide)
        owner = np.repeat(np.arange(len(heads)), counts)
        new = split[np.r_[True, (owner[split][1:] != owner[split][:-1]) | (labels[split][1:] >> DIGIT != labels[split][:-1] >> DIGIT)][:len(split)]]
        digits, above = labels[new] >> DIGIT, owner[new]
        tops = np.flatnonzero(np.r_[True, above[1:] != above[:-1]][:len(new)])
        top_base, middle = room.place(parents[above[tops]], tops, digits) if len(new) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        starts = np.sort(np.r_[heads[counts <= WIDE], new])
        under = np.empty(len(starts), np.int64)
        is_middle = np.isin(starts, new)
        under[is_middle], under[~is_middle] = middle, parents[counts <= WIDE]
        low_base, at = room.place(under, starts, np.where(wide, labels & ((1 << DIGIT) - 1), labels))
        check = room.check
        base, number = np.zeros(len(check), np.int32), np.full(len(check), -1, np.int32)
        base[:len(self.base)], number[:len(self.number)] = self.base, self.number
        base[parents[above[tops]]] = -top_base
        base[under] = low_base
        number[at] = len(self.phrases) + np.arange(len(phrases))
        rows = np.zeros((len(phrases), LONGEST), np.int32)
        rows[:, :phrases.shape[1]] = phrases
        return Trie(self.alphabet, base, check, number, np.concatenate([self.phrases, rows]))

    def step(self, slot: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots one word further, and which of them exist."""
        base = self.base[slot]
        goal = base + word
        wide = np.flatnonzero(base < 0)
        if len(wide):
            digit = word[wide]
            middle = (digit >> DIGIT) - base[wide]
            there = self.check[middle] == slot[wide]
            goal[wide] = np.where(there, self.base[middle] + (digit & ((1 << DIGIT) - 1)), 0)
            slot = slot.copy()
            slot[wide] = middle
        return goal, (word > 0) & (self.check[goal] == slot)

    def walk(self, x: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every length from 1 on the positions of ``x`` at which a known phrase of that length starts, and its slots. All
        positions take one step at a time."""
        x = np.concatenate([x, np.zeros(longest, x.dtype)]).astype(np.int64)
        at = np.flatnonzero(x[:len(x) - longest])
        slot = x[at]
        yield 1, at, slot
        for step in range(1, longest):
            goal, alive = self.step(slot, x[at + step])
            at, slot = at[alive], goal[alive]
            yield step + 1, at, slot


def joined(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts one after another with a zero between them."""
    return np.insert(values, offsets[1:], 0)


def candidate_pass(texts: DataFrame, trie, alphabet: int, size: int, least: int) -> DataFrame:
    """``code, c``: phrases of ``size`` words whose parts without the last and without the first word are in the trie where they stand
    (single words always are); the code is the number of the first part times ``alphabet + 1`` plus the last word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if trie is None else trie.value
        tally = Tally()
        for values, offsets in list_chunks(batches, 0, CHUNK_NUMBERS):
            x = joined(values, offsets).astype(np.int64)
            if known is None:
                at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
                stem = x[at]
            else:
                *_, (_, at, slot) = known.walk(x, size - 1)
                there = np.zeros(len(x) + 1, bool)
                there[at] = True
                both = there[at + 1]
                at, stem = at[both], known.number[slot[both]].astype(np.int64)
            tally.add(*np.unique(stem * (alphabet + 1) + x[at + size - 1], return_counts=True))
            if tally.full:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tally.take()], names=["code", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in tally.take()], names=["code", "c"])

    return texts.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def trie_counts(texts: DataFrame, trie, longest: int) -> DataFrame:
    """``words, a``: occurrences of every phrase of the trie. Every task counts accepting slots in one array and returns what it saw in
    shards of ``SHARD_PHRASES`` phrases, one row each; shards of up to ``FAN_IN`` tasks are summed at a time, so no group grows with
    the number of tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie.value
        counts = np.zeros(len(known.phrases), np.int64)
        for values, offsets in list_chunks(batches, 0, CHUNK_NUMBERS):
            for size, _, slot in known.walk(joined(values, offsets), longest):
                if size > 1:
                    counts += np.bincount(known.number[slot], minlength=len(counts))
        some = np.flatnonzero(counts)
        shards, heads = np.unique(some // SHARD_PHRASES, return_index=True)
        ends = pa.array(np.r_[heads, len(some)], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(shards), pa.ListArray.from_arrays(ends, pa.array((some % SHARD_PHRASES).astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(counts[some]))], names=["shard", "at", "c"])

    def summed(rows: pa.Table) -> np.ndarray:
        out = np.zeros(SHARD_PHRASES, np.int64)
        np.add.at(out, flat_lists(rows["at"])[0], flat_lists(rows["c"])[0])
        return out

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        counts = summed(rows)
        some = np.flatnonzero(counts)
        return pa.table({"shard": [key[0].as_py()], "task": [key[1].as_py()], "at": pa.array([some.astype(np.int32)], pa.list_(pa.int32())),
                         "c": pa.array([counts[some]], pa.list_(pa.int64()))})

    def spell(key: tuple, rows: pa.Table) -> pa.Table:
        known, counts = trie.value, summed(rows)
        some = np.flatnonzero(counts)
        flat = known.phrases[some + key[0].as_py() * SHARD_PHRASES]
        ends = pa.array(np.r_[0, np.cumsum((flat > 0).sum(axis=1))], pa.int32())
        return pa.table({"words": pa.ListArray.from_arrays(ends, pa.array(flat[flat > 0])), "a": counts[some]})

    columns = "shard long, at array<int>, c array<long>"
    parts, tasks = texts.mapInArrow(run, columns).withColumn("task", F.spark_partition_id()), texts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        parts = parts.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("shard", "task").applyInArrow(
            add, "shard long, task int, at array<int>, c array<long>")
        tasks = -(-tasks // FAN_IN)
    return parts.groupBy("shard").applyInArrow(spell, "words array<int>, a long")


def frequent_phrases(texts: DataFrame, alphabet: int, scratch: Scratch, longest: int, least: int,
                     trie_phrases: int = TRIE_PHRASES) -> DataFrame:
    """``words, a``: all phrases of 2 to ``longest`` words with at least ``least`` occurrences in ``texts(ids)``.

    Pairs are counted once for all. Phrases are then dealt by their first word into shares of about ``trie_phrases`` pairs, usually
    one; each share gets a trie of its own, so that what is broadcast stays bounded and more phrases mean more passes. Within a
    single share both parts of a phrase are tested; with several, the second part may lie in another share, and a filter of all
    pairs tests its last two words.
    """
    sc = texts.sparkSession.sparkContext
    pairs = scratch.write(candidate_pass(texts, None, alphabet, 2, least))
    shares = max(1, -(-pairs.count() // trie_phrases))
    first = F.expr(f"code div {alphabet + 1}")

    def codes_of(share: int) -> np.ndarray:
        mine = pairs.filter(F.pmod(F.xxhash64(first), F.lit(shares)) == share).select("code")
        return mine.toArrow()["code"].to_numpy()

    seen = sc.broadcast(pair_filter(map(codes_of, range(shares)), shares * trie_phrases)) if shares > 1 else None
    out = None
    for share in range(shares):
        codes = codes_of(share)
        levels = [np.stack([codes // (alphabet + 1), codes % (alphabet + 1)], axis=1).astype(np.int32)]
        trie = Trie.of(alphabet, levels)
        for size in range(3, longest + 1):
            if not len(levels[-1]):
                break
            shared = sc.broadcast(trie)
            grown = candidate_pass(texts, shared, alphabet, size, least) if shares == 1 else extended(texts, shared, alphabet, size, least, seen)
            codes = grown.select("code").toArrow()["code"].to_numpy()
            shared.destroy()
            stems = trie.phrases[codes // (alphabet + 1)][:, :size - 1]
            levels.append(np.column_stack([stems, (codes % (alphabet + 1)).astype(np.int32)]).reshape(-1, size))
            trie = trie.grown(levels[-1])
        part = scratch.write(trie_counts(texts, sc.broadcast(trie), longest))
        out = part if out is None else out.unionByName(part)
    return out


def pair_filter(shares: Iterator[np.ndarray], pairs: int) -> np.ndarray:
    """Flags at hashes of pair codes, some eight for a pair but at most ``MOST_FLAGS``: a pair without a flag is none of them."""
    flags = np.zeros(min(MOST_FLAGS, 1 << max(10, (8 * pairs).bit_length())), bool)
    for codes in shares:
        flags[flag_of(codes, len(flags))] = True
    return flags


def flag_of(codes: np.ndarray, size: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def extended(texts: DataFrame, trie, alphabet: int, size: int, least: int, pairs) -> DataFrame:
    """As :func:`candidate_pass` with a test of the first part, and of the last two words by a filter of all pairs, only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, tally = trie.value, pairs.value, Tally()
        for values, offsets in list_chunks(batches, 0, CHUNK_NUMBERS):
            x = np.concatenate([joined(values, offsets), [0]]).astype(np.int64)
            *_, (_, at, slot) = known.walk(x, size - 1)
            word = x[at + size - 1]
            kept = (word > 0) & seen[flag_of(x[at + size - 2] * (alphabet + 1) + word, len(seen))]
            code = known.number[slot[kept]].astype(np.int64) * (alphabet + 1) + word[kept]
            tally.add(*np.unique(code, return_counts=True))
            if tally.full:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tally.take()], names=["code", "c"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in tally.take()], names=["code", "c"])

    return texts.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))``, exact through 38 decimal digits."""
    wide, narrow = "decimal(19,0)", "decimal(18,0)"
    return F.call_function("div", (a * 1000).cast(wide) * n.cast(narrow), left.cast(wide) * right.cast(narrow))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang", trie_phrases: int = TRIE_PHRASES, dictionary: int = DICTIONARY) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    Pieces end at ``.,;:!?`` and line breaks, words at blanks and tabs, A-Z count as a-z. A phrase needs ``least`` occurrences; its score
    is that of its worst cut, and it is dropped when a longer candidate around it occurs as often. Languages are ranked apart,
    by score, occurrences and phrase, over range partitions, so that none is one task's work.

    A null language is ``und``, a null text has no words. Rows repeating an id count as texts of their own; ids and other columns are
    not read. Empty tables, or such without frequent phrases, give an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"))
    counted = scratch.write(word_counts(source, least))
    totals = counted.groupBy("lang").agg(F.sum("c").alias("n"))
    known = counted.filter("word IS NOT NULL").withColumn("_less", -F.col("c")).withColumn("_one", F.lit(1).cast("long"))
    words = scratch.write(running_totals(known, [], ["_less", "lang", "word"], {"_one": "id"}).select(
        "lang", "word", "c", F.col("id").cast("int").alias("id")))
    alphabet = words.count()
    texts = number_texts(source, words, scratch, dictionary)
    found = frequent_phrases(texts, alphabet, scratch, longest, least, trie_phrases)
    scratch.drop(texts)
    spelled = found.select("words", "a", F.posexplode("words").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    phrases = scratch.write(spelled.groupBy("words").agg(
        F.first("a").alias("a"), F.first("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase")))
    parts = phrases.select("words", F.col("a").alias("f")).unionByName(
        words.select(F.array("id").alias("words"), F.col("c").alias("f")))
    size = F.size("words")
    cuts = phrases.select("words", "a", "lang", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    left = cuts.join(parts.select(F.col("words").alias("first"), F.col("f").alias("l")), "first")
    both = left.join(parts.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest").join(totals, "lang")
    scored = both.withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    worst = scored.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    length = F.explode(F.sequence(F.lit(2), size - 1)).alias("length")
    inside = phrases.filter(size > 2).select("words", "a", length).select(
        "*", F.explode(F.sequence(F.lit(1), size - F.col("length") + 1)).alias("from")).select(
        F.slice("words", F.col("from"), F.col("length")).alias("words"), "a")
    around = inside.groupBy("words").agg(F.max("a").alias("longer"))
    kept = phrases.join(around, "words", "left").filter("longer IS NULL OR 100 * longer < 100 * a").join(worst, "words")
    rows = scratch.write(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", F.col("cut.score").cast("long").alias("score")))
    ordered = rows.select("*", (-F.col("score")).alias("_score"), (-F.col("a")).alias("_a"), F.lit(1).cast("long").alias("_one"))
    ranked = running_totals(ordered, ["lang"], ["_score", "_a", "phrase"], {"_one": "_rank"})
    return ranked.filter(F.col("_rank") <= top).select("lang", F.col("_rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _phrases_sql(size: int) -> str:
    return (f"SELECT lang, {size} AS size, list_slice(w, i, i + {size - 1}) AS words FROM "
            f"(SELECT lang, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size})")


@query(r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
t AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM t GROUP BY lang),
g AS (""" + " UNION ALL ".join(_phrases_sql(k) for k in range(1, LONGEST + 1)) + r"""),
f AS (SELECT lang, size, words, count(*) AS a FROM g GROUP BY ALL HAVING a >= 100),
c AS (SELECT lang, size, words, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.*, x.a AS l, y.a AS r, n, (1000 * c.a::HUGEINT * n) // (l::HUGEINT * r) AS score FROM c
      JOIN f x ON x.lang = c.lang AND x.words = c.words[:k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:]
      JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
i AS (SELECT lang, words[j:j + z - 1] AS words, a FROM (
        SELECT lang, words, a, z, unnest(range(1, size - z + 2)) AS j FROM (SELECT *, unnest(range(2, size)) AS z FROM f WHERE size > 2))),
m AS (SELECT lang, words, max(a) AS longer FROM i GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.words = b.words
      WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k QUALIFY rank <= 2000""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
