"""Document fingerprints: Merkle trees over pieces, paragraphs and sections."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.flat import CHUNK_BYTES, flat_text, mix, pieces, prefix_hash, ramp, stretch_hash, words_of
from shotweave.llm.registry import query, table
from shotweave.session import cut_lineage

PIECE_WORDS = 2
SECTION_PARAGRAPHS = 4
DIGEST = 8          # hex digits of an inner node
LEAF = 5            # hex digits of a leaf, at least; see leaf_digits
LONG = 64           # bytes after which a piece is cut inside
CUT_BYTES = 16      # one in so many places inside a long piece is a cut
WINDOW = 8          # bytes that decide on a cut
ROWS_PER_RANGE = 500
MAX_RANGES = 100_000
FIRST = -(1 << 63)


def leaf_digits(leaves: int) -> int:
    """Hex digits of every leaf of a tree: so many that a leaf has its like in an unrelated tree of that size with a chance of at most
    1 in 256."""
    return LEAF + max(0, ((max(leaves, 1) - 1).bit_length() + 3) // 4 - 3)


def inner_cuts(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where to cut inside the pieces ``data[start:end]``: where the hash of the last ``WINDOW`` bytes says so (the first of places
    closer than that to each other); stretches of more than ``LONG`` bytes without such a place, as in repetitions, every ``LONG`` bytes
    from the place of the largest hash at their begin. Never inside a character."""
    at = np.repeat(start, end - start) + ramp(end - start)
    piece = np.repeat(np.arange(len(start)), end - start)
    fit = (at - start[piece] >= WINDOW) & ((data[at] & 0xC0) != 0x80)
    at, piece = at[fit], piece[fit]
    hit = stretch_hash(prefix, at - WINDOW, at) % np.uint64(CUT_BYTES) == 0
    at, piece = at[hit], piece[hit]
    apart = np.ones(len(at), bool)
    apart[1:] = (np.diff(at) >= WINDOW) | (np.diff(piece) > 0)
    low, high = np.sort(np.r_[start, at[apart]]), np.sort(np.r_[at[apart], end])
    low, high = low[high - low > LONG], high[high - low > LONG]
    near = low[:, None] + np.arange(WINDOW, LONG)
    hashes = np.where((data[near] & 0xC0) != 0x80, stretch_hash(prefix, near - WINDOW, near), np.uint64(0))
    low = low + WINDOW + hashes.argmax(1)                      # the same place of the repeated bytes, wherever they begin
    times = (high - low - 1) // LONG + 1
    extra = np.repeat(low, times) + ramp(times) * LONG
    for _ in range(3):
        extra = extra - ((data[extra] & 0xC0) == 0x80)
    return np.r_[at[apart], extra]


def trees(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of every row: ``root|section(paragraph.leaf…,…);…`` in hex digits; where leaves have more than ``LEAF``
    digits, their number follows the root (``root:6|…``).

    Leaves are pieces of a paragraph of about ``PIECE_WORDS`` words, paragraphs are lines, sections are runs of about
    ``SECTION_PARAGRAPHS`` paragraphs. Pieces and sections end where the hash of their last word or paragraph says so, so an edit
    moves no boundary outside its own place; pieces over ``LONG`` bytes (no blanks, or words that end none) are cut inside by their bytes.
    The leaves of a tree are as wide as :func:`leaf_digits` says. Every inner node is the hash of its children, and the leaves cover
    every byte, so equal texts, and only they (up to hash collisions of 64 bits), have equal roots.
    """
    n = len(data)
    prefix = prefix_hash(data)
    line = data == 10
    rows = len(offsets) - 1
    stop = np.zeros(n + 1, bool)
    stop[offsets[1:]] = True
    stop[np.flatnonzero(line) + 1] = True                      # a paragraph ends after its line end
    paragraph_end = stop.copy()
    start, word_end, _ = words_of(data, offsets)
    last = stretch_hash(prefix, start, word_end)
    chosen = word_end[(last >> np.uint64(20)) % np.uint64(PIECE_WORDS) == 0]
    chosen = chosen[~paragraph_end[chosen]] + 1                # the blank after a word stays with it
    stop[chosen] = True
    stop[0] = False
    end = np.flatnonzero(stop)
    begin = np.r_[0, end[:-1]]
    long = end - begin > LONG
    stop[inner_cuts(data, prefix, begin[long], end[long])] = True
    end = np.flatnonzero(stop)
    leaf = stretch_hash(prefix, np.r_[0, end[:-1]], end)
    row_of = np.searchsorted(offsets, end, side="left") - 1
    closes = np.flatnonzero(paragraph_end[end])                # index of the last leaf of each paragraph
    first = np.r_[0, closes[:-1] + 1]
    position = np.arange(len(end)) - np.repeat(first, np.diff(np.r_[first, len(end)])) if len(end) else end
    weighted = mix(leaf + (position.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    paragraph = mix(np.add.reduceat(weighted, first)) if len(end) else leaf
    section_ends = (paragraph >> np.uint64(9)) % np.uint64(SECTION_PARAGRAPHS) == 0
    leaf_hex = leaf.astype(">u8").tobytes().hex()
    node_hex = (paragraph >> np.uint64(64 - 4 * DIGEST)).astype(">u4").tobytes().hex()
    paragraph_row = row_of[closes] if len(end) else row_of
    at = np.searchsorted(paragraph_row, np.arange(rows + 1))
    out = []
    for r in range(rows):
        a, b = int(at[r]), int(at[r + 1])
        width = leaf_digits(int(closes[b - 1] + 1 - first[a]) if b > a else 0)
        sections, current, hashes, ids = [], [], [], []
        for p in range(a, b):
            leaves = "".join(leaf_hex[16 * k:16 * k + width] for k in range(first[p], closes[p] + 1))
            current.append(node_hex[8 * p:8 * p + 8] + "." + leaves)
            ids.append(int(paragraph[p]))
            if section_ends[p] or p == b - 1:
                digest = hashlib.blake2b(np.array(ids, "<u8").tobytes(), digest_size=8).digest()
                sections.append(digest[:DIGEST // 2].hex() + "(" + ",".join(current) + ")")
                hashes.append(digest)
                current, ids = [], []
        out.append(hashlib.blake2b(b"".join(hashes), digest_size=8).hexdigest()
                   + (f":{width}|" if width > LEAF else "|") + ";".join(sections))
    return out


def leaf_width(fingerprint: str) -> int:
    return int(fingerprint.partition("|")[0].partition(":")[2] or LEAF)


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, sections), a section being (digest, paragraphs) and a paragraph (digest, leaves)."""
    root, _, body = fingerprint.partition("|")
    width = leaf_width(fingerprint)
    sections = []
    for part in body.split(";") if body else []:
        digest, _, inner = part.partition("(")
        paragraphs = []
        for p in inner[:-1].split(","):
            node, _, leaves = p.partition(".")
            paragraphs.append((node, [leaves[k:k + width] for k in range(0, len(leaves), width)]))
        sections.append((digest, paragraphs))
    return root, sections


def open_branches(a: str, b: str):
    """Branches in which two trees differ, after equal roots, sections and paragraphs have been matched (as multisets), and
    the number of leaves under what matched."""
    (root_a, left), (root_b, right) = parse(a), parse(b)
    leaves = sum(len(x) for _, ps in left for _, x in ps)
    if root_a == root_b:
        return [], [], leaves
    same = 0
    rest = []
    for mine, other in ((left, Counter(d for d, _ in right)), (right, Counter(d for d, _ in left))):
        out = []
        for k, (digest, paragraphs) in enumerate(mine):
            if other[digest] > 0:
                other[digest] -= 1
                same += sum(len(x) for _, x in paragraphs) if mine is left else 0
            else:
                out += [(k, j, node, x) for j, (node, x) in enumerate(paragraphs)]
        rest.append(out)
    opened = []
    for mine, other in ((rest[0], Counter(p[2] for p in rest[1])), (rest[1], Counter(p[2] for p in rest[0]))):
        out = []
        for p in mine:
            if other[p[2]] > 0:
                other[p[2]] -= 1
                same += len(p[3]) if mine is rest[0] else 0
            else:
                out.append(p)
        opened.append(out)
    return opened[0], opened[1], same


def likeness(a: str, b: str) -> float:
    """Shared leaves over all leaves of both trees (multisets), 1 for equal roots, 0 for nothing in common. Only differing
    branches are opened. Leaves of unequal width are compared at the smaller one. Two empty texts have likeness 1."""
    left, right, same = open_branches(a, b)
    if not left and not right and a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    width = min(leaf_width(a), leaf_width(b))
    x = Counter(leaf[:width] for *_, leaves in left for leaf in leaves)
    y = Counter(leaf[:width] for *_, leaves in right for leaf in leaves)
    common = same + sum((x & y).values())
    total = 2 * same + sum(x.values()) + sum(y.values())
    return common / (total - common) if total > common else float(total == 0)


def located_edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph in it) of the first tree for every paragraph that the second tree does not have."""
    return [(k, j) for k, j, *_ in open_branches(a, b)[0]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for every row; one scan, no shuffle. A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(trees(*flat_text(piece, "text")), pa.string())],
                                             names=["doc_id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fingerprint string")


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def ranged(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``range, lead, doc_id, text``: ``docs(doc_id, text)`` in ranges of ascending ids, each followed by a second copy of the first
    row of the next range (``lead`` true); the last range is followed by the very first row.

    Range bounds are ids taken by approximate quantiles, so a range holds about ``rows_per_range`` rows however ids are
    spread (more if there were over ``MAX_RANGES`` ranges; ranges are read as streams, so their size is no matter of memory).
    A bound is the smallest id of its range, which is all that is needed to know whose row goes to two ranges. Every text
    moves once. A null id counts as the smallest.
    """
    ids = cut_lineage(docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("i")))
    rows = ids.count()
    parts = min(max(1, -(-rows // rows_per_range)), MAX_RANGES)
    shares = [k / parts for k in range(1, parts)]
    low, cuts = ids.agg(F.min("i"), F.percentile_approx("i", shares or [0.5], max(10000, 20 * parts))).first()
    bounds = np.array(sorted({*(cuts or [])} - {low}) if shares else [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = pc.fill_null(batch.column(0), FIRST).to_numpy()
            part = np.searchsorted(bounds, i, side="right")
            again = np.flatnonzero((i == low) | among(i, bounds))
            rows = np.r_[np.arange(len(i)), again]
            lead = np.r_[np.zeros(len(i), bool), np.ones(len(again), bool)]
            part = np.r_[part, np.where(i[again] == low, len(bounds), part[again] - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(lead), *(
                c.take(pa.array(rows)) for c in batch.columns)], names=["range", "lead", "doc_id", "text"])

    return docs.mapInArrow(run, "range long, lead boolean, doc_id long, text string")


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited form, and their fingerprints: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_paragraphs`` (how many paragraphs the comparison of the trees locates as changed).

    The edited text has its last quarter of code points replaced by as many from the start of the next document by ascending id
    (after the last comes the first; a table of one row follows itself). Null texts are empty; texts under four code points
    are edited to themselves. Among rows that repeat an id the order is that of their texts. Other columns are ignored,
    an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ranged(source).repartition("range").sortWithinPartitions("range", "lead", "doc_id", "text")

    def compare(rows: list) -> pa.RecordBatch:
        texts = [t for *_, t in rows]
        prints = trees(*_flat(texts))
        edited = []
        for a, b in zip(texts, texts[1:]):
            k = len(a) // 4
            edited.append(a[:len(a) - k] + b[:k])
        edited_prints = trees(*_flat(edited))
        out = [[] for _ in range(8)]
        for i, text in enumerate(edited):
            part, lead, doc_id, _ = rows[i]
            if lead or rows[i + 1][0] != part:
                continue
            values = (doc_id, len(texts[i]), hashlib.sha256(text.encode("utf-8")).hexdigest(), prints[i], edited_prints[i],
                      likeness(prints[i], edited_prints[i]), likeness(prints[i], prints[i + 1]),
                      len(located_edits(prints[i], edited_prints[i])))
            for column, v in zip(out, values):
                column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for piece in pieces(batches, "text"):
            for row in zip(*(c.to_pylist() for c in piece.columns)):
                rows.append(row)
                size += len(row[3])
            if size >= CHUNK_BYTES:
                yield compare(rows)
                rows, size = rows[-1:], len(rows[-1][3])
        if len(rows) > 1:
            yield compare(rows)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, edited_paragraphs long")
    return ordered.mapInArrow(run, schema)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
         "edited_paragraphs"]


@query()
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edits(table(spark, folder, "documents"))
