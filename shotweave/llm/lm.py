"""Log-bilinear language model trained with noise-contrastive estimation, and the unigram score beside it.

Words are a vocabulary of any size; the neural model works on ``SYMBOLS`` symbols: the end of a text, the most frequent words, and
classes of all other words by their last two bytes. The probability of a word is that of its symbol after the two symbols before it,
times its share of the symbol's count mass (with one place for unseen words), so probabilities add up to one over all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.dedup_near import segment_reduce
from shotweave.llm.flat import flat_text, lower_ascii, mix, pieces, prefix_hash, stretch_hash, words_of
from shotweave.llm.registry import query, table
from shotweave.llm.scratch import Scratch

SYMBOLS = 256
FREQUENT = 127
CLASSES = SYMBOLS - FREQUENT - 1
END = 0
HEAD_SHARE = 1 << 20
DIM = 32
NOISE = 8
BATCH = 2048
EPOCHS = 3
ROWS_PER_PART = 400_000
RATE = 0.15


def words(data: np.ndarray, offsets: np.ndarray):
    """Per word: 64-bit hash, class and row; per row the index of its first word."""
    data = lower_ascii(data)
    start, end, rows = words_of(data, offsets)
    tail = np.where(end - start > 1, data[np.maximum(end - 2, 0)] if len(data) else 0, 0).astype(np.uint64)
    last = data[end - 1].astype(np.uint64) if len(end) else tail
    group = (mix(tail << np.uint64(8) | last) % np.uint64(CLASSES)).astype(np.int64) + FREQUENT + 1
    hashes = stretch_hash(prefix_hash(data), start, end).view(np.int64)
    return hashes, group, np.repeat(np.arange(len(offsets) - 1), np.diff(rows)), rows


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, class, c`` over ``docs(doc_id, text)``: counted per piece of text, then per task, then shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            h, group, _, _ = words(*flat_text(piece, "text"))
            values, first, counts = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(group[first].astype(np.int32)), pa.array(counts)],
                                             names=["h", "class", "c"])

    return docs.mapInArrow(run, "h long, class int, c long").groupBy("h").agg(
        F.min("class").alias("class"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Totals, and the words with at least ``N / HEAD_SHARE`` occurrences: by arithmetic at most ``HEAD_SHARE`` of them, which bounds
    what is broadcast. ``symbol`` of a head word is its own or its class; ``mass`` is the count mass of every class."""

    tokens: int
    types: int
    ends: int
    h: np.ndarray
    c: np.ndarray
    symbol: np.ndarray
    mass: np.ndarray

    def look_up(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1 for words outside the head) and symbol of every word."""
        if not len(self.h):
            return np.full(len(h), -1), group
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.c[at], -1), np.where(hit, self.symbol[at], group)


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    total, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens = (total or 0) + ends
    head = counts.filter(F.col("c") * HEAD_SHARE >= tokens).toPandas().sort_values("h")
    top = head.sort_values(["c", "h"], ascending=[False, True]).head(FREQUENT)
    symbol = head["class"].to_numpy(np.int64).copy()
    symbol[np.searchsorted(head["h"].to_numpy(), top["h"].to_numpy())] = np.arange(1, len(top) + 1)
    mass = np.ones(SYMBOLS)
    for r in counts.groupBy("class").agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["class"]] += r["m"]
    np.subtract.at(mass, top["class"].to_numpy(np.int64), top["c"].to_numpy() + 1)
    mass[1:len(top) + 1] = top["c"].to_numpy() + 1
    mass[END] = ends + 1
    return Lexicon(tokens, types + (1 if ends else 0), ends, head["h"].to_numpy(), head["c"].to_numpy(), symbol, mass)


def contexts(symbol: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target and context code (one before, two before) of every token, with an end token after each row; a row begins as after
    an end."""
    n_rows = len(rows) - 1
    target = np.insert(symbol, rows[1:], END)
    first = rows[:-1] + np.arange(n_rows)
    one = np.r_[END, target[:-1]]
    two = np.r_[END, END, target[:-2]][:len(target)]
    one[first] = two[first] = END
    second = (first + 1)[first + 1 < len(target)]
    two[second] = END
    return target, one * SYMBOLS + two


def trigram_counts(docs: DataFrame, lex) -> DataFrame:
    """``code, c``: how often each symbol follows each pair of symbols in ``docs(doc_id, text)``; at most ``SYMBOLS``³ rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lex.value
        for piece in pieces(batches, "text"):
            h, group, _, rows = words(*flat_text(piece, "text"))
            target, context = contexts(known.look_up(h, group)[1], rows)
            codes, counts = np.unique(context * SYMBOLS + target, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "c"])

    return docs.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


@dataclass
class LogBilinear:
    """``score(s | u, v) = (one * R[u] + two * R[v]) . Q[s] + b[s]``; ``R``, ``Q`` are ``SYMBOLS`` by ``DIM``, ``one`` and ``two``
    weigh the dimensions of either place."""

    r: np.ndarray
    q: np.ndarray
    one: np.ndarray
    two: np.ndarray
    b: np.ndarray
    noise: np.ndarray = field(default=None)

    @classmethod
    def start(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(11)
        p = (unigram + 1) / (unigram + 1).sum()
        small = lambda: rng.normal(0, 0.1, (SYMBOLS, DIM))
        return cls(small(), small(), np.ones(DIM), np.full(DIM, 0.5), np.log(p), p)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.one, self.two, self.b]

    def copy_with(self, params: list[np.ndarray]) -> LogBilinear:
        return LogBilinear(*params, self.noise)

    def table(self) -> np.ndarray:
        """Natural log probabilities, normalised: one row per context code, one column per symbol, by batched matrix products."""
        out = np.empty((SYMBOLS * SYMBOLS, SYMBOLS), np.float32)
        for u in range(SYMBOLS):
            x = self.one * self.r[u] + self.two * self.r
            s = (x @ self.q.T + self.b).astype(np.float32)
            top = s.max(1, keepdims=True)
            out[u * SYMBOLS:(u + 1) * SYMBOLS] = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        return out

    def train(self, codes: np.ndarray, counts: np.ndarray, least: int, seed: int) -> None:
        """Noise-contrastive estimation by Adagrad in whole passes over all rows, as many as show ``least`` rows, at least one.

        In every pass a row weighs its count: rows above the mean count are shown several times with equal parts of it (so no single
        step is ruled by one row), all others once. That makes fewer than twice as many steps as rows."""
        rng = np.random.default_rng(seed)
        times = np.ceil(counts / counts.mean()).astype(np.int64)
        shown = np.repeat(np.arange(len(codes)), times)
        weights = counts / counts.mean() / times
        noise_ends = np.cumsum(self.noise)
        log_kq = np.log(NOISE * self.noise)
        squares = [np.full(p.shape, 1e-2) for p in self.parameters()]
        for at in (part for _ in range(max(1, -(-least // len(shown))))
                   for part in np.array_split(rng.permutation(shown), -(-len(shown) // BATCH))):
            code, size = codes[at], len(at)
            s, context = code % SYMBOLS, code // SYMBOLS
            u, v = context // SYMBOLS, context % SYMBOLS
            x = self.one * self.r[u] + self.two * self.r[v]
            noise = np.searchsorted(noise_ends, rng.random((size, NOISE)), side="right").clip(max=SYMBOLS - 1)
            tried = np.concatenate([s[:, None], noise], 1)
            q = self.q[tried]
            score = np.einsum("bd,bkd->bk", x, q) + self.b[tried] - log_kq[tried]
            g = 1 / (1 + np.exp(-score.clip(-30, 30)))
            g[:, 0] -= 1
            g *= weights[at, None] / size
            gx = np.einsum("bk,bkd->bd", g, q)
            grads = [np.zeros_like(self.r), np.zeros_like(self.q), (gx * self.r[u]).sum(0), (gx * self.r[v]).sum(0),
                     np.bincount(tried.ravel(), g.ravel(), SYMBOLS)]
            one_hot = np.zeros((SYMBOLS, size))
            one_hot[u, np.arange(size)] = 1
            grads[0] = one_hot @ (gx * self.one)
            one_hot[u, np.arange(size)] = 0
            one_hot[v, np.arange(size)] = 1
            grads[0] += one_hot @ (gx * self.two)
            weight = np.zeros((SYMBOLS, size))
            np.add.at(weight, (tried.ravel(), np.repeat(np.arange(size), NOISE + 1)), g.ravel())
            grads[1] = weight @ x
            for p, grad, square in zip(self.parameters(), grads, squares):
                square += grad * grad
                p -= RATE * grad / np.sqrt(square)


def fit(trigrams: DataFrame, epochs: int = EPOCHS) -> LogBilinear:
    """Train on every row of the count table (at most ``SYMBOLS``³ rows, whatever the corpus): in every epoch each partition improves
    its own copy of the parameters in whole passes over its rows, weighted by their counts, and the copies are averaged by the mass
    they have seen. A larger table has more partitions, of about ``ROWS_PER_PART`` rows. A copy is about 140 kB; one per partition
    comes back."""
    unigram, rows = np.zeros(SYMBOLS), 0
    for r in trigrams.groupBy((F.col("code") % SYMBOLS).alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        unigram[r["s"]] = r["c"]
        rows += r["n"]
    model = LogBilinear.start(unigram)
    trigrams = trigrams.repartition(max(1, -(-rows // ROWS_PER_PART)), "code")
    for epoch in range(epochs):
        params, noise = model.parameters(), model.noise

        def run(batches: Iterator[pa.RecordBatch], params=params, noise=noise, epoch=epoch) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            codes = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in parts)])
            if not len(codes):
                return
            counts = np.concatenate([c for _, c in parts])
            own = LogBilinear(*(p.copy() for p in params), noise)
            own.train(codes, counts, 20 * BATCH, 100 * epoch + int(codes[0] % 97))
            raw = np.concatenate([p.ravel() for p in own.parameters()]).astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([float(counts.sum())]), pa.array([raw], pa.binary())], names=["mass", "raw"])

        got = trigrams.mapInArrow(run, "mass double, raw binary").collect()
        if not got:
            break
        total = sum(r["mass"] for r in got)
        mean = sum(np.frombuffer(r["raw"], "<f8") * (r["mass"] / total) for r in got)
        cuts = np.cumsum([p.size for p in params])[:-1]
        model = model.copy_with([x.reshape(p.shape) for x, p in zip(np.split(mean, cuts), params)])
    return model


_tables: dict[int, np.ndarray] = {}


def model_table(model: LogBilinear) -> np.ndarray:
    key = hash((model.q.tobytes(), model.r.tobytes()))
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.table()
    return _tables[key]


def partial_scores(docs: DataFrame, lex, model) -> DataFrame:
    """Per row what the head gives, and the words beyond it: ``doc_id, n_tokens, known, counts, neural, tail_h, tail_n``. ``counts`` is
    the sum of log10(c + 1) over head words and the end, ``neural`` the rest of the model's score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = lex.value, model_table(model.value)
        log_mass = np.log10(known.mass)
        for piece in pieces(batches, "text"):
            h, group, row, rows = words(*flat_text(piece, "text"))
            c, symbol = known.look_up(h, group)
            target, context = contexts(symbol, rows)
            ends = rows + np.arange(len(rows))
            neural = segment_reduce(np.add, logs[context, target] / np.log(10) - log_mass[target], ends)
            tail = c < 0
            head = segment_reduce(np.add, np.where(tail, 0.0, np.log10(np.maximum(c, 0) + 1.0)), rows)
            seen = segment_reduce(np.add, (c > 0).astype(np.int64), rows)
            pairs_row, pairs_h = row[tail], h[tail]
            order = np.lexsort((pairs_h, pairs_row))
            pairs_row, pairs_h = pairs_row[order], pairs_h[order]
            new = np.ones(len(order), bool)
            new[1:] = (pairs_row[1:] != pairs_row[:-1]) | (pairs_h[1:] != pairs_h[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.r_[first, len(order)])
            cuts = pa.array(np.searchsorted(pairs_row[first], np.arange(len(rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array(np.diff(ends)), pa.array(seen + (known.ends > 0)),
                pa.array(head + np.log10(known.ends + 1.0)), pa.array(neural),
                pa.ListArray.from_arrays(cuts, pa.array(pairs_h[first])),
                pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
            ], names=["doc_id", "n_tokens", "known", "counts", "neural", "tail_h", "tail_n"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, known long, counts double, neural double, tail_h array<long>, "
                                "tail_n array<int>")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row, learning from the rows where ``train`` holds.

    Words are runs without blanks, A-Z in lower case, then one end token. ``base_score`` is the unigram score with one added;
    ``score`` the model's log10 probability. Null and empty texts are their end token. Rows repeating an id count each and get the
    rare-word sums of all of them (ids are expected to be unique). Other columns are ignored; an empty table gives an empty result;
    without training rows all words are unseen.

    Word counts cover all training rows. Frequent words are looked up in a broadcast of bounded size; only the rest (by mass a
    small part) is shuffled to its counts, one row per document and word.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), train.alias("_train"))
    learn = source.filter("_train").select("doc_id", "text")
    source = source.select("doc_id", "text")
    counts = scratch.write(word_counts(learn))
    context = docs.sparkSession.sparkContext
    lex = context.broadcast(lexicon(counts, learn.count()))
    trigrams = scratch.write(trigram_counts(learn, lex))
    model = context.broadcast(fit(trigrams))
    partial = scratch.write(partial_scores(source, lex, model))
    scratch.drop(trigrams)
    tail = partial.select("doc_id", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("doc_id", "t.tail_h", "t.tail_n")
    rare = counts.filter(F.col("c") * HEAD_SHARE < lex.value.tokens).select(F.col("h").alias("tail_h"), "c")
    found = tail.join(rare, "tail_h").groupBy("doc_id").agg(
        F.sum(F.col("tail_n") * F.log10(F.col("c") + 1)).alias("rare_counts"), F.sum("tail_n").alias("rare_known"))
    norm = float(np.log10(lex.value.tokens + lex.value.types + 1))
    zero = F.lit(0.0)
    return partial.drop("tail_h", "tail_n").join(found, "doc_id", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.value.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + F.coalesce("rare_counts", zero) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("counts") + F.coalesce("rare_counts", zero) + F.col("neural")).alias("score"))


@query()
def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scores = score_texts(table(spark, folder, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
