"""Document quality by co-training of a text-content and a page-metadata classifier.

The features of all rows are written once. In every round each classifier labels the rows of the pool it is surest of, in Spark, and
the other is trained on them where they lie: every partition fits on the labelled sample and its own pseudo-labelled rows, and the
parameters are averaged by the number of those rows. What reaches the driver is the bounded labelled sample, counts by confidence
and averaged parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.flat import flat_text, mix, pieces, prefix_hash, stretch_hash, words_of
from shotweave.llm.registry import query, table
from shotweave.llm.scratch import Scratch
from shotweave.session import cut_lineage

LABELLED_SAMPLE = 5000
WORD_BUCKETS = 512
CATEGORY_BUCKETS = 16
ROUNDS = 4
SHARE_PER_ROUND = 0.05
CONFIDENT = 0.9
BINS, REACH = 4000, 40.0


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed words and word endings of every text, square roots of counts at length one."""
    start, end, rows = words_of(data, offsets)
    prefix = prefix_hash(data)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    out = np.zeros(n * WORD_BUCKETS)
    for begin, seed in ((start, 0), (np.maximum(start, end - 2), 1)):
        bucket = (mix(stretch_hash(prefix, begin, end) + np.uint64(seed)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        out += np.bincount(row * WORD_BUCKETS + bucket, minlength=len(out))
    out = np.sqrt(out.reshape(n, WORD_BUCKETS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def metadata_view(data: np.ndarray, offsets: np.ndarray, lang: list, source: list) -> np.ndarray:
    """What a page tells without its words: language, source, size and layout."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    start, end, rows = words_of(data, offsets)
    words = np.diff(rows).astype(float)
    h = stretch_hash(prefix_hash(data), start, end)
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((h, row))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=n)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(upper | digit | lower | blank | (data >= 128))
    lines = share(data == 10) * size + 1
    numbers = np.stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(size / lines), size / np.maximum(words, 1) / 10,
        distinct / np.maximum(words, 1), 3 * share(upper), 3 * share(digit), 3 * share(mark), 3 * share(blank),
        10 * share(data == 124), 10 * share(data == 33),
    ], 1)
    kinds = np.zeros((n, 2 * CATEGORY_BUCKETS))
    for k, values in enumerate((lang, source)):
        raw = [str(v or "").encode() for v in values]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        cuts = np.cumsum([0, *map(len, raw)])
        bucket = (stretch_hash(prefix_hash(flat), cuts[:-1], cuts[1:]) % np.uint64(CATEGORY_BUCKETS)).astype(np.int64)
        kinds[np.arange(n), k * CATEGORY_BUCKETS + bucket] = 1
    return np.concatenate([numbers, kinds], 1)


@dataclass
class Logistic:
    """Logistic regression with standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150, like: Logistic | None = None) -> Logistic:
        """``like`` lends its standardisation, so that parameters of several fits can be averaged."""
        mean, scale, y = (x.mean(0), x.std(0) + 1e-3, y) if like is None else (like.mean, like.scale, y)
        y = y.astype(np.float32)
        z = ((x - mean) / scale).astype(np.float32)
        weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
        weight = weight.astype(np.float32)
        w, v, b, vb = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
        rate = float(4.0 / (1 + (z * z).sum(1).mean()))
        for _ in range(steps):
            g = weight * (1 / (1 + np.exp(-(z @ w + np.float32(b)))) - y)
            v = 0.9 * v - rate * (z.T @ g + penalty * w)
            vb = 0.9 * vb - rate * float(g.sum())
            w, b = w + v, b + vb
        return cls(mean, scale, w, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class CoTrained:
    """Both views' classifiers and the calibrated combination of their log odds."""

    content: Logistic
    metadata: Logistic
    combine: Logistic

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sigmoid(self.combine.logit(np.stack([self.content.logit(a), self.metadata.logit(b)], 1).clip(-12, 12)))


@dataclass
class Cut:
    """Which pool rows a view labels: those beyond a confidence bin, and a share of that bin's own rows."""

    bin: int
    share: float

    def picks(self, bins: np.ndarray, dice: np.ndarray) -> np.ndarray:
        return (bins > self.bin) | ((bins == self.bin) & (dice < self.share))


def bins_of(logit: np.ndarray) -> np.ndarray:
    """Confidence bin of log odds; the other class's is ``BINS - 1`` minus it."""
    return np.clip(((logit + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def cut_of(counts: np.ndarray, limit: float, confident: float) -> Cut:
    """The surest rows, ``limit`` of them on average, none under ``confident``."""
    least = int(bins_of(np.array([np.log(confident / (1 - confident))]))[0]) + 1
    beyond = np.r_[np.cumsum(counts[::-1])[::-1], 0]        # rows in this bin or a surer one
    full = int(np.argmax(beyond <= limit))                  # from here on every row is taken
    if full <= least:
        return Cut(least - 1, 0.0)
    left = limit - beyond[full]
    return Cut(full - 1, min(1.0, left / max(1, counts[full - 1])))


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(batch.column("a").to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float32)
    return a, np.frombuffer(b"".join(batch.column("b").to_pylist()), np.float32).reshape(batch.num_rows, -1)


def confidence_counts(features: DataFrame, models: list[Logistic]) -> np.ndarray:
    """Pool rows by view and confidence bin, summed over tasks."""
    shared = features.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for k, x in enumerate(matrices(batch)):
                counts[k] += np.bincount(bins_of(shared.value[k].logit(x)), minlength=BINS)
        view, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (view, place, counts[view, place])], names=["view", "bin", "n"])

    out = np.zeros((2, BINS), np.int64)
    for r in features.filter("y < 0").mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["view"], r["bin"]] = r["n"]
    return out


def trained_where_they_lie(features: DataFrame, models: list[Logistic], cuts: list[tuple[Cut, Cut]],
                           base: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[Logistic]:
    """Each view trained on the labelled rows ``base`` and the rows the other view labels; a view that gets none stays as it is."""
    shared = features.sparkSession.sparkContext.broadcast((models, cuts, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, cuts, base = shared.value
        given = [[], []]
        for batch in batches:
            views, dice = matrices(batch), batch.column("dice").to_numpy()
            for k in (0, 1):
                bins = bins_of(models[k].logit(views[k]))
                good, bad = cuts[k][0].picks(bins, dice), cuts[k][1].picks(BINS - 1 - bins, dice)
                sure = good | bad
                given[1 - k].append((views[1 - k][sure], good[sure].astype(float)))
        rows = []
        for k in (0, 1):
            x, y = (np.concatenate(c) for c in zip(*given[k])) if given[k] else (np.zeros((0, 1)), np.zeros(0))
            if len(y):
                model = Logistic.fit(np.concatenate([base[k], x]), np.r_[base[2], y].astype(float), like=models[k])
                rows += [(k, j, v * len(y), len(y)) for j, v in enumerate([*model.w.tolist(), float(model.b)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["view", "at", "total", "n"])

    sums = features.filter("y < 0").mapInArrow(run, "view long, at long, total double, n long").groupBy("view", "at").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = []
    for k, old in enumerate(models):
        mine = {r["at"]: r["total"] / r["n"] for r in sums if r["view"] == k}
        values = np.array([mine[j] for j in range(len(mine))], np.float32)
        out.append(Logistic(old.mean, old.scale, values[:-1], float(values[-1])) if mine else old)
    return out


def co_train(features: DataFrame, a: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, share: float = SHARE_PER_ROUND,
             confident: float = CONFIDENT) -> CoTrained:
    """Train on the labelled rows ``a, b, y`` and on the pool, the rows of ``features(doc_id, y, a, b, dice)`` whose ``y`` is -1.

    In round r either classifier labels, for each class, the ``r * share`` of the pool it is surest of, none under ``confident``, and
    the other is trained on these rows; labels are given anew in every round. Without a pool, or without sure rows, the two
    classifiers are those of the labelled rows. A fifth of the labelled rows is kept out of all rounds to calibrate: a
    logistic regression on both log odds.
    """
    hold = np.zeros(len(y), bool)
    hold[::5] = len(y) >= 20
    views, known = (a, b), ~hold
    base = a[known], b[known].astype(np.float32), y[known].astype(float)
    models = [Logistic.fit(views[k][known], base[2]) for k in (0, 1)]
    for r in range(1, rounds + 1):
        counts = confidence_counts(features, models)
        limit = r * share * counts[0].sum()
        cuts = [(cut_of(counts[k], limit, confident), cut_of(counts[k][::-1], limit, confident)) for k in (0, 1)]
        if not limit:
            break
        models = trained_where_they_lie(features, models, cuts, base)
    rows = np.flatnonzero(hold) if hold.any() else np.arange(len(y))
    z = np.stack([models[k].logit(views[k][rows]) for k in (0, 1)], 1).clip(-12, 12)
    return CoTrained(*models, Logistic.fit(z, y[rows].astype(float), 1e-2))


def views_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_text(piece, "text")
    lang, source = (piece.column(piece.schema.get_field_index(c)).to_pylist() for c in ("lang", "source"))
    return content_view(data, offsets), metadata_view(data, offsets, lang, source)


def labelled_ids(labels: DataFrame, label_col: str, train: Column, n: int) -> DataFrame:
    """``_id, y`` of at most ``n`` labelled ids, chosen by a hash; an id with labels of both classes is not labelled."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).filter(train).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(
        F.min((F.col(label_col) == 1).cast("int")).alias("y"), F.max((F.col(label_col) == 1).cast("int")).alias("_most"))
    return known.filter("y = _most").select("_id", "y").orderBy(F.xxhash64("_id"), "_id").limit(n)


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality",
                labelled: int = LABELLED_SAMPLE) -> CoTrained | None:
    """Co-train on at most ``labelled`` labelled rows (chosen by a hash of the id among those where ``train`` holds) and on all other
    rows of ``docs`` as the pool; labels beyond the sample are not used, their rows are in the pool.

    The labelled ids are few enough to broadcast, so no text shuffles. Of rows repeating a labelled id one is trained on, all are out of
    the pool. None without labels of both classes.
    """
    ids = cut_lineage(labelled_ids(labels, label_col, train, labelled))
    if ids.agg(F.count_distinct("y")).first()[0] < 2:
        return None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    marked = source.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left").withColumn("y", F.coalesce("y", F.lit(-1))).drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            a, b = views_of(piece)
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(piece.schema.get_field_index("y")),
                pa.array([r.tobytes() for r in a.astype(np.float16)], pa.binary()),
                pa.array([r.tobytes() for r in b.astype(np.float32)], pa.binary())], names=["doc_id", "y", "a", "b"])

    scratch = Scratch(docs.sparkSession)
    dice = F.pmod(F.xxhash64("doc_id", "a"), F.lit(1 << 20)).cast("double") / F.lit(float(1 << 20))
    features = scratch.write(marked.mapInArrow(run, "doc_id long, y int, a binary, b binary").withColumn("dice", dice))
    rows = features.filter("y >= 0").groupBy("doc_id").agg(F.min(F.struct("y", "a", "b")).alias("r")).select("doc_id", "r.*")
    rows = rows.toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy()
    if not ((y == 1).any() and (y == 0).any()):
        return None
    a = np.frombuffer(b"".join(rows["a"]), np.float16).reshape(len(rows), -1).astype(np.float32)
    b = np.frombuffer(b"".join(rows["b"]), np.float32).reshape(len(rows), -1)
    model = co_train(features, a, b, y)
    scratch.drop(features)
    return model


def score_quality(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher is better) for every row, in one scan. Null texts, languages and sources count as empty; an
    empty text is scored like any other; repeated rows repeat; other columns are ignored; without a model every score is 0.5."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            scores = np.full(piece.num_rows, 0.5) if model is None else model.score(*views_of(piece))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores)], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return source.mapInArrow(run, "doc_id long, score double")


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = fit_quality(docs, table(spark, folder, "labels"), train)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (~train).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
