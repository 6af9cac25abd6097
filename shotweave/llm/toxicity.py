"""Toxicity by a weighted finite-state grammar over clauses, with an insult lexicon learned from labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.flat import flat_text, lower_ascii, pieces, prefix_hash, stretch_hash
from shotweave.llm.registry import query, table
from shotweave.session import cut_lineage

TOXIC_SAMPLE = 4000
CLEAN_SAMPLE = 16000
STEMS = (4, 5, 6)
STEM_TAG = np.uint64(0x5354454D5354454D)
TWICE_TAG = np.uint64(0x5457494345545749)
MIN_SUPPORT = 3
MIN_PRECISION = 0.9
MAX_LEXICON = 500
NEGATION_REACH = 3
TARGET_REACH = 5
REPORT_REACH = 12

# Small closed word classes of the grammar (English, French, German, Spanish).
TARGETS = "you your u he she they them him her this that is are tu vous toi ton du dich dir ihr sie usted ustedes eres es".split()
NEGATIONS = "not never no isn aren cannot without nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says wrote called quoted reported claimed according dit écrit selon sagte schrieb laut dijo escribió según".split()
THREATS = "kill murder destroy hurt shoot stab beat tuer töten matar".split()
OTHER, INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, END = range(8)
MARKS = ("plain", "targeted", "negated", "reported", "threat", "weak")


class Machine:
    """A transducer over word classes: ``step(state, symbol)`` gives the next state and the mark put on this word, or none."""

    start = 0

    def step(self, state, symbol):
        raise NotImplementedError


class Reach(Machine):
    """Marks hits within ``reach`` words after a trigger; a clause end resets it."""

    def __init__(self, trigger: int, reach: int, mark: str):
        self.trigger, self.reach, self.mark = trigger, reach, mark

    def step(self, state, symbol):
        if symbol == END:
            return 0, None
        if symbol == self.trigger:
            return self.reach, None
        return max(state - 1, 0), self.mark if state and symbol in (INSULT, WEAK, THREAT) else None


class Always(Machine):
    """Marks every hit of one class."""

    def __init__(self, symbol: int, mark: str):
        self.symbol, self.mark = symbol, mark

    def step(self, state, symbol):
        return 0, self.mark if symbol == self.symbol else None


def compose(*machines: Machine) -> list[list[tuple[int, frozenset]]]:
    """The product of transducers as one table: ``table[state][symbol]`` is the next state and the set of marks."""
    number = {tuple(m.start for m in machines): 0}
    todo, table_ = list(number), []
    while todo:
        states = todo.pop(0)
        row = []
        for symbol in range(END + 1):
            steps = [m.step(s, symbol) for m, s in zip(machines, states)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append((number[nxt], frozenset(mark for _, mark in steps if mark)))
        table_.append(row)
    return table_


GRAMMAR = compose(Always(INSULT, "insult"), Always(WEAK, "weak"), Always(THREAT, "threat"), Reach(TARGET, TARGET_REACH, "targeted"),
                  Reach(NEGATION, NEGATION_REACH, "negated"), Reach(REPORT, REPORT_REACH, "reported"))


def clause_marks(symbols: np.ndarray) -> np.ndarray:
    """Hits of one text by mark, each hit under its strongest reading: reported, then negated, then targeted, then plain.
    A threat counts only with a target in reach, a weak word (harmless when it comes once) from its second time on."""
    out = np.zeros(len(MARKS))
    state = 0
    for symbol in symbols.tolist():
        state, marks = GRAMMAR[state][symbol]
        if not marks:
            continue
        if "reported" in marks:
            out[3] += 1
        elif "negated" in marks:
            out[2] += 1
        elif "threat" in marks:
            out[4] += "targeted" in marks
        elif "weak" in marks:
            out[5] += 1
        else:
            out[1 if "targeted" in marks else 0] += 1
    out[5] = max(out[5] - 1, 0)
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Start and end of runs of letters (every byte of a non-ASCII character counts), and per row its first run."""
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    pad = np.zeros(len(data) + 2, bool)
    pad[1:-1] = letter
    first, last = letter & ~pad[:-2], letter & ~pad[2:]
    full = np.diff(offsets) > 0
    first[offsets[:-1][full]] = letter[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = letter[offsets[1:][full] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hash of every word and of its stems; 0 where a word is shorter than the stem."""
    prefix = prefix_hash(data)
    out = [stretch_hash(prefix, start, end)]
    for n in STEMS:
        stop = np.minimum(start + n, end)
        out.append(np.where(end - start >= n, stretch_hash(prefix, start, stop) ^ STEM_TAG, 0).astype(np.uint64))
    return out


def hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode("utf-8"), np.uint8)
        out.append(stretch_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])
    return np.sort(np.array(out, np.uint64))


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


@dataclass
class Model:
    """Lexicon (hashes of words and stems, with their spelling) and the weights of the marks."""

    lexicon: np.ndarray
    spelled: list[str]
    weights: np.ndarray
    bias: float

    def score(self, marks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(marks) @ self.weights + self.bias)))


def batch_marks(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Marks per row. Rows without a lexicon word or threat cost only the vectorised look-up."""
    raw = data
    data = lower_ascii(data)
    start, end, rows = letter_words(data, offsets)
    out = np.zeros((len(offsets) - 1, len(MARKS)))
    if not len(start):
        return out
    words, *stems = word_features(data, start, end)
    insult, weak = among(words, lexicon), among(words ^ TWICE_TAG, lexicon)
    for s in stems:
        insult |= among(s, lexicon) & (s != 0)
        weak |= among(s ^ TWICE_TAG, lexicon) & (s != 0)
    threat = among(words, hash_words(THREATS))
    hit = np.flatnonzero(insult | weak | threat)
    if not len(hit):
        return out
    symbol = np.zeros(len(start), np.int64)
    for names, code in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
        symbol[among(words, hash_words(names))] = code
    symbol[threat] = THREAT
    symbol[weak] = WEAK
    symbol[insult] = INSULT
    stops = np.isin(raw, np.frombuffer(b".!?;\n", np.uint8))
    stop_count = np.r_[0, np.cumsum(stops)]
    for r in np.unique(np.searchsorted(rows, hit, side="right") - 1).tolist():
        a, b = rows[r], rows[r + 1]
        seq = symbol[a:b]
        ends = stop_count[start[a:b]]
        breaks = np.flatnonzero(np.diff(ends) > 0) + 1
        out[r] = clause_marks(np.insert(seq, breaks, END))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label_col: str, toxic_rows: int,
                    clean_rows: int) -> DataFrame:
    """``text, y`` of at most so many labelled training rows of each class, chosen by a hash of the id. The chosen ids are few
    enough to broadcast by construction, so no text shuffles."""
    wanted = labels.filter(train & F.col(label_col).isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), (F.col(label_col) == 1).cast("int").alias("y"))
    parts = [wanted.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
             for y, n in ((1, toxic_rows), (0, clean_rows))]
    ids = cut_lineage(parts[0].unionByName(parts[1])).dropDuplicates(["_id"])
    return cut_lineage(docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"]).select("_id", "text", "y"))


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Words and word stems that cover the toxic texts of a bounded sample, chosen greedily.

    Each feature is counted over distinct texts of both classes; those with enough support and precision are candidates. The cover
    takes the candidate with most toxic texts not yet covered, again and again, so words that merely share copies of a toxic text
    with an insult are never taken.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = flat_text(piece, "text")
            data = lower_ascii(data)
            start, end, rows = letter_words(data, offsets)
            if not len(start):
                continue
            y = piece.column(piece.schema.get_field_index("y")).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
            feats = word_features(data, start, end)
            values = np.concatenate(feats)
            docs_ = np.tile(doc, len(feats))
            where = np.tile(np.arange(len(start)), len(feats))
            kind = np.repeat(np.arange(len(feats)), len(start))
            ok = values != 0
            values, docs_, where, kind = values[ok], docs_[ok], where[ok], kind[ok]
            order = np.lexsort((docs_, values))
            values, docs_, where, kind = values[order], docs_[order], where[order], kind[order]
            new = np.r_[True, (values[1:] != values[:-1]) | (docs_[1:] != docs_[:-1])]
            again = np.diff(np.r_[np.flatnonzero(new), len(new)]) > 1
            values, docs_, where, kind = values[new], docs_[new], where[new], kind[new]
            values = np.r_[values, values[again] ^ TWICE_TAG]
            docs_, where, kind = np.r_[docs_, docs_[again]], np.r_[where, where[again]], np.r_[kind, kind[again] + len(feats)]
            order = np.argsort(values, kind="stable")
            values, docs_, where, kind = values[order], docs_[order], where[order], kind[order]
            head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            ones = np.add.reduceat(y[docs_], head)
            total = np.diff(np.r_[head, len(values)])
            raw = data.tobytes()
            text = []
            for w, k in zip(where[head].tolist(), kind[head].tolist()):
                a, b = int(start[w]), int(end[w])
                twice, k = divmod(k, len(feats))
                name = raw[a:b] if k == 0 else raw[a:a + STEMS[k - 1]] + b"*"
                text.append(name.decode("utf-8", "replace") + " (twice)" * twice)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[head].view(np.int64)), pa.array(text), pa.array(ones), pa.array(total - ones)],
                names=["f", "word", "c1", "c0"])

    distinct = sample.dropDuplicates(["text", "y"])
    counts = distinct.mapInArrow(count, "f long, word string, c1 long, c0 long").groupBy("f").agg(
        F.min("word").alias("word"), F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    good = counts.filter((F.col("c1") >= MIN_SUPPORT) & (F.col("c1") >= MIN_PRECISION * (F.col("c1") + F.col("c0") + 0.3)))
    chosen = good.collect()                       # bounded by the sample: its toxic texts hold no more features
    if not chosen:
        return np.zeros(0, np.uint64), []
    values = np.sort(np.array([r["f"] for r in chosen], np.int64).view(np.uint64))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, offsets = flat_text(piece, "text")
            data = lower_ascii(data)
            start, end, rows = letter_words(data, offsets)
            ids = piece.column(piece.schema.get_field_index("_id")).to_numpy()
            doc = np.repeat(ids, np.diff(rows))
            for feature in word_features(data, start, end) if len(start) else []:
                for tag in (np.uint64(0), TWICE_TAG):
                    hit = among(feature ^ tag, values) & (feature != 0)
                    pairs, times = np.unique(np.stack([doc[hit], (feature[hit] ^ tag).view(np.int64)], 1), axis=0,
                                             return_counts=True)
                    pairs = pairs[times > (tag != 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["_id", "f"])

    pairs = distinct.filter("y = 1").mapInArrow(incidence, "_id long, f long").toPandas().drop_duplicates()
    spelled = {r["f"]: r["word"] for r in chosen}
    pairs["stem"] = pairs["f"].map(lambda f: len(spelled[f]) - 50 * ("twice" in spelled[f]) if "*" in spelled[f] else 99)
    out = []
    while len(pairs) and len(out) < MAX_LEXICON:
        support = pairs.groupby("f").agg(n=("_id", "size"), stem=("stem", "first")).reset_index()
        best = support.sort_values(["n", "stem", "f"], ascending=[False, False, True]).iloc[0]
        if best["n"] < MIN_SUPPORT:
            break
        out.append(int(best["f"]))
        covered = pairs.loc[pairs["f"] == best["f"], "_id"]
        pairs = pairs[~pairs["_id"].isin(covered)]
    # An insult that always comes with a stronger one covers nothing new; it counts too if it is about as frequent.
    top = max((r["c1"] for r in chosen), default=0)
    have = {spelled[f] for f in out}
    for r in sorted(chosen, key=lambda r: (-r["c1"], r["f"])):
        stem = any(h.endswith("*") and r["word"].startswith(h[:-1]) for h in have)
        if r["c1"] * 4 >= top and not stem and r["word"].isalpha() and len(out) < MAX_LEXICON and r["f"] not in out:
            out.append(r["f"])
            have.add(r["word"])
    return np.sort(np.array(out, np.int64).view(np.uint64)), [spelled[f] for f in out]


def fit_weights(marks: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights, none negative, by projected gradient with a light penalty; classes count alike."""
    x = np.log1p(marks)
    w, b = np.zeros(x.shape[1]), -1.0
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(3000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = weight * (p - y)
        w = np.maximum(w - 2.0 * (x.T @ g + 1e-3 * w), 0)
        b -= 2.0 * g.sum()
    return w, float(min(b, -0.1))


def train_flag(id_col: Column, folds: int, test_fold: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) != test_fold


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, label_col: str = "toxic",
        toxic_rows: int = TOXIC_SAMPLE, clean_rows: int = CLEAN_SAMPLE) -> Model:
    """Learn lexicon and weights from at most ``toxic_rows`` and ``clean_rows`` labelled rows (``train`` selects among labels).
    Without any usable label nothing is toxic."""
    docs = docs.select("doc_id", "text")
    sample = labelled_sample(docs, labels, F.lit(True) if train is None else train, label_col, toxic_rows, clean_rows)
    lexicon, spelled = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            marks = batch_marks(*flat_text(piece, "text"), lexicon)
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("y")),
                                              *(pa.array(marks[:, k]) for k in range(len(MARKS)))], names=["y", *MARKS])

    rows = sample.mapInArrow(run, "y int, " + ", ".join(f"{m} double" for m in MARKS)).toPandas()
    if len(rows) == 0 or not len(lexicon):
        return Model(lexicon, spelled, np.zeros(len(MARKS)), -3.0)
    weights, bias = fit_weights(rows[list(MARKS)].to_numpy(), rows["y"].to_numpy())
    return Model(lexicon, spelled, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: 0 to 1. Empty and null texts have no hits and get the lowest score; repeated rows repeat.
    One scan, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            marks = batch_marks(*flat_text(piece, "text"), model.lexicon)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.score(marks))], names=["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is under ``threshold``, with all columns; decided where a row is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            marks = batch_marks(*flat_text(piece, text_col), model.lexicon)
            yield piece.filter(pa.array(model.score(marks) < threshold))

    return docs.mapInArrow(run, docs.schema)


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    train = train_flag(F.col("doc_id"), 5, 0)
    model = fit(docs, table(spark, folder, "labels"), train)
    scored = score(docs, model)
    return scored.select("doc_id", (~train).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
