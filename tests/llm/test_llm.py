"""Operators of the llm subpackage against brute force on small tables full of odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from shotweave.llm import (bpe, dedup_exact, dedup_near, dedup_substring, lm, merkle, packing, pii, quality, toxicity)
from shotweave.llm.queries import QUERIES, SQL
from shotweave.llm.skew import connected_components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _word string, score string, _bits int"


def odd_texts() -> list:
    rng = random.Random(5)
    words = ["the", "cat", "ÉTÉ", "été", "dog's", "a", "1234", "naïve", "x|y", " ", "日本", "end.", "+1 (555) 010-9999"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "o ne", "a b c d", "a b c d e", "A b\tc d  e", "a" * 30000, "xy " * 4000, "Σας ΣΑΣ"]
    for _ in range(50):
        t = rng.choice(base)
        k = rng.randint(0, len(t))
        texts.append(t if rng.random() < 0.4 else t[:k] + rng.choice([" zz ", "Q", "\n", "é"]) + t[k:])
    return texts


@pytest.fixture(scope="module")
def texts():
    return {3 * i: t for i, t in enumerate(odd_texts())}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 2 else "en", None, None, "x", "y", "z", 1) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(df, key="doc_id"):
    return df.toPandas().set_index(key)


def blanks_out(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_exact_groups(docs, texts):
    got = frame(dedup_exact.exact_groups(docs))
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[blanks_out(t)].append(i)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got.loc[i]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), i == keep)
            assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert len(got) == len(texts)


def test_exact_dedup_keeps_columns_and_repeated_rows(docs, texts):
    kept = dedup_exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({blanks_out(t) for t in texts.values()})
    twice = docs.unionByName(docs)
    assert twice.count() == dedup_exact.exact_groups(twice).count()


def test_exact_filter_may_be_full(docs):
    small = frame(dedup_exact.exact_groups(docs, max_words=1))
    assert small.sort_index().equals(frame(dedup_exact.exact_groups(docs)).sort_index())


def near_truth(texts):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


def test_near_components(docs, texts):
    got = frame(dedup_near.near_components(docs))
    sets, label = near_truth(texts)
    assert {i: got.n_shingles[i] for i in texts} == {i: len(s) for i, s in sets.items()}
    assert {i: got.component_id[i] for i in texts} == label
    assert all(got.kept[i] == (label[i] == i) for i in texts)


def test_near_components_chain_and_table(spark):
    """A chain in which only neighbours are alike is one component, and a real table agrees with brute force."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(120)]
    chain = {}
    for i in range(12):
        chain[i] = " ".join(words)
        for _ in range(2):
            words[rng.randrange(120)] = f"n{rng.random()}"
    table = pd.read_parquet(f"{FOLDER}/documents.parquet").set_index("doc_id").text.to_dict()
    for texts in (chain, table):
        got = frame(dedup_near.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
        assert {i: got.component_id[i] for i in texts} == near_truth(texts)[1]


def template_texts(n: int, seed: int = 6) -> dict:
    """Documents that share 100 words and have 60 of their own; every tenth is a near copy of the one before, every 25th an exact one."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(100)]
    texts = {}
    for i in range(n):
        own = [f"o{rng.random()}" for _ in range(60)]
        words = shared[:50] + own + shared[50:]
        if i % 10 == 9:
            words = texts[i - 1].split()
            words[rng.randrange(160)] = f"n{i}"
        texts[i] = texts[i - 1] if i % 25 == 24 else " ".join(words)
    return texts


@pytest.mark.parametrize("crowd", [2, 64])
def test_documents_of_one_template(spark, monkeypatch, crowd):
    monkeypatch.setattr(dedup_near, "CROWD", crowd)
    texts = template_texts(300)
    rows = list(texts.items()) + [(7, texts[7]), (1000, texts[7] + " more"), (1000, "other words of the same document id here")]
    got = dedup_near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_truth({**texts, 1000: texts[7] + " more"})[1]
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_crowded_buckets_give_few_lists(spark):
    texts = template_texts(300)
    frame_ = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = frame_.select("doc_id", F.col("doc_id").alias("component"))
    lists = dedup_near.rare_lists(members, dedup_near.shingle_sets(frame_), 75)
    sizes = lists.groupBy("key").count().toPandas()["count"]
    assert sizes.max() <= 3
    paired = lists.join(lists.withColumnRenamed("doc_id", "b").drop("component"), "key").filter("doc_id < b").select("doc_id", "b").distinct()
    sets, _ = near_truth(texts)
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near <= {(r["doc_id"], r["b"]) for r in paired.collect()}


def test_connected_components_of_a_long_path(spark):
    path = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_signature_keys_find_all_pairs_within_the_distance():
    rng = np.random.default_rng(2)
    limit = dedup_near.CHUNKS * (dedup_near.CHUNK_ERRORS + 1) - 1
    a = rng.integers(0, 1 << 16, dedup_near.CHUNKS * dedup_near.CHUNK_SYMBOLS)
    for _ in range(200):
        b = a.copy()
        b[rng.choice(len(a), limit, replace=False)] += 1
        chunks = (a != b).reshape(dedup_near.CHUNKS, -1).sum(1)
        assert chunks.min() <= dedup_near.CHUNK_ERRORS


def test_fingerprints(docs, texts):
    got = frame(merkle.compare_with_edits(docs))
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        assert got.n_chars[i] == len(t)
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got.fingerprint[i] == got.edited_fingerprint[i]) == (t == edited)
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t or ""].add(got.fingerprint[i])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    plain = frame(merkle.fingerprints(docs))
    assert (plain.fingerprint.sort_index() == got.fingerprint.sort_index()).all()


def test_fingerprint_ranges_and_edits(spark):
    texts = {i * i: f"line {i} of a text\nwith two lines {i % 3}\n" for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    ranged = merkle.ranged(df, 7).toPandas()
    assert ranged["lead"].sum() == ranged["range"].nunique() == 6
    a, b = merkle.trees(*merkle._flat(["p one two\nq three four\nr five six\n", "p one two\nq three changed\nr five six\n"]))
    assert len(merkle.located_edits(a, b)) == 1 and 0 < merkle.likeness(a, b) < 1
    assert merkle.likeness(a, a) == 1.0


def test_fingerprints_of_texts_without_blanks_and_of_repeats():
    rng = random.Random(3)
    signs = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(4000))
    other = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(1000))
    code = "".join(rng.choice("ABCDEFGHabcdefgh0123+/") for _ in range(8000))
    for text, end in ((signs, other), (code, other), ("w" * 8000, other), *((f"{w} " * 2000, other) for w in "abcdefgh")):
        edited = text[:len(text) * 3 // 4] + end[:len(text) // 4]
        near, shifted, apart = (merkle.trees(*merkle._flat([t]))[0] for t in (edited, text[:50] + "x" + text[50:], other))
        own = merkle.trees(*merkle._flat(["before it", text]))[1]
        assert 0.3 < merkle.likeness(own, near) < 1
        assert merkle.likeness(own, shifted) > 0.9 and merkle.likeness(own, apart) < 0.05


def test_fingerprints_of_long_unrelated_texts():
    rng = random.Random(4)
    a, b = (merkle.trees(*merkle._flat([" ".join(k + str(rng.randrange(10 ** 9)) for _ in range(60000))]))[0] for k in "pq")
    assert merkle.leaf_width(a) == 6 and merkle.likeness(a, b) < 0.005 and merkle.likeness(a, a) == 1.0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii_base_spans():
    rng = random.Random(4)
    parts = ["a.b", "@", "x-y.com", ".", " ", "-", "+", "(", ")", "1", "255", "256.", "4111 1111 1111 1111", "10.0.0.1", "é", "@@", "%"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m.group())]
        assert pii.base_spans(t) == want, t


def test_pii_patterns_find_more(spark):
    rows = [(i, f"write to the account holder number 10.0.{i}.7 today") for i in range(30)]
    rows += [(100, "write to the account holder number ZX81-4432-AB today"), (101, "room 1234567 is empty"), (102, None), (103, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _found_id string")
    got = frame(pii.find_spans(df))
    assert [tuple(s) for s in got.found[100]] == [("id", 35, 47)]
    assert not len(got.found[101]) and not len(got.base[102])
    clean = frame(pii.redact(df))
    assert clean.text[100] == "write to the account holder number [id] today"
    assert clean.text[3] == "write to the account holder number [ip] today" and clean.text[101] == rows[31][1]
    assert pd.isna(clean.text[102]) and list(clean.columns) == ["text", "_found_id"]


def substring_truth(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - width + 1):
            s = raw[p:p + width]
            if s in seen:
                gone[p:p + width] = True
            seen.add(s)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_repeated_strings_go(docs, texts):
    got = frame(dedup_substring.remove_repeats(docs).drop("kept"))
    want = substring_truth(texts, 100)
    assert {i: tuple(got.loc[i]) for i in texts} == want


def test_packing(docs, texts):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).toPandas().sort_values(["doc_id", "piece"])
    total = 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        rows = got[got.doc_id == i]
        want = [(k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()))
                for k, a in enumerate(range(0, len(ids), 2048))]
        assert [tuple(r) for r in rows[["piece", "start", "length", "ids_crc32"]].to_numpy()] == want
    filled = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (filled.length.sum() <= 2048).all()
    assert ((filled.length.cumsum() - got.length)[got.index] == got.offset).all()
    assert filled.ngroups <= -(-total // 2048) + 2


def test_open_sequences_are_packed_again():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.minimum(rng.exponential(600, 3000).astype(int) + 1, 2047))[::-1]
    number, offset = packing.packed(sizes, 2048)
    made = len(np.unique(number))
    assert made <= len(np.unique(packing.sum_of_squares(sizes, 2048)[0]))
    assert made <= 1.002 * sizes.sum() / 2048 + 1
    for b in np.unique(number):
        at = np.argsort(offset[number == b])
        ends = np.cumsum(sizes[number == b][at])
        assert (offset[number == b][at] == np.r_[0, ends[:-1]]).all() and ends[-1] <= 2048
    assert packing.packed(sizes[:0], 2048)[0].size == 0
    assert sorted(packing.best_fit(np.array([3, 3, 2, 2]), 5)[0].tolist()) == [0, 0, 1, 1]


def test_packing_keeps_columns_of_any_name(spark):
    items = spark.createDataFrame([(i, 100 + i, 7, "g") for i in range(60)], "id long, length long, _row int, _group string")
    got = packing.pack(items, 2048).collect()
    assert {(r["_row"], r["_group"]) for r in got} == {(7, "g")} and len(got) == 60


def test_packing_is_close_to_the_bound(spark):
    for name, most in (("sf0.01", 443), ("sf0.1", 4543)):
        plan = QUERIES["op7_packing"](spark, f"/root/testdata/{name}")
        assert plan.select("sequence_id").distinct().count() <= most


def test_sum_of_squares_is_near_the_bound():
    sizes = np.sort(np.random.default_rng(3).integers(1, 900, 4000))[::-1]
    number, offset = packing.sum_of_squares(sizes, 2048)
    assert np.bincount(number, sizes).max() <= 2048
    assert number.max() + 1 <= 1.02 * sizes.sum() / 2048


def test_bpe_matches_the_library(docs, texts):
    from tokenizers import Tokenizer
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = frame(bpe.round_trip(docs, path))
    encoded = bpe.encode_texts(docs, path)
    lists, back = frame(encoded), frame(bpe.decode_ids(encoded, path))
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(lists.ids[i]) == ids and got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert back.text[i] == decoded and got.decoded_sha256[i] == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_on_random_unicode(name):
    from tokenizers import Tokenizer
    path = bpe.vocabulary_path(name)
    tokenizer, engine, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(9)
    parts = ["a", "B", "é", "ß", "'", "'s", "'LL", "'re", " ", "  ", "\n", "\t", "1", "23", "²", "!", "...", "<|endoftext|>", "<|startoftext|>",
             "<|", "İ", "Σ", "汉字", "😀", "é", "한", "\x1c", "\x00", "​", "ﬁ", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    raw, offsets = merkle._flat(texts)
    ids, cuts = engine.encode(raw, offsets)
    for k, t in enumerate(texts):
        assert ids[cuts[k]:cuts[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_language_model(spark, docs, texts):
    train = F.col("doc_id") % 7 != 2
    got = frame(lm.score_texts(docs, train))
    tokens = {i: [*words_of(t), None] for i, t in texts.items()}
    c = collections.Counter(w for i, v in tokens.items() if i % 7 != 2 for w in v)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert np.isclose(r.base_score, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert got.score.sum() > got.base_score.sum()


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    model = lm.LogBilinear.start(rng.integers(0, 100, lm.SYMBOLS))
    codes = rng.integers(0, lm.SYMBOLS ** 3, 500)
    model.train(np.sort(codes), rng.integers(1, 9, 500), 5 * lm.BATCH, 1)
    assert np.allclose(np.exp(model.table().astype(float)).sum(1), 1, atol=1e-4)


def test_language_model_trains_on_every_row():
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.asarray(at))
            return np.asarray(self)[at]

    rng = np.random.default_rng(2)
    counts = np.r_[rng.integers(1, 4, 3 * lm.BATCH), 5000]
    model = lm.LogBilinear.start(rng.integers(0, 100, lm.SYMBOLS))
    model.train(np.sort(rng.integers(0, lm.SYMBOLS ** 3, len(counts))).view(Watched), counts, lm.BATCH, 1)
    times = np.bincount(np.concatenate(seen), minlength=len(counts))
    assert (times == np.ceil(counts / counts.mean())).all() and times.sum() < 2 * len(counts)


def test_contexts_do_not_cross_rows():
    target, code = lm.contexts(np.array([5, 6, 7, 8]), np.array([0, 2, 2, 4]))
    assert target.tolist() == [5, 6, 0, 0, 7, 8, 0]
    s = lm.SYMBOLS
    assert [(int(x) // s, int(x) % s) for x in code] == [(0, 0), (5, 0), (6, 5), (0, 0), (0, 0), (7, 0), (8, 7)]


def labelled(spark, kind):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        body = [rng.choice(words) for _ in range(30)]
        if bad and kind == "toxic":
            for _ in range(2):
                body.insert(rng.randrange(len(body)), rng.choice(["grobian", "schuftig"]))
        if bad and kind == "quality":
            body = [w.upper() + "!!" for w in body]
        rows.append((i, " ".join(body), "en", "s", None))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(900, None, None, None, None), (901, "", "en", None, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, f"doc_id long, {kind} int"))


def test_toxicity(spark, docs):
    table, labels = labelled(spark, "toxic")
    model = toxicity.fit(table, labels, F.col("doc_id") % 5 != 0)
    got = frame(toxicity.score(table, model))
    for r in labels.collect():
        assert (got.score[r.doc_id] >= 0.5) == bool(r.toxic)
    assert got.score[900] == got.score[901] < 0.5
    assert toxicity.keep_clean(table, model).count() == 162
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_toxic_grammar():
    t = toxicity
    marks = dict(zip(t.MARKS, t.clause_marks(np.array([t.TARGET, t.OTHER, t.INSULT, t.END, t.NEGATION, t.INSULT, t.END, t.REPORT,
                                                        t.OTHER, t.INSULT, t.END, t.INSULT, t.THREAT, t.WEAK]))))
    assert marks == {"plain": 1, "targeted": 1, "negated": 1, "reported": 1, "threat": 0, "weak": 0}


def test_quality(spark):
    table, labels = labelled(spark, "quality")
    model = quality.fit_quality(table, labels, F.col("doc_id") % 5 != 0)
    got = frame(quality.score_quality(table, model))
    assert np.mean([(got.score[r.doc_id] >= 0.5) == bool(r.quality) for r in labels.collect()]) > 0.97
    assert got.score.between(0, 1).all() and len(got) == 242


def test_quality_pool_is_every_other_row(spark, monkeypatch):
    """Few labels: the pool is all the rest, and is pseudo-labelled in every round."""
    table, labels = labelled(spark, "quality")
    seen = []
    counted = quality.confidence_counts
    monkeypatch.setattr(quality, "confidence_counts", lambda f, m: seen.append(counted(f, m)) or seen[-1])
    model = quality.fit_quality(table, labels, F.lit(True), labelled=30)
    assert [c.sum(axis=1).tolist() for c in seen] == [[212, 212]] * quality.ROUNDS
    got = frame(quality.score_quality(table, model))
    assert np.mean([(got.score[r.doc_id] >= 0.5) == bool(r.quality) for r in labels.collect()]) > 0.97


def test_quality_without_a_pool(spark):
    table, labels = labelled(spark, "quality")
    known = table.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = quality.fit_quality(known, labels, F.lit(True))
    got = frame(quality.score_quality(known, model))
    assert np.mean([(got.score[r.doc_id] >= 0.5) == bool(r.quality) for r in labels.collect()]) > 0.97


def test_quality_of_contradicting_and_repeated_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert sorted(map(tuple, quality.labelled_ids(labels, "quality", F.lit(True), 10).collect())) == [(2, 1), (3, 0)]
    table, _ = labelled(spark, "quality")
    twice = table.unionByName(table.filter("doc_id < 40"))
    assert quality.fit_quality(twice, labels, F.lit(True)) is not None
    assert quality.fit_quality(table, labels.filter("doc_id = 2"), F.lit(True)) is None


def test_confidence_cut_takes_its_share():
    rng = np.random.default_rng(3)
    logit = np.r_[rng.normal(size=5000), np.full(5000, 50.0)]
    bins, dice = quality.bins_of(logit), rng.random(10000)
    counts = np.bincount(bins, minlength=quality.BINS)
    for limit in (500, 5000, 5100):
        picked = quality.cut_of(counts, limit, 0.6).picks(bins, dice)
        assert abs(picked.sum() - limit) < 100 and logit[picked].min() > np.log(0.6 / 0.4) - 0.1
    assert quality.cut_of(counts, 9999, 0.9).picks(bins, dice).sum() < 5200
    assert quality.cut_of(counts, 0, 0.9).picks(bins, dice).sum() == 0


def test_held_out_of_quality(spark):
    got = QUERIES["op4_quality"](spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_empty_tables(spark, empty):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    results = [dedup_exact.exact_groups(empty), dedup_exact.exact_dedup(empty), dedup_near.near_components(empty),
               dedup_near.near_dedup(empty), merkle.compare_with_edits(empty), pii.find_spans(empty), pii.redact(empty),
               dedup_substring.remove_repeats(empty), packing.pack_documents(empty, path), bpe.round_trip(empty, path),
               lm.score_texts(empty, F.lit(True)), toxicity.score(empty, toxicity.fit(empty, labels)),
               quality.score_quality(empty, quality.fit_quality(empty, labels, F.lit(True)))]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op12_nearest_vectors"}))
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline(spark):
    """Every stage against the brute-force form of its decision, on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER).checkpoint() if name != "packing" else stage(spark, docs, FOLDER)
        steps[name] = (before.toPandas(), docs.toPandas())
        if name != "packing":
            assert docs.columns == before.columns
    before, after = steps["exact_dedup"]
    best = before.assign(k=before.text.map(blanks_out), n=-before.text.str.len()).sort_values(["n", "doc_id"]).groupby("k").doc_id.first()
    assert set(after.doc_id) == set(best)
    before, after = steps["near_dedup"]
    label = near_truth(dict(zip(before.doc_id, before.text)))[1]
    assert set(after.doc_id) == set(label.values())
    before, after = steps["pii"]
    assert set(before.doc_id) == set(after.doc_id)
    assert not any(pii.base_spans(t) for t in after.text)
    assert (after.n_chars == after.text.str.len()).all()
    before, after = steps["packing"]
    assert set(before.doc_id) == set(after.doc_id)
    final = corpus_pipeline.run(spark, FOLDER).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert final[key].sort_values(key).reset_index(drop=True).equals(after[key].sort_values(key).reset_index(drop=True))


def test_component_rounds_write_few_files(spark):
    from shotweave.llm.skew import LEAST_PARTS, connected_components

    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
        assert got.rdd.getNumPartitions() <= LEAST_PARTS
        assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
