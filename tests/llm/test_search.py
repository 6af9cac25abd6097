"""Collocations, nearest vectors and ranked search against brute force on small odd tables."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from shotweave.llm import collocations, neighbours, ranked
from shotweave.llm.queries import QUERIES, SQL
from shotweave.llm.spans import WordTable

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank string, _band int, words int, score string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_collocations", "op13_ranked_search"])
def test_queries_equal_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) in (None, "empty")


def odd_documents():
    rng = random.Random(3)
    words = ["New", "york", "the", "été", "ÉTÉ", "a", "x1", "日本", "foo\x01bar", "don't"]
    out = [(0, None, "en"), (1, "", None), (2, " \t\n .,;", "en"), (3, "the " * 40000, "en"), (4, "a" * 100_000 + " the", None)]
    for i in range(5, 120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0c"]) for _ in range(rng.randint(0, 60)))
        out.append((i, text + " new york the a" * rng.randint(0, 3), rng.choice(["en", "fr", None])))
    return out + [out[50]] * 7 + [(None, "the new york", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "r", 1, 2, "s") for i, t, g in rows], DOCS).repartition(4)


# --- collocations -----------------------------------------------------------------------------------------------


def brute_collocations(rows, longest, least, top):
    counts, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[(lang or "und", tuple(words[i:i + k]))] += 1
    long = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in long.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in long.items()):
            continue
        cuts = [(1000 * a * n[lang] // (counts[(lang, p[:k])] * counts[(lang, p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[(lang, p[:k])], counts[(lang, p[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("how", [{}, {"trie_phrases": 3, "dictionary": 4}])
def test_collocations(spark, how):
    rows = odd_documents()
    got = collocations.collocations(frame(spark, rows), least=5, top=40, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 5, 5, 40)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        assert collocations.collocations(frame(spark, rows)).collect() == []


def test_score_beyond_64_bits(spark):
    a, n, left, right = 10**12, 10**14, 3 * 10**12, 7 * 10**12 + 1
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations.score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0] == 1000 * a * n // (left * right)
    # A quotient a hair under a whole number stays under it.
    a, n, left, right = 999_999_999_999, 10**14, 10**15, 10**14
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations.score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0] == 1000 * a * n // (left * right)


def test_trie_holds_just_its_phrases():
    rng = np.random.default_rng(1)
    alphabet = 60
    pairs = np.unique(rng.integers(1, alphabet + 1, (900, 2)), axis=0).astype(np.int32)
    have = {tuple(p) for p in pairs.tolist()}
    triples = np.unique(np.column_stack([pairs[rng.integers(0, len(pairs), 2000)], rng.integers(1, alphabet + 1, 2000)]), axis=0)
    triples = triples.astype(np.int32)
    trie = collocations.Trie.of(alphabet, [pairs, triples])
    x = rng.integers(0, alphabet + 1, 5000).astype(np.int32)
    walked = {size: (at, trie.phrases[trie.number[slot]]) for size, at, slot in trie.walk(x, 3) if size > 1}
    for size, known in ((2, have), (3, {tuple(t) for t in triples.tolist()})):
        want = [i for i in range(len(x) - size + 1) if tuple(x[i:i + size].tolist()) in known]
        assert walked[size][0].tolist() == want
        assert all(tuple(p[:size]) == tuple(x[i:i + size]) for i, p in zip(*walked[size]))


def test_trie_of_many_wide_scattered_sets():
    rng = np.random.default_rng(2)
    alphabet, started = 40_000, time.monotonic()
    counts = np.r_[np.full(400, 900), rng.integers(1, 300, 1500)]
    pairs = np.concatenate([np.column_stack([np.full(n, i + 1), rng.choice(alphabet, n, replace=False) + 1]) for i, n in enumerate(counts)])
    pairs = pairs[np.lexsort(pairs.T[::-1])].astype(np.int32)
    two = collocations.Trie.of(alphabet, [pairs])
    triples = np.column_stack([pairs[::2], rng.integers(1, alphabet + 1, len(pairs[::2]))]).astype(np.int32)
    trie = two.grown(triples)
    assert time.monotonic() - started < 60
    assert len(trie.check) < 16 * (len(pairs) + len(triples)) + 8 * alphabet
    # What was there keeps its slots and numbers, so a level never places those before it again.
    assert (trie.number[:len(two.number)][two.number >= 0] == two.number[two.number >= 0]).all()
    for phrases, first in ((pairs, 0), (triples, len(pairs))):
        slot = phrases[:, 0].astype(np.int64)
        for j in range(1, phrases.shape[1]):
            slot, there = trie.step(slot, phrases[:, j].astype(np.int64))
            assert there.all()
        assert (trie.number[slot] == first + np.arange(len(phrases))).all()
    left, right = rng.integers(1, alphabet + 1, (2, 200_000))
    known = set((pairs[:, 0].astype(np.int64) * (alphabet + 1) + pairs[:, 1]).tolist())
    assert trie.step(left, right)[1].tolist() == [code in known for code in (left * (alphabet + 1) + right).tolist()]


def test_shares_test_the_last_pair_of_a_phrase(spark):
    texts = spark.createDataFrame([([1, 2, 3],)] * 5 + [([1, 2, 4],)] * 5 + [([2, 3],)] * 9, "ids array<int>")
    sc, pairs = spark.sparkContext, np.array([[1, 2], [2, 3]], np.int32)
    seen = collocations.pair_filter(iter([pairs[:, 0] * 5 + pairs[:, 1].astype(np.int64)]), 2)
    trie = collocations.Trie.of(4, [pairs])
    grown = collocations.extended(texts, sc.broadcast(trie), 4, 3, 1, sc.broadcast(seen))
    assert [tuple(r) for r in grown.collect()] == [(0 * 5 + 3, 5)]


def test_word_table_tells_words_apart():
    def hashes(seed):
        return (np.array([1, 1 if seed == 0 else 2, 3], np.uint64), np.array([7, 8, 9], np.uint64))

    words = WordTable(hashes, np.array([10, 20, 30]))
    assert words.seed == 1
    assert words.find(np.array([2, 2, 5], np.uint64), np.array([8, 7, 8], np.uint64)).tolist() == [20, 0, 0]


# --- nearest vectors --------------------------------------------------------------------------------------------


def odd_vectors():
    rng = np.random.default_rng(8)
    out = [(i, rng.normal(size=16).astype(np.float32).tolist(), "x", 1) for i in range(600)]
    same = out[0][1]
    out += [(i, same, "x", 1) for i in range(600, 900)]
    out += [(900, None, "x", 1), (1000, [0.0] * 16, "x", 1), (1100, [float("nan")] + same[1:], "x", 1), (1200, [None] + same[1:], "x", 1),
            (1300, [float("inf")] + same[1:], "x", 1), (None, same, "x", 1), (1400, same[:5], "x", 1), (1401, same[1:6], "x", 1)]
    return out + [out[100]] * 5 + [out[7]]


VECTORS = "vec_id long, embedding array<float>, gid string, size int"


def test_nearest_vectors(spark):
    rows = odd_vectors()
    source = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = neighbours.nearest_vectors(source, F.col("vec_id") % 100 == 0, k=10, shard_rows=200, block_queries=4).collect()
    good = {i: np.array(e, float) for i, e, *_ in rows
            if i is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    hit = total = 0
    for q in [i for i in good if i % 100 == 0]:
        want = sorted((float(np.sqrt(((e - good[q]) ** 2).sum())), i) for i, e in good.items() if i != q and len(e) == len(good[q]))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        for _, i, score in mine:
            assert score == pytest.approx(float(np.sqrt(((good[i] - good[q]) ** 2).sum())), rel=1e-14)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in want})
        total += len(want)
    assert {r["query_id"] for r in got} == {i for i in good if i % 100 == 0}
    assert hit / total >= 0.95
    copies = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 700), key=lambda r: r["rank"])]
    assert copies == [0, *range(600, 609)]


def test_recall_on_the_embeddings(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = QUERIES["op12_nearest_vectors"](spark, "/root/testdata/sf0.1")
    frame = source.toPandas()
    ids, matrix = frame["vec_id"].to_numpy(), np.stack(frame["embedding"]).astype(float)
    rows = []
    for q in ids[ids % 100 == 0]:
        dist = np.sqrt(((matrix - matrix[ids == q]) ** 2).sum(axis=1))
        dist[ids == q] = np.inf
        rows += [(int(q), int(i)) for i in ids[np.lexsort((ids, dist))[:10]]]
    exact = spark.createDataFrame(rows, "query_id long, vec_id long")
    assert found.count() == len(rows)
    assert neighbours.recall(found, exact) >= 0.95


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], "x", 1), (1, [1.0, 3.0], "x", 1)], VECTORS)
    assert [tuple(r) for r in neighbours.nearest_vectors(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1.0)]
    for rows in ([], [(0, None, "x", 1)], [(1, [1.0], "x", 1)], [(0, [1.0], "x", 1)]):
        assert neighbours.nearest_vectors(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect() == []


def test_reach_is_wide_enough():
    factor = neighbours.reach(64, 36, 0.98)
    rng = np.random.default_rng(2)
    collisions = (np.abs(rng.normal(size=(20000, 64))) <= factor).sum(axis=1)
    assert 0.975 < (collisions >= 36).mean() < 0.985


# --- ranked search ----------------------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranked(rows, items, top):
    bags = [(LAST if i is None else i, collections.Counter(terms(t))) for i, t, _ in rows]
    n_docs, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items.items():
        found = []
        for doc, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if t in bag)
            if score > 0:
                found.append((-score, doc))
        out += [(item, k + 1, None if d == LAST else d, -s) for k, (s, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


LAST = (1 << 63) - 1


@pytest.mark.parametrize("pass_bytes", [1 << 20, 30_000])
def test_ranked_search(spark, pass_bytes):
    rows = odd_documents()
    items = {1: "New York, the", 2: "york york york ÉTÉ été", 3: "zzz", 4: "don't  x1 日本", 5: "the a", 7: "a" * 100_000}
    listed = [(i, t, "x") for i, t in items.items()] + [(1, "york zebra", "x"), (8, None, "x"), (9, "", "x"), (9, None, "x"), (5, "the a", "x")]
    asked = spark.createDataFrame(listed, "item_id long, text string, score string")
    got = ranked.ranked_search(frame(spark, rows), asked, top=9, pass_bytes=pass_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranked(rows, items, 9)


def test_ranked_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "the")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked.ranked_search(frame(spark, []), asked).collect() == []
    assert ranked.ranked_search(frame(spark, [(1, None, None)]), asked).collect() == []
    assert ranked.ranked_search(frame(spark, odd_documents()), none).collect() == []


def test_scores_beyond_doubles(spark):
    """An item that repeats its terms too often for exact doubles is scored in integers."""
    item = "the " * 400_000 + "york " * 300_001
    rows = [(i, "the " * i + "york " * (7 * i % 5) + "other " * 30, "en") for i in range(1, 30)] + [(50 + i, "none", "en") for i in range(4000)]
    asked = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((tuple(r) for r in ranked.ranked_search(frame(spark, rows), asked).collect()), key=repr)
    assert got == brute_ranked_fast(rows, item, 20)
    assert got[0][3] > 1 << 40


def brute_ranked_fast(rows, text, top):
    """As :func:`brute_ranked` with the item's repeats counted first."""
    times = collections.Counter(terms(text))
    bags = [(i, collections.Counter(terms(t))) for i, t, _ in rows]
    n_docs, length = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    found = []
    for doc, bag in bags:
        m = 75 + 25 * bag.total() * n_docs // length
        found.append((-sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                           for t, c in times.items() if t in bag), doc))
    return sorted(((1, k + 1, d, -s) for k, (s, d) in enumerate(sorted(f for f in found if f[0] < 0)[:top])), key=repr)


