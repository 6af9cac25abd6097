"""Searches against brute force over small tables in which one fingerprint holds a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotweave.functions import fingerprints as fpx
from shotweave.operators import similarity

N_BITS = 166


def make_rows(n=160, seed=0):
    rng = random.Random(seed)
    centres = [{b for b in range(N_BITS) if rng.random() < 0.4} for _ in range(6)]
    rows = []
    for key in range(n):
        if key % 3 == 0:
            bits = centres[0]
        else:
            bits = set(rng.choice(centres)) ^ {rng.randrange(N_BITS) for _ in range(rng.randrange(12))}
            bits = {b for b in bits if rng.random() < rng.choice([1.0, 0.9, 0.4])}
        rows.append((key * 7 % 1009, "hot" if key % 4 else "cold", sorted(bits) if key != 10 else []))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "key bigint, task string, bits array<int>")
    return df.select("key", "task", fpx.bits_to_words(F.col("bits")).alias("words")).cache()


def brute(queries, candidates, k, by_task, skip_self, floor=0.0):
    out = set()
    for q, qt, qb in queries:
        near = []
        for c, ct, cb in candidates:
            if (by_task and ct != qt) or (skip_self and c == q) or not qb or not cb:
                continue
            both = len(set(qb) & set(cb))
            either = len(qb) + len(cb) - both
            if both / either >= floor:
                near.append((1.0 - both / either, c))
        out |= {(q, r + 1, c, round(d, 12)) for r, (d, c) in enumerate(sorted(near)[:k])}
    return out


def found(df):
    return {(r["query_id"], r["rank"], r["key"], round(r["distance"], 12)) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.mark.parametrize("two_steps", [False, True])
@pytest.mark.parametrize("by", [[], ["task"]])
def test_self_search(spark, rows, two_steps, by):
    got = similarity.nearest(frame(spark, rows), None, 5, by=by, block_rows=16, two_steps=two_steps)
    assert found(got) == brute(rows, rows, 5, bool(by), True)


@pytest.mark.parametrize("two_steps", [False, True])
def test_cross_search(spark, rows, two_steps):
    queries = make_rows(40, 5)
    got = similarity.nearest(frame(spark, queries), frame(spark, rows), 70, by=["task"], block_rows=8, two_steps=two_steps)
    assert found(got) == brute(queries, rows, 70, True, False)


@pytest.mark.parametrize("floor", [0.5, 0.9, 1.0])
def test_floor(spark, rows, floor):
    got = similarity.nearest(frame(spark, rows), None, 200, min_similarity=floor, block_rows=16)
    assert found(got) == brute(rows, rows, 200, False, True, floor)


@pytest.mark.parametrize("floor", [0.3, 0.8, 1.0])
@pytest.mark.parametrize("limit", [2, 4096])
def test_index_on_rare_bits(spark, rows, floor, limit, monkeypatch):
    monkeypatch.setattr(similarity, "LONG_LIST", limit)
    table = frame(spark, rows)
    got = similarity.nearest_within(table, None, 6, floor, by=["task"], n_bits=192, block_rows=16)
    assert found(got) == brute(rows, rows, 6, True, True, floor)
    queries = make_rows(30, 5)
    got = similarity.nearest_within(frame(spark, queries), table, 70, floor, n_bits=192, block_rows=16)
    assert found(got) == brute(queries, rows, 70, False, False, floor)


def test_index_of_nothing(spark, rows):
    table = frame(spark, rows)
    assert similarity.nearest_within(table.limit(0), table, 3, 0.5, n_bits=192).count() == 0
    assert similarity.nearest_within(table, table.limit(0), 3, 0.5, n_bits=192).count() == 0


def test_wide_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, "t", sorted(rng.sample(range(2048), 60)) if i % 5 else list(range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "key bigint, task string, bits array<int>")
    words = df.select("key", fpx.bits_to_words(F.col("bits"), 64).alias("words"))
    assert found(similarity.nearest(words, None, 3)) == brute(rows, rows, 3, False, True)


def test_copies_expand_in_key_order(spark):
    rows = [(k, "t", [1, 2, 3]) for k in (9, 4, 7, 1)] + [(2, "t", [1, 2, 4])]
    got = found(similarity.nearest(frame(spark, rows), None, 3))
    assert {g for g in got if g[0] == 4} == {(4, 1, 1, 0.0), (4, 2, 7, 0.0), (4, 3, 9, 0.0)}
    assert {g for g in got if g[0] == 2} == {(2, 1, 1, 0.5), (2, 2, 4, 0.5), (2, 3, 7, 0.5)}


def test_many_copies_and_ties(spark):
    rng = random.Random(8)
    kinds = [[1, 2, 3], [1, 2, 4], [1, 2, 5], [7, 8], [1, 2, 3, 9]]
    rows = [(k, "t", rng.choice(kinds)) for k in rng.sample(range(500), 120)]
    got = similarity.nearest(frame(spark, rows), None, 30, block_rows=2)
    assert found(got) == brute(rows, rows, 30, False, True)


def test_lsh_hot_buckets_equal_joined_buckets(spark, rows, monkeypatch):
    table = frame(spark, rows)
    joined = found(similarity.nearest_lsh(table, None, 4, by=["task"], bands=12, rows=3, small_rows=0))
    monkeypatch.setattr(similarity, "SMALL_BUCKET", 2)
    blocked = found(similarity.nearest_lsh(table, None, 4, by=["task"], bands=12, rows=3, block_rows=8, small_rows=0))
    assert blocked == joined and joined


def test_lsh_recall(spark, rows):
    table = frame(spark, rows)
    exact = similarity.nearest(table, None, 4, min_similarity=0.7)
    approximate = similarity.nearest_lsh(table, None, 4, bands=24, rows=3, small_rows=0)
    assert similarity.recall(approximate, exact).head()["recall"] > 0.95


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_certified_recall_on_documents(spark, name):
    from shotweave.workloads import QUERIES

    assert QUERIES["knn_lsh_recall"](spark, f"/root/testdata/{name}").head()["recall"] >= 0.9


def test_certain_similarity():
    s = similarity.certain_similarity(16, 8, 0.95)
    assert 1 - (1 - s**8) ** 16 == pytest.approx(0.95)
    assert similarity.certain_similarity(64, 8, 0.95) < s < similarity.certain_similarity(16, 8, 0.99)


def test_uncertain_queries_are_searched_exactly(spark, rows):
    """With bands that certify nothing but copies, the result is the exact one."""
    table = frame(spark, rows)
    for by in ([], ["task"]):
        got = similarity.nearest_lsh(table, None, 5, by=by, bands=2, rows=8, certainty=1 - 1e-15, small_rows=0, block_rows=16)
        assert found(got) == brute(rows, rows, 5, bool(by), True)


@pytest.mark.parametrize("limit", [2, 256])
def test_buckets_emit_only_rows_that_can_stop_a_query(spark, rows, limit, monkeypatch):
    """In small buckets and in large ones, which are sent to no block out of reach; the result is that of comparing everything."""
    enough, met, best = similarity.certain_similarity(4, 4, 0.95), [], similarity._best_rows

    def noted(hits, by, k):
        met.append(hits.agg(F.max("distance")).head()[0])
        return best(hits, by, k)

    monkeypatch.setattr(similarity, "SMALL_BUCKET", limit)
    monkeypatch.setattr(similarity, "_best_rows", noted)
    got = similarity.nearest_lsh(frame(spark, rows), None, 4, bands=4, rows=4, small_rows=0, block_rows=8)
    assert met[0] <= 1.0 - enough + 1e-9
    assert {g[:2] for g in found(got)} == {w[:2] for w in brute(rows, rows, 4, False, True)}


@pytest.mark.parametrize("small_rows", [30, 1000])
def test_small_groups_are_searched_exactly(spark, rows, small_rows):
    """The hot task has more distinct fingerprints than 30, the cold one fewer."""
    got = found(similarity.nearest_lsh(frame(spark, rows), None, 5, by=["task"], bands=4, rows=6, small_rows=small_rows))
    want = brute(rows, rows, 5, True, True)
    cold = {k for k, t, _ in rows if t == "cold"}
    assert {g for g in got if g[0] in cold} == {w for w in want if w[0] in cold}
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert small_rows == 30 or got == want


def test_wide_bands_fall_back_to_hashed_keys(spark):
    rng = random.Random(4)
    rows = [(i, "t", sorted(rng.sample(range(2048), 60)) if i % 4 else list(range(0, 120, 2))) for i in range(80)]
    words = spark.createDataFrame(rows, "key bigint, task string, bits array<int>").select(
        "key", fpx.bits_to_words(F.col("bits"), 64).alias("words"))
    got = similarity.nearest_lsh(words, None, 3, n_bits=2048, n_words=64, bands=4, rows=8, small_rows=0)
    assert found(got) == brute(rows, rows, 3, False, True)


def test_more_copies_than_the_early_limit(spark, rows, monkeypatch):
    monkeypatch.setattr(similarity, "EARLY_LIMIT", 3)
    assert found(similarity.nearest(frame(spark, rows), None, 7)) == brute(rows, rows, 7, False, True)


def test_self_recall(spark, rows):
    distinct = {}
    for key, _, bits in rows:
        if bits:
            distinct.setdefault(tuple(bits), []).append(key)
    n = sum(len(v) for v in distinct.values())
    for search in (None, similarity.nearest, similarity.nearest_lsh):
        got = similarity.self_recall(frame(spark, rows), search).head()
        assert got["queries"] == n and got["recall"] == pytest.approx(len(distinct) / n) and got["same"] == 1.0


def test_external_encoder(spark):
    import pandas as pd

    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t == "bad" else len(t).to_bytes(24, "big"))

    df = spark.createDataFrame([(1, "abc"), (2, "bad")], "id bigint, text string")
    got = {r["key"]: (r["words"], r["popcount"]) for r in
           similarity.external_fingerprints(df, "id", "text", encode, 6).collect()}
    assert got == {1: ([0, 0, 0, 0, 0, 3], 2), 2: (None, None)}


def test_search_plan_limits_before_the_shuffle(spark, rows, capsys):
    from pyspark.sql import Window

    table = frame(spark, rows)
    order = Window.partitionBy("task", "words").orderBy("key")
    table.withColumn("n", F.row_number().over(order)).filter("n <= 5").explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


def test_queries_of_most_buckets_are_searched_once(spark, monkeypatch):
    asked, layout = [], similarity._layout

    def noted(queries, candidates, by, *cut):
        if "_bucket" in by:
            asked.append(queries.count())
        return layout(queries, candidates, by, *cut)

    rng = random.Random(7)
    # A third of the rows has nearly all bits set, so these share most bands; some keys repeat with other bits.
    rows = [(i, "a", [b for b in range(166) if rng.random() < (0.95 if i % 3 == 0 else 0.4)]) for i in range(400)]
    rows += [(i, "a", [b for b in range(166) if rng.random() < 0.95]) for i in range(0, 30, 3)]
    table = frame(spark, rows)
    monkeypatch.setattr(similarity, "SMALL_BUCKET", 8)
    monkeypatch.setattr(similarity, "_layout", noted)
    want = similarity.nearest_lsh(table, None, 4, small_rows=0)
    want, in_buckets = found(want), asked[-1]
    monkeypatch.setattr(similarity, "WIDE_ROWS", 0)
    got = similarity.nearest_lsh(table, None, 4, small_rows=0)
    assert found(got) == want
    assert asked[-1] < in_buckets / 2


@pytest.mark.parametrize("n_bits", [166, 60, 8])
def test_first_places_by_bytes(n_bits):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    on = rng.random((300, n_bits)) < rng.random((300, 1))
    on[0] = False
    words = np.zeros((300, 24), np.uint8)
    packed = np.packbits(on, axis=1, bitorder="little")
    words[:, :packed.shape[1]] = packed
    fp = pa.array([r.astype(">u4").tobytes() for r in words.view("<u4")], pa.binary())
    orders = similarity.bit_orders(n_bits, 12)
    table = similarity._first_places(orders)
    want = np.stack([np.where(on, order, n_bits).min(axis=1) for order in orders], axis=1)
    assert (similarity._min_places(fp, orders, table) == want).all() and (similarity._min_places(fp, orders, None) == want).all()


def test_three_counts_of_one_product():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << 32, (41, 7), dtype=np.uint64).astype(np.uint32)
    bits[:9] = 0xFFFFFFFF
    real = np.arange(60) % 4 < 3
    spread = np.zeros((60, 7), np.uint32)
    spread[np.flatnonzero(real)[:41]] = bits
    real[np.flatnonzero(real)[41:]] = False
    used = np.arange(224)
    counts = similarity._common_packed(similarity._unpacked(bits).astype(np.float32), similarity._three_a_column(spread, real, used))
    assert (counts[:, real] == similarity._common(bits.T.copy(), bits.T.copy())).all()
    assert (counts[:, ~real] == 0).all()


def test_few_queries_equal_the_block_search(spark):
    rows = make_rows()
    table = frame(spark, rows)
    few = table.filter("key < 300")
    for k in (1, 5, 400):
        want = similarity.nearest(few.select("key", "words"), table.select("key", "words"), k)
        got = similarity.nearest_few(few, table.repartition(3), k)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert similarity.nearest_few(few, table, 2, max_queries=3).count() == similarity.nearest_few(few, table, 2).count()
    assert similarity.nearest_few(few.limit(0), table, 2).count() == 0


def test_blocks_of_a_long_table_are_a_share_of_it(spark):
    """Twenty times the rows are sent to no more blocks."""
    def sent(n):
        side = spark.range(n).select(F.lit(0).alias("_all"), (F.col("id") % 166 + 1).cast("int").alias("pc"))
        row = similarity._layout(side, side, ["_all"], 8).head()
        return row["_q_parts"], sum(b["parts"] for b in row["_blocks"])

    (q_small, c_small), (q_large, c_large) = sent(2000), sent(40_000)
    assert q_large <= q_small <= similarity.BLOCK_PARTS and c_large <= c_small


def test_a_large_bucket_is_cut_into_few_blocks(spark, rows, monkeypatch):
    layouts, layout = [], similarity._layout

    def noted(queries, candidates, by, *cut):
        layouts.append((by, layout(queries, candidates, by, *cut)))
        return layouts[-1][1]

    monkeypatch.setattr(similarity, "SMALL_BUCKET", 2)
    monkeypatch.setattr(similarity, "_layout", noted)
    similarity.nearest_lsh(frame(spark, rows), None, 4, bands=4, rows=1, small_rows=0, block_rows=1).count()
    by, found = layouts[0]
    assert "_bucket" in by
    assert max(r["_q_parts"] for r in found.collect()) == similarity.BUCKET_PARTS < similarity.BLOCK_PARTS


@pytest.mark.parametrize("width, k, floor", [(192, 5, 0.0), (192, 3, 0.6), (2048, 4, 0.0), (2048, 6, 0.7)])
def test_block_search_over_many_tiles_and_slabs(monkeypatch, width, k, floor):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "TILE_ROWS", 16)
    monkeypatch.setattr(similarity, "SLAB_ROWS", 32)
    rng = np.random.default_rng(width + k)

    centres = rng.random((8, width)) < rng.uniform(0.03, 0.3, (8, 1))

    def side(n):
        on = centres[rng.integers(0, 8, n)] ^ (rng.random((n, width)) < rng.choice([0.0, 0.002, 0.05], (n, 1)))
        on[:, 0] = True
        prints = pa.array([row.tobytes() for row in np.packbits(on, axis=1)], pa.binary())
        return on, pa.table({"fp": prints, "pc": on.sum(axis=1), "floor": np.full(n, floor)})

    (q, queries), (c, candidates) = side(50), side(300)
    times = rng.integers(1, 4, len(c))
    keys = rng.permutation(times.sum())
    members = [sorted(part.tolist()) for part in np.split(keys, np.cumsum(times)[:-1])]
    row, dist, key = similarity._block_search(k)(queries, candidates, pa.array(members, pa.list_(pa.int64())))
    want = set()
    for i, bits in enumerate(q):
        both = (bits & c).sum(axis=1)
        similar = both / (bits.sum() + c.sum(axis=1) - both)
        near = sorted((1.0 - s, m) for s, some in zip(similar, members) if s >= floor for m in some)
        want |= {(i, m, round(d, 12)) for d, m in near[:k]}
    assert set(zip(row.tolist(), key.tolist(), np.round(dist, 12).tolist())) == want and want


def test_long_lists_of_rare_bits_repeat_no_row(spark, rows, monkeypatch):
    """Where bits have long lists, rows are not listed under each of them."""
    monkeypatch.setattr(similarity, "LONG_LIST", 2)
    monkeypatch.setattr(similarity, "_bucket_search", lambda *_: pytest.fail("rows were listed under their bits"))
    got = similarity.nearest_within(frame(spark, rows), None, 6, 0.8, n_bits=192, block_rows=16)
    assert found(got) == brute(rows, rows, 6, False, True, 0.8)


def test_self_recall_query_searches_the_whole_table(spark, tmp_path, monkeypatch):
    from shotweave.workloads import QUERIES, SQL

    spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d e"), (4, "")], "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    floors, search = [], similarity.nearest

    def noted(queries, candidates, k, by=(), min_similarity=0.0):
        floors.append(min_similarity)
        return search(queries, candidates, k, by, min_similarity)

    monkeypatch.setattr(similarity, "nearest", noted)
    got = QUERIES["self_recall"](spark, str(tmp_path)).head()
    assert floors == [0.0] and got.asDict() == {"queries": 3, "recall": pytest.approx(2 / 3), "same": 1.0}
    assert "1.0::DOUBLE AS same" not in SQL["self_recall"]


def found_by_task(df):
    return {(r["query_id"], r["task"], r["rank"], r["key"], round(r["distance"], 12)) for r in df.collect()}


@pytest.mark.parametrize("repeated", [False, True])
def test_tasks_of_the_same_entities_share_a_search(spark, repeated):
    from shotweave.plans import kshot

    asked = []

    def search(queries, candidates, k, by=()):
        asked.append((list(by), queries.count()))
        return similarity.nearest(queries, candidates, k, by=by, block_rows=16)

    entities = [(key, bits) for key, _, bits in make_rows(150, 3)]
    # A third has one fingerprint; most of these have no label in the second task, so some lists come out short there.
    rows = [(key, task, bits) for key, bits in entities for task in ("a", "b") if task == "a" or bits != entities[0][1] or key % 4 == 0]
    assert 1.5 * len(entities) < len(rows) < 2 * len(entities)
    rows += rows[:1] if repeated else []
    table = frame(spark, rows)
    got = found_by_task(kshot._nearest_of_task(table, 4, search))
    assert got == found_by_task(similarity.nearest(table, None, 4, by=["task"], block_rows=16))
    if repeated:
        assert asked == [(["task"], len(rows))]
    else:
        assert {r[:1] + r[2:] for r in got} == brute(rows, rows, 4, True, True)
        assert [by for by, _ in asked] == [[], ["task"]] and asked[0][1] == len(entities) and 0 < asked[1][1] < len(entities)


def test_tasks_of_other_entities_are_searched_alone(spark, rows):
    from shotweave.plans import kshot

    got = kshot._nearest_of_task(frame(spark, rows), 5, lambda q, c, k, by: similarity.nearest(q, c, k, by=by, block_rows=16))
    assert found(got) == brute(rows, rows, 5, True, True)
