"""Ranks, running totals and salted joins against plain computations, with one key holding most rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shotweave.plans import ranking, skew
from shotweave.session import ensure_checkpoint_dir


def md5(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, "hot" if i % 3 else rng.choice(["a", "b", None])) for i in range(3000)]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_hash_rank(spark, rows, by):
    df = spark.createDataFrame(rows, "id bigint, g string")
    got = {r["id"]: (r["rank"], r["total"]) for r in ranking.hash_rank(df, ["id"], 9, by=by).collect()}
    groups = defaultdict(list)
    for i, g in rows:
        groups[g if by else 0].append(i)
    want = {i: (n + 1, len(ids)) for ids in groups.values() for n, i in enumerate(sorted(ids, key=lambda i: md5(9, i)))}
    assert got == want


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "cold", i, rng.randrange(10)) for i in rng.sample(range(10**6), 2000)]
    df = spark.createDataFrame(rows, "g string, x bigint, v bigint")
    got = {(r["g"], r["x"]): r["s"] for r in ranking.running_totals(df, ["g"], ["x"], {"v": "s"}).collect()}
    want, sums = {}, defaultdict(int)
    for g, x, v in sorted(rows):
        sums[g] += v
        want[g, x] = sums[g]
    assert got == want


def test_dense_renumber(spark):
    df = spark.createDataFrame([(7,), (3,), (7,), (100,)], "k bigint")
    assert sorted(map(tuple, ranking.dense_renumber(df, "k", "n").collect())) == [(3, 0), (7, 1), (100, 2)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, rows, how):
    left = spark.createDataFrame(rows, "id bigint, g string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), ("z", 4)], "g string, v int")
    plain = left.join(right, ["g"], how)
    salted = skew.skew_join(left, right, ["g"], ["id"], how, min_rows=100).select(*plain.columns)
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
    assert sorted(map(repr, skew.skew_join(left, right, ["g"], how=how).select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    assert skew.hot_keys(left, ["g"], 1500).count() == 1


def test_hot_rows_are_spread(spark, rows):
    left = spark.createDataFrame(rows, "id bigint, g string").filter("g = 'hot'")
    right = spark.createDataFrame([("hot", 1)], "g string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.skew_join(left, right, ["g"], ["id"], min_rows=100)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)


def test_checkpoint_dir_is_kept(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == first


def test_a_text_goes_to_the_parts_that_show_it_only(spark, monkeypatch):
    from shotweave.operators import prompts
    from shotweave.plans import kshot

    monkeypatch.setattr(kshot, "PART_ROWS", 8)
    monkeypatch.setattr(kshot, "PART_BYTES", 64)
    rng = random.Random(5)
    # One text is repeated, one is null, one query and one neighbour have none, and one query is asked twice.
    texts = [(i, f"text {i} " + "x" * rng.randrange(30)) for i in range(60) if i not in (7, 9)] + [(3, "again"), (61, None), (None, "none")]
    rows = [(i, task, rng.choice(["Yes", "No", None])) for i in range(62) for task in ("a", "b")] + [(5, "a", "No"), (None, "a", "No")]
    found = [(i, task, rank, rng.choice([3, 9, 61, *range(60)]), 0.5) for i in range(50) for task in ("a", "b") for rank in (1, 2, 3)]
    entities = spark.createDataFrame(texts, "key long, smiles string")
    asked = spark.createDataFrame(rows, "key long, task string, label string").repartition(3)
    near = spark.createDataFrame(found, "query_id long, task string, rank int, key long, distance double").repartition(3)
    inst = spark.createDataFrame([("a", "One. Two"), ("b", "Three")], "task string, instruction string")
    subject = prompts.train_subject(F.col("task"))
    made = kshot._assemble(entities, asked, asked, inst, near, (1, 2, 3), subject, {})
    # Before, every neighbour's text was gathered by query and task.
    assert "collect_list" not in made._jdf.queryExecution().toString()
    payload = near.join(asked.select("key", "task", F.col("label").alias("n_label")), ["key", "task"]).join(
        entities.withColumnRenamed("smiles", "n_smiles"), "key")
    queries = asked.join(entities, "key").join(inst, "task").withColumnRenamed("key", "query_id")
    want = prompts.kshot_rows(queries, payload, ["query_id", "task"], (1, 2, 3), subject)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.select(made.columns).collect()))
