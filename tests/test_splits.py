"""Split rules against their sequential statement."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from shotweave.operators import checks, splits


def table(spark, sizes, nulls=False):
    rows = [(g, i) for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    random.Random(len(rows)).shuffle(rows)
    rows = [(None if nulls and g == 0 else f"g{g}", i) for i, (g, _) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "g string, id bigint")


def groups_of(rows):
    groups = defaultdict(list)
    for g, i in rows:
        groups[g].append(i)
    return groups


def largest_first(rows):
    groups, n, out = groups_of(rows), len(rows), {}
    train = valid = 0
    for g, ids in sorted(groups.items(), key=lambda x: (len(x[1]), min(x[1])), reverse=True):
        if train + len(ids) <= 0.8 * n:
            out[g], train = "train", train + len(ids)
        elif train + valid + len(ids) <= (0.8 + 0.1) * n:
            out[g], valid = "valid", valid + len(ids)
        else:
            out[g] = "test"
    return out


def first_fit(rows, seed):
    groups, n, out = groups_of(rows), len(rows), {}
    room = {"valid": math.floor(0.1 * n), "test": math.floor(0.1 * n)}
    for g in sorted(groups, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), min(groups[g]))):
        part = next((p for p in ("valid", "test") if len(groups[g]) <= room[p]), "train")
        out[g] = part
        if part in room:
            room[part] -= len(groups[g])
    return out


def got_by_group(df):
    found = defaultdict(set)
    for r in df.collect():
        found[r["g"]].add(r["split"])
    assert all(len(v) == 1 for v in found.values())
    return {g: next(iter(v)) for g, v in found.items()}


SIZES = [[5, 3, 1, 1], [400, 100, 50, 50] + [3] * 60 + [1] * 200, list(range(1, 30)), [7] * 40, [1] * 33]


@pytest.mark.parametrize("sizes", SIZES)
def test_greedy(spark, sizes):
    rows, df = table(spark, sizes)
    assert got_by_group(splits.greedy_group_split(df, ["g"], "id")) == largest_first(rows)


def test_greedy_example(spark):
    rows, df = table(spark, [5, 3, 1, 1])
    assert Counter(r["split"] for r in splits.greedy_group_split(df, ["g"], "id").collect()) == {"train": 8, "valid": 1, "test": 1}


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("seed", [0, 1])
def test_random_groups(spark, sizes, seed):
    rows, df = table(spark, sizes)
    assert got_by_group(splits.random_group_split(df, ["g"], "id", seed=seed)) == first_fit(rows, seed)


def test_null_group_is_kept(spark):
    rows, df = table(spark, [30, 20, 5, 5], nulls=True)
    assert splits.greedy_group_split(df, ["g"], "id").count() == len(rows)
    assert splits.random_group_split(df, ["g"], "id").count() == len(rows)


def test_row_split_sizes_and_checks(spark):
    df = spark.range(107).withColumnRenamed("id", "id")
    split = splits.random_split(df, "id")
    assert Counter(r["split"] for r in split.collect()) == {"train": 85, "valid": 10, "test": 12}
    assert tuple(checks.split_checks(df, split, "id").head()) == (107, 0, 0)
    doubled = split.union(split.limit(3)).filter("id <> 5")
    report = checks.split_checks(df, doubled, "id").head()
    assert report["missing"] == 1 and report["overlapping"] >= 2


def test_fractions_must_add_up(spark):
    with pytest.raises(ValueError):
        splits.random_split(spark.range(3), "id", fractions=(0.8, 0.1, 0.2))


def test_mixes(spark):
    df = spark.range(17).selectExpr("id", "'t' AS task")
    shots = Counter(r["shot"] for r in splits.mix_01234(df, ["id"], ["task"]).collect())
    assert shots == {0: 10, 1: 1, 2: 1, 3: 1, 4: 4}
    dropped = Counter(r["shot"] for r in splits.mix_01234(df, ["id"], ["task"], drop_rest=True).collect())
    assert dropped == {0: 10, 1: 1, 2: 1, 3: 1, 4: 1}
    five = spark.range(5).selectExpr("id", "'t' AS task")
    assert Counter(r["shot"] for r in splits.mix_0_4(five, ["id"], ["task"]).collect()) == {0: 2, 4: 3}
    rows = five.selectExpr("id", "task", "explode(array(0, 4)) AS shot", "'x' AS instruction")
    assert splits.pick_shots(splits.mix_0_4(five, ["id"], ["task"]), rows, ["id", "task"]).count() == 5


def test_folds_are_even(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS y")
    folded = splits.stratified_folds(df, "id", "y")
    per = Counter((r["y"], r["fold"]) for r in folded.collect())
    assert all(abs(per[y, f] - per[y, g]) <= 1 for y in range(3) for f in range(10) for g in range(10))
    assert splits.fold_split(folded, 3).filter("split = 'valid'").count() == sum(per[y, 3] for y in range(3))


def test_overlap_and_shuffle(spark):
    df = spark.range(10)
    assert splits.id_split(df, "id", overlap=True).count() == 20
    assert sorted(r["pos"] for r in splits.shuffle_positions(df, "id").collect()) == list(range(10))
    order = [r["id"] for r in splits.shuffled(df, "id", 4).collect()]
    assert order == sorted(range(10), key=lambda i: hashlib.md5(f"4:{i}".encode()).hexdigest())


def test_same_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, s string")
    assert tuple(checks.same_rows(a, b, ["id", "s"]).head()) == (1, 1)
    assert tuple(checks.violations(a, positive=a["id"] > 1).head()) == (1,)
