"""Golden instruction rows, k-shot prompts, metrics and graph operators."""

import random

import pytest
from pyspark.sql import functions as F

from shotweave.operators import graph, melt, metrics, prompts, rows

LEAD = "Here are some examples about molecular property.\n"


def ex(s, l):
    return f"SMILES: {s}\nlabel: {l}\n"


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(1, "Is it?", "Q", "1.0"), (2, "Look. Is it?", "R", "0.0")], "id bigint, instruction string, smiles string, label string")


@pytest.fixture(scope="module")
def near(spark):
    labels = ["1.0", "-100", "0.0", "0.0"]
    return spark.createDataFrame([(1, r + 1, f"n{r + 1}", l) for r, l in enumerate(labels)],
                                 "id bigint, rank int, n_smiles string, n_label string")


def got(df):
    return {(r["id"], r["shot"]): r["instruction"] for r in df.collect()}


def test_near_first_consumes_slots(asked, near):
    out = got(prompts.kshot_rows(asked, near, ["id"], (1, 2, 3), prompts.test_subject(), yes_no=True))
    assert out[1, 1] == LEAD + ex("n1", "Yes") + "Is it?"
    assert out[1, 2] == out[1, 1]
    assert out[1, 3] == LEAD + ex("n1", "Yes") + ex("n3", "No") + "Is it?"
    assert out[2, 3] == "Look. Here are some examples.\nIs it?"


def test_far_first(asked, near):
    out = got(prompts.kshot_rows(asked, near, ["id"], (2, 4), prompts.test_subject(), yes_no=True, far_first=True))
    assert out[1, 4] == LEAD + ex("n4", "No") + ex("n3", "No") + ex("n1", "Yes") + "Is it?"


def test_raw_labels_and_train_subject(asked, near):
    out = got(prompts.kshot_rows(asked, near, ["id"], (2,), prompts.train_subject(F.lit("A7"))))
    assert out[1, 2] == "Here are some examples about molecule A7.\n" + ex("n1", "1.0") + ex("n2", "-100") + "Is it?"


def test_balanced(spark, asked):
    ranked = spark.createDataFrame([(1, r + 1, f"n{r + 1}", l) for r, l in enumerate(["0.0", "0.0", "0.0", "1.0", "1.0"])],
                                   "id bigint, rank int, n_smiles string, n_label string")
    out = got(prompts.balanced_rows(asked, ranked, ["id"], prompts.test_subject()))
    assert out[1, 4] == LEAD + ex("n4", "Yes") + ex("n5", "Yes") + ex("n1", "No") + ex("n2", "No") + "Is it?"
    assert out[1, 2] == LEAD + ex("n4", "Yes") + ex("n1", "No") + "Is it?"
    assert out[1, 8] == LEAD + ex("n4", "Yes") + ex("n5", "Yes") + ex("n1", "No") + ex("n2", "No") + ex("n3", "No") + "Is it?"


def test_column_kinds(spark):
    df = spark.createDataFrame([("1", "1.5", "x", None, 2.0, 3), ("2.0", "2", "7", None, 4.0, 1)],
                               "a string, b string, c string, d string, e double, f int")
    assert {r["key"]: r["kind"] for r in melt.column_kinds(df, df.columns).collect()} == {
        "a": "int", "b": "float", "c": "str", "d": "int", "e": "int", "f": "int"}


def test_empty_list_and_null_are_missing(spark):
    df = spark.createDataFrame([(1, "[]", None), (2, "3", "x")], "id int, a string, b string")
    assert melt.melt_properties(df, ["id"], ["a", "b"]).count() == 2


def test_prompt_selection(spark):
    table = spark.createDataFrame(
        [("c", "t", "rewrite", 1, "b"), ("c", "t", "rewrite", 0, "a"), ("c", "t", "shorten", 0, "s"), ("d", "t", "rewrite", 0, "x")],
        "corpus string, task string, aug string, variant_no int, text string")
    assert [tuple(r) for r in rows.prompt_lists(table, "c", "rewrite").collect()] == [("t", ["a", "b"])]
    first = rows.first_prompts(table.filter("aug = 'rewrite'"))
    assert sorted(map(tuple, first.collect())) == [("c", "t", "a"), ("d", "t", "x")]


def test_negation_needs_a_negative_prompt(spark):
    table = spark.createDataFrame([(i, f"s{i}", i, "Y") for i in range(40)], "id bigint, smiles string, size int, flag string")
    lists = spark.createDataFrame([("size", ["p"]), ("size_negative", ["n"]), ("flag", ["f"])], "task string, variants array<string>")
    made = rows.property_rows(table, "id", "smiles", ["size", "flag"], lists, negation=0.5).collect()
    assert len(made) == 80
    assert {r["assayid"] for r in made} == {"size", "size_negative", "flag"}
    for r in made:
        if r["assayid"] == "size_negative":
            assert int(r["label"]) == -int(r["chemid"]) and r["text"] == "n"


def test_end_token_after_prompt(spark):
    df = spark.createDataFrame([("a b", "", "c")], "instruction string, input string, output string")
    plain = rows.tokenized_rows(df, end="E").head()
    closed = rows.tokenized_rows(df, end="E", end_after_prompt=True).head()
    assert plain["prompt_length"] == closed["prompt_length"]
    assert plain["labels"][-2:] == ["c", "E"] and set(plain["labels"][:-2]) == {"-100"}
    assert rows.tokenized_rows(df, end="E", train_on_inputs=True).head()["labels"] == plain["tokens"]
    assert len(rows.tokenized_rows(df, max_tokens=3, end="E").head()["tokens"]) == 3


def test_accuracy_examples(spark):
    pairs = list(zip([0, 1, 1, 2, 1, 0], [0, 1, 2, 0, 1, 2], [0.5, 2, 0.7, 0.5, 9, 0.4]))
    df = spark.createDataFrame([(p, r, float(w)) for p, r, w in pairs], "p int, r int, w double")
    plain = metrics.accuracy(df, [], "p", "r").head()
    assert (plain["accuracy"], plain["correct"]) == (0.5, 3.0)
    assert metrics.accuracy(df, [], "p", "r", "w").head()["accuracy"] == pytest.approx(0.8778625954198473)


def test_roc_auc(spark):
    rng = random.Random(0)
    data = [("hot" if i % 3 else "cold", rng.choice([0, 1, 1, -100]), float(rng.randrange(20))) for i in range(900)]
    data += [("one", 1, 0.5), ("one", 1, 0.7)]
    out = {r["t"]: r for r in metrics.roc_auc(spark.createDataFrame(data, "t string, y int, score double"), ["t"]).collect()}
    for task in ("hot", "cold"):
        pos = [s for t, y, s in data if t == task and y == 1]
        neg = [s for t, y, s in data if t == task and y == 0]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        assert out[task]["auc"] == pytest.approx(want) and out[task]["scorable"]
    assert out["one"]["auc"] == 0 and not out["one"]["scorable"]


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 5.0), (9.0, None)], "y double, p double")
    r = metrics.regression(df, []).head()
    assert r["residual_std"] == pytest.approx(0.0, abs=1e-12) and r["rmse"] == pytest.approx(1.0)
    assert r["parse_ratio"] == 0.75 and r["correlation"] == pytest.approx(1.0)
    assert r["r2"] == pytest.approx(1 - 3 / 4.666666666666667)
    flat = metrics.regression(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double"), []).head()
    assert flat["r2"] is None and flat["correlation"] is None


def test_perplexity_overflow(spark):
    df = spark.createDataFrame([(0.0,), (5000.0,)], "loss double")
    assert metrics.perplexity(df, [], "loss").head()[0] == float("inf")


def test_shifted_accuracy(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 5, -100]), ([1], [1])], "p array<int>, l array<int>")
    r = metrics.shifted_accuracy(df, [], "p", "l").head()
    assert (r["tokens"], r["accuracy"]) == (2, 0.5)


def test_dense_core(spark):
    rng = random.Random(4)
    cells = {(m, t): rng.choice([1, -1]) for m in range(40) for t in range(12) if rng.random() < (0.7 if m % 2 and t % 4 else 0.25)}
    df = spark.createDataFrame([(m, t, l) for (m, t), l in cells.items()], "mol_id bigint, task_id bigint, label int")
    core = dict(cells)
    while True:
        before = len(core)
        mols = {m for m, _ in core if sum(k[0] == m for k in core) >= 5}
        core = {k: v for k, v in core.items() if k[0] in mols}
        tasks = {t for _, t in core if all(sum(k[1] == t and v * s > 0 for k, v in core.items()) >= 4 for s in (1, -1))}
        core = {k: v for k, v in core.items() if k[1] in tasks}
        if len(core) == before:
            break
    got = graph.dense_core(df, threshold=5, threshold_pos_neg=4)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == core and core
    assert graph.dense_core(got, threshold=5, threshold_pos_neg=4).count() == len(core)
    assert graph.dense_core(df, threshold=100).count() == 0


def test_auc_of_a_hot_group_over_many_pieces(spark):
    import random

    from shotweave.operators import metrics
    rng = random.Random(3)
    rows = [("hot" if i % 5 else None, rng.randrange(400), int(rng.random() < 0.4)) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "task string, score int, y int")
        got = {r["task"]: r["auc"] for r in metrics.roc_auc(df, ["task"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for task in ("hot", None):
        mine = [(s, y) for t, s, y in rows if t == task]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert abs(got[task] - wins / len(pos) / len(neg)) < 1e-12
