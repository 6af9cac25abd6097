"""Round trips through the file formats."""

import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.operators import splits
from shotweave.sources import readers, shards, writers


def test_benchmark_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('smiles,name,y1,z\nC(C),"a, b",1,\n"N,O",x,,2\n')
    got = readers.benchmark_csv(spark, str(tmp_path / "b.csv"), "bace").collect()
    assert [tuple(r) for r in got] == [("C(C)", [1.0]), ("N,O", [None])]
    lipo = tmp_path / "l.csv"
    lipo.write_text("id,exp,smiles\nA,3.5,CC\n")
    assert tuple(readers.benchmark_csv(spark, str(lipo), "lipo").head()) == ("CC", [3.5])


def test_prompt_catalog(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('// prompts\n{"assays": {"A1": ["x", "y"], /* none */ "A2": []}, "qm9": {"gap": ["z"]}}')
    got = sorted(map(tuple, readers.prompt_catalog(spark, str(path)).collect()))
    assert got == [("assays", "A1", 0, "x"), ("assays", "A1", 1, "y"), ("qm9", "gap", 0, "z")]
    path.write_text('{"bace": {"0": {"rewrite": ["r1", "r2"], "name": ["n"]}}}')
    got = sorted(map(tuple, readers.prompt_catalog(spark, str(path), augmented=True).collect()))
    assert got == [("bace", "0", "name", 0, "n"), ("bace", "0", "rewrite", 0, "r1"), ("bace", "0", "rewrite", 1, "r2")]


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5)], "task1 int, task2 int, score double")
    writers.tsv(df, str(tmp_path / "t"))
    assert readers.tsv(spark, str(tmp_path / "t"), "task1 int, task2 int, score double").collect() == df.collect()


def test_instructions(spark, tmp_path):
    rows = [(4, "bace", 0, "do é\n", "C", "Yes"), (8, "bace", 1, "do", "N", "No")]
    df = spark.createDataFrame(rows, "shot int, dataset string, task_id int, instruction string, input string, output string")
    writers.instructions(df, str(tmp_path / "i"))
    got = readers.instructions(spark, str(tmp_path / "i")).select(*df.columns)
    assert sorted(map(tuple, got.collect())) == rows
    line = next((tmp_path / "i" / "shot=4").rglob("*.json")).read_text().splitlines()[0]
    assert json.loads(line) == {"instruction": "do é\n", "input": "C", "output": "Yes"}


def test_parquet_replaces_only_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "assayid string, x int")
    path = str(tmp_path / "p")
    writers.parquet(df, path)
    writers.parquet(df.filter("assayid = 'a'").withColumn("x", F.lit(9)), path)
    assert sorted((r["assayid"], r["x"]) for r in readers.parquet(spark, path).collect()) == [("a", 9), ("b", 2)]
    assert readers.parquet(spark, path, "x").columns == ["x"]


def test_shards(spark, tmp_path):
    for name, start in (("0-3", 0), ("test_bace_3", 3)):
        rows = spark.createDataFrame([(f"s{start + i}",) for i in range(3)], "smiles string").coalesce(1)
        rows.write.parquet(str(tmp_path / "raw" / name))
        (tmp_path / "d").mkdir(exist_ok=True)
        part = next((tmp_path / "raw" / name).glob("part-*.parquet"))
        (tmp_path / "d" / f"{name}.parquet").write_bytes(part.read_bytes())
    got = sorted((r["key"], r["smiles"], r["shard"]) for r in readers.shards(spark, str(tmp_path / "d")).collect())
    assert got == [(i, f"s{i}", "0-3" if i < 3 else "test_bace_3") for i in range(6)]


def test_max_shards(spark, tmp_path):
    shards.write_shuffled(spark.range(100), "id", f"file://{tmp_path}/s", 30)
    names = [p.rsplit("/", 1)[1] for _, p in shards.listing(spark, str(tmp_path / "s"))]
    assert names == ["000-029.parquet", "030-059.parquet", "060-089.parquet", "090-099.parquet"]
    assert readers.shards(spark, str(tmp_path / "s"), max_shards=2).agg({"key": "max"}).head()[0] == 59
    assert [f for f, _ in shards.listing(spark, str(tmp_path / "s"), 3)] == [0, 30, 60]


def test_shuffled_files_hold_the_permutation(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").repartition(7)
    shards.write_shuffled(df, "doc_id", str(tmp_path / "s"), 64, seed=3)
    want = [r["doc_id"] for r in splits.shuffled(df, "doc_id", 3).collect()]
    rows = {r["key"]: r["doc_id"] for r in readers.shards(spark, str(tmp_path / "s")).collect()}
    assert [rows[i] for i in range(1000)] == want
    in_order = [x for _, p in shards.listing(spark, str(tmp_path / "s")) for x in pq.read_table(p.removeprefix("file:"))["doc_id"].to_pylist()]
    assert in_order == want
    shards.write_shuffled(df.limit(0), "doc_id", str(tmp_path / "none"))
    assert shards.listing(spark, str(tmp_path / "none")) == []


def test_only_needed_shards_are_read(spark, tmp_path, capsys):
    shards.write_shuffled(spark.range(100), "id", str(tmp_path / "s"), 10)
    keys = spark.createDataFrame([(5, "a"), (42, "b"), (42, "c"), (None, "d"), (-1, "e"), (1000, "f")], "key long, x string")
    got = shards.at_positions(spark, str(tmp_path / "s"), keys, "key", "id")
    rows = {r["key"]: r["id"] for r in readers.shards(spark, str(tmp_path / "s")).collect()}
    assert sorted((r["key"], r["x"], r["id"]) for r in got.collect()) == [(5, "a", rows[5]), (42, "b", rows[42]), (42, "c", rows[42])]
    assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {"000-009.parquet", "040-049.parquet", "090-099.parquet"}
    assert shards.at_positions(spark, str(tmp_path / "s"), keys.filter("key < 0"), "key", "id").count() == 0
    assert shards.at_positions(spark, str(tmp_path / "s"), keys, "key", "id", max_shards=1).count() == 1


def test_two_creators_at_once(spark, tmp_path):
    started, made = threading.Barrier(2, timeout=60), []

    def creator(number):
        def create():
            started.wait()
            made.append(number)
            return spark.range(50).selectExpr("id", f"{number} AS maker")

        return {tuple(r) for r in writers.load_or_create(spark, str(tmp_path / "split"), create).collect()}

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(creator, (1, 2))
    assert sorted(made) == [1, 2]
    assert one == two and len(one) == 50 and len({m for _, m in one}) == 1
    assert [p.name for p in tmp_path.iterdir()] == ["split"]


def test_fingerprints_and_scores(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, 1, 5), ("d", 0, 2, 3)], "dataset string, task_id int, key bigint, popcount int")
    writers.fingerprints(df, str(tmp_path / "f"))
    back = readers.parquet(spark, str(tmp_path / "f"))
    assert sorted(r["key"] for r in back.filter("dataset = 'd' and popcount < 4").collect()) == [2]
    writers.scores(spark.createDataFrame([("bace", 0.5)], "dataset string, score double"), str(tmp_path / "s"))
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "dataset,score\nbace,0.5\n"


def test_load_or_create(spark, tmp_path):
    calls = []

    def create():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.load_or_create(spark, str(tmp_path / "split"), create).count() == 3
    assert len(calls) == 1
    (tmp_path / "half" / "_temporary").mkdir(parents=True)
    assert writers.load_or_create(spark, str(tmp_path / "half"), create).count() == 3


def test_regression_outputs_are_json_numbers(spark, tmp_path):
    df = spark.createDataFrame([("do", "C", "-0.845"), ("do", "D", "12345678.0")], "instruction string, input string, output string")
    writers.instructions(df, str(tmp_path / "r"), (), numbers=True)
    lines = [json.loads(x) for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["output"] for x in lines) == [-0.845, 12345678.0]


def test_property_csv_and_catalogue(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,graph,mw\nM1,"C,C",12.5\nM2,N,[]\n')
    assert [tuple(r) for r in readers.property_csv(spark, str(tmp_path / "m.csv")).collect()] == [
        ("M1", "C,C", "12.5"), ("M2", "N", "[]")]
    assert catalog.datasets(spark).filter("kind = 'reg'").count() == 3
