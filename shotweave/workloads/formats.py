"""Round trips: each query writes rows through a sink and reads them again with the matching scan."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.functions import fingerprints as fpx
from shotweave.operators import similarity
from shotweave.session import ensure_checkpoint_dir
from shotweave.sources import readers, writers
from shotweave.workloads.registry import query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


LABELS = ("large", "cheap", "odd", "blank", "none")


def _benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts in the column order of a data set of five tasks: two other columns, five labels, the entity string."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    labels = [(size > 25).cast("int"), (price < 1000).cast("int"), size % 2, F.when(size > 5, 1), F.lit(None).cast("int")]
    return table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit('say "hi", '), "p_brand").alias("note"), *[c.alias(n) for c, n in zip(labels, LABELS)],
        F.concat("p_name", F.lit(', "x"')).alias("smiles"))


BENCHMARK_SQL = """SELECT p_name || ', "x"' AS smiles, (p_size > 25)::INT::DOUBLE AS large, (p_retailprice < 1000)::INT::DOUBLE AS cheap,
  (p_size % 2)::DOUBLE AS odd, CASE WHEN p_size > 5 THEN 1.0::DOUBLE END AS blank, NULL::DOUBLE AS none FROM part"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("smiles", *[F.col("y")[i].alias(name) for i, name in enumerate(LABELS)])


@query(BENCHMARK_SQL)
def csv_benchmark(spark, d):
    path = folder(spark, "csv")
    _benchmark_rows(spark, d).write.csv(path, header=True, quote='"', escape='"')
    return _flat(readers.benchmark_csv(spark, path, "cyp450"))


@query(f"SELECT upper(smiles) AS smiles, large, cheap, odd, blank, none FROM ({BENCHMARK_SQL}) WHERE large = 1")
def csv_benchmark_hooks(spark, d):
    """The same scan with a caller's row filter and row change."""
    path = folder(spark, "csv")
    _benchmark_rows(spark, d).write.csv(path, header=True, quote='"', escape='"')
    return _flat(readers.benchmark_csv(
        spark, path, "cyp450", pre_filter=lambda df: df.filter(F.col("y")[0] == 1),
        pre_transform=lambda df: df.withColumn("smiles", F.upper("smiles"))))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_type, p_size::VARCHAR AS p_size, p_retailprice AS price FROM part")
def csv_properties(spark, d):
    path = folder(spark, "csv")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    part.write.csv(path, header=True, quote='"', escape='"')
    return readers.property_csv(spark, path).select(
        "p_partkey", "p_name", "p_type", "p_size", F.col("p_retailprice").cast("double").alias("price"))


@query("SELECT s_suppkey AS task1, s_nationkey AS task2, s_acctbal AS score FROM supplier")
def tsv_edges(spark, d):
    path = folder(spark, "tsv")
    writers.tsv(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), path)
    return readers.tsv(spark, path, "task1 long, task2 int, score double")


@query("SELECT doc_id, text AS graph, lang, source AS assayid FROM documents")
def parquet_assays(spark, d):
    path = folder(spark, "parquet")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("graph"), "lang", F.col("source").alias("assayid"))
    writers.parquet(docs, path)
    return readers.parquet(spark, path, "doc_id", "graph", "lang", "assayid")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        (F.col("turn") % 3).cast("int").alias("shot"), F.col("role").alias("instruction"), F.col("text").alias("input"),
        F.col("conv_id").cast("string").alias("output"))


@query("SELECT (turn % 3)::INT AS shot, role AS instruction, text AS input, conv_id::VARCHAR AS output FROM conversations")
def jsonl_instructions(spark, d):
    path = folder(spark, "jsonl")
    writers.instructions(_turns(spark, d), path)
    return readers.instructions(spark, path).select("shot", "instruction", "input", "output")


@query("SELECT role AS instruction, text AS input, conv_id + 0.125::DOUBLE AS output FROM conversations")
def jsonl_numbers(spark, d):
    path = folder(spark, "jsonl")
    rows = _turns(spark, d).withColumn("output", (F.col("output").cast("long") + 0.125).cast("string"))
    writers.instructions(rows, path, (), numbers=True)
    return readers.jsonl(spark, path, "instruction string, input string, output double")


@query("SELECT l_linenumber::VARCHAR AS task, count(*)::VARCHAR AS rows, (max(l_quantity)::BIGINT)::VARCHAR AS score FROM lineitem GROUP BY l_linenumber")
def csv_scores(spark, d):
    path = folder(spark, "scores")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("task")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("l_quantity").cast("long").alias("score"))
    writers.scores(lines, path)
    return spark.read.csv(path, header=True)


def _byte_length(texts: pd.Series) -> pd.Series:
    """Stand-in for an outside encoder: the length of the text as packed bits."""
    return texts.map(lambda t: None if t is None else len(t.encode()).to_bytes(4 * fpx.KEYS_WORDS, "big"))


@query("SELECT doc_id AS key, strlen(text) AS last_word, bit_count(strlen(text)::BIGINT)::BIGINT AS popcount FROM documents")
def external_encoder(spark, d):
    prints = similarity.external_fingerprints(table(spark, d, "documents"), "doc_id", "text", _byte_length, fpx.KEYS_WORDS)
    return prints.select("key", F.col("words")[fpx.KEYS_WORDS - 1].alias("last_word"), F.col("popcount").cast("bigint").alias("popcount"))


TEMPLATE = ("Task {instruction} on {input}: ", "Task {instruction}: ", "Answer:")


@query("""
SELECT conv_id, turn, 'Task ' || role || CASE WHEN text IS NULL OR text = '' THEN '' ELSE ' on ' || text END || ': ' AS prompt FROM conversations""")
def template_file(spark, d):
    """Prompts from a template that is read from a file by its name."""
    path = folder(spark, "templates")
    row = spark.createDataFrame([TEMPLATE], "prompt_input string, prompt_no_input string, response_split string")
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/own.json")
    template = catalog.load_template(spark, "own", path)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", catalog.render(F.col("role"), F.col("text"), template=template).alias("prompt"))
