"""Metrics on stand-in predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.functions import text as txt
from shotweave.operators import metrics
from shotweave.workloads.labelling import signed_labels
from shotweave.workloads.registry import query, table


@query("""
WITH p AS (SELECT task, (n_chars > 1500)::INT AS pred, y, n_chars AS w FROM documents JOIN (
  SELECT doc_id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) USING (doc_id))
SELECT task, 'plain' AS weights, avg((pred = y)::INT::DOUBLE) AS accuracy, sum((pred = y)::INT)::DOUBLE AS correct FROM p GROUP BY task
UNION ALL SELECT task, 'n_chars', sum(CASE WHEN pred = y THEN w ELSE 0 END)::DOUBLE / sum(w), sum(CASE WHEN pred = y THEN w ELSE 0 END)::DOUBLE FROM p GROUP BY task
""")
def metric_accuracy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    pairs = signed_labels(spark, d).join(docs, "doc_id").select(
        "task", "n_chars", ((F.col("label") + 1) / 2).cast("int").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("pred"))
    plain = metrics.accuracy(pairs, ["task"], "pred", "y").withColumn("weights", F.lit("plain"))
    return plain.unionByName(metrics.accuracy(pairs, ["task"], "pred", "y", "n_chars").withColumn("weights", F.lit("n_chars")))


@query("""
SELECT l_linenumber AS task, avg((CASE WHEN l_quantity > 25 THEN 'Yes' ELSE 'No' END = CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END)::INT::DOUBLE) AS accuracy
FROM lineitem GROUP BY l_linenumber""")
def metric_text_accuracy(spark, d):
    answers = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("task"),
        F.when(F.col("l_quantity") > 25, "Yes").otherwise("No").alias("answer"),
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("label"))
    return metrics.text_accuracy(answers, ["task"], "answer", "label")


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as tasks; task 7 has only positives, and unreturned lines are not measured."""
    y = (F.when(F.col("l_returnflag") == "N", -100).when(F.col("l_linenumber") == 7, 1)
         .when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("dataset"), F.col("l_linenumber").alias("task"), y.alias("y"), F.col("l_extendedprice").alias("score"))


AUC_SQL = """
WITH p AS (SELECT l_linestatus AS dataset, l_linenumber AS task, l_extendedprice AS score,
  CASE WHEN l_returnflag = 'N' THEN -100 WHEN l_linenumber = 7 THEN 1 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset, task, score) - 1) / 2.0::DOUBLE AS rk
  FROM p WHERE y >= 0 WINDOW w AS (PARTITION BY dataset, task ORDER BY score)),
s AS (SELECT dataset, task, count(*) AS rows, sum(y)::BIGINT AS positives, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY ALL),
a AS (SELECT dataset, task, rows, positives, positives > 0 AND positives < rows AS scorable,
  CASE WHEN positives > 0 AND positives < rows
    THEN (rs - positives * (positives + 1) / 2.0::DOUBLE) / (positives::DOUBLE * (rows - positives)) ELSE 0 END AS auc FROM s)
"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_predictions(spark, d), ["dataset", "task"]).withColumn("auc", F.round("auc", 9))


@query(AUC_SQL + "SELECT dataset, task, rows, positives, scorable, round(auc, 9) AS auc FROM a")
def metric_roc_auc(spark, d):
    return _scores(spark, d)


@query(AUC_SQL + """
SELECT dataset, count(*) AS tasks, round(avg((NOT scorable)::INT::DOUBLE), 9) AS missing_ratio,
       round(avg(round(auc, 9)) FILTER (scorable), 9) AS mean_auc FROM a GROUP BY dataset""")
def metric_missing_ratio(spark, d):
    return metrics.missing_ratio(_scores(spark, d), ["dataset"]).select(
        "dataset", "tasks", F.round("missing_ratio", 9).alias("missing_ratio"), F.round("mean_auc", 9).alias("mean_auc"))


@query("""
WITH p AS (SELECT l_returnflag AS task, l_extendedprice AS y,
  CASE WHEN l_discount = 0 THEN NULL ELSE (l_quantity * p_retailprice)::DECIMAL(18,2)::DOUBLE END AS p
  FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT * FROM p WHERE p IS NOT NULL),
m AS (SELECT task, avg(y) AS my FROM k GROUP BY task),
s AS (SELECT task, stddev_samp(y - p) AS residual_std, sqrt(avg((y - p) * (y - p))) AS rmse, corr(y, p) AS correlation,
  stddev_samp(y) AS baseline_std, 1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)) AS r2 FROM k JOIN m USING (task) GROUP BY task),
n AS (SELECT task, count(*) AS rows, avg((p IS NOT NULL)::INT::DOUBLE) AS parse_ratio FROM p GROUP BY task)
SELECT task, rows, round(parse_ratio, 6) AS parse_ratio, round(residual_std, 4) AS residual_std, round(rmse, 4) AS rmse,
  round(correlation, 6) AS correlation, round(baseline_std, 4) AS baseline_std, round(r2, 6) AS r2 FROM n JOIN s USING (task)
""")
def metric_regression(spark, d):
    price = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    number = (F.col("l_quantity") * F.col("p_retailprice")).cast("decimal(18,2)").cast("string")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    answers = lines.join(price, "l_partkey").select(
        F.col("l_returnflag").alias("task"), F.col("l_extendedprice").alias("y"),
        F.when(F.col("l_discount") == 0, "unknown").otherwise(F.concat(F.lit("about "), number, F.lit(" units"))).alias("text"))
    scored = metrics.regression(answers.withColumn("p", txt.first_number(F.col("text"))), ["task"])
    digits = {"parse_ratio": 6, "residual_std": 4, "rmse": 4, "correlation": 6, "baseline_std": 4, "r2": 6}
    return scored.select("task", "rows", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("""
WITH t AS (SELECT role, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS labels FROM conversations),
x AS (SELECT role, unnest(labels[2:]) AS label FROM t)
SELECT role, count(*) AS tokens, avg((lower(label) = label)::INT::DOUBLE) AS accuracy FROM x GROUP BY role
""")
def metric_shifted_accuracy(spark, d):
    labels = txt.words(F.col("text"))
    ahead = F.transform(F.slice(F.col("labels"), F.lit(2), F.size("labels")), lambda t: F.lower(t))
    rows = table(spark, d, "conversations").select("role", labels.alias("labels"))
    guessed = rows.filter(F.size("labels") > 0).withColumn("predictions", F.concat(ahead, F.array(F.lit(""))))
    return metrics.shifted_accuracy(guessed, ["role"], "predictions", "labels")


@query("SELECT event_type, round(exp(avg(value / 10)), 6) AS perplexity FROM events GROUP BY event_type")
def metric_perplexity(spark, d):
    losses = table(spark, d, "events").select("event_type", (F.col("value") / 10).alias("loss"))
    return metrics.perplexity(losses, ["event_type"], "loss").withColumn("perplexity", F.round("perplexity", 6))
