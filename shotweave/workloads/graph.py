"""Bipartite graph of parts and suppliers, and edges between customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators import graph
from shotweave.workloads.registry import query, table

# Thresholds that cascade over several rounds on the stand-in tables.
THRESHOLD, POS_NEG, PASSES = 10, 150, 12


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Label matrix part by supplier: returned lines count for, accepted lines against, others are not measured."""
    sign = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    summed = table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("mol_id"), F.col("l_suppkey").alias("task_id")).agg(F.sum(sign).alias("_s"))
    return summed.select("mol_id", "task_id", F.signum(F.col("_s").cast("double")).cast("int").alias("label")).filter("label <> 0")


CELLS_SQL = """
cells AS (
  SELECT l_partkey AS mol_id, l_suppkey AS task_id,
         sign(sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END))::INT AS label
  FROM lineitem GROUP BY ALL HAVING sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END) <> 0)"""


@query("WITH" + CELLS_SQL + """
SELECT 'mol' AS side, mol_id AS id, count(*) AS degree, count(*) FILTER (label > 0) AS positive, count(*) FILTER (label < 0) AS negative
FROM cells GROUP BY mol_id
UNION ALL SELECT 'task', task_id, count(*), count(*) FILTER (label > 0), count(*) FILTER (label < 0) FROM cells GROUP BY task_id""")
def degrees(spark, d):
    c = cells(spark, d)
    sides = [graph.degrees(c, node).select(F.lit(side).alias("side"), F.col(node).alias("id"), "degree", "positive", "negative")
             for side, node in (("mol", "mol_id"), ("task", "task_id"))]
    return sides[0].unionByName(sides[1])


def _core_sql() -> str:
    steps, last = [CELLS_SQL], "cells"
    for i in range(PASSES):
        steps.append(f"""
m{i} AS MATERIALIZED (SELECT * FROM {last} WHERE mol_id IN (SELECT mol_id FROM {last} GROUP BY mol_id HAVING count(*) >= {THRESHOLD})),
t{i} AS MATERIALIZED (SELECT * FROM m{i} WHERE task_id IN (SELECT task_id FROM m{i} GROUP BY task_id
  HAVING count(*) >= {THRESHOLD} AND count(*) FILTER (label > 0) >= {POS_NEG} AND count(*) FILTER (label < 0) >= {POS_NEG}))""")
        last = f"t{i}"
    return "WITH" + ",".join(steps) + f" SELECT mol_id, task_id, label FROM {last}"


@query(_core_sql())
def bipartite_core(spark, d):
    return graph.dense_core(cells(spark, d), threshold=THRESHOLD, threshold_pos_neg=POS_NEG)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("task1"))
    return lines.join(orders, "l_orderkey").select(
        "task1", F.col("l_suppkey").alias("task2"), F.col("l_extendedprice").alias("score"))


EDGES_SQL = """
edges AS (SELECT o_custkey AS task1, l_suppkey AS task2, l_extendedprice AS score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("task_id"), "c_name")


@query("WITH" + EDGES_SQL + """
SELECT c_custkey AS task_id, c_name FROM customer WHERE c_acctbal > 0
  AND c_custkey IN (SELECT task1 FROM edges UNION SELECT task2 FROM edges)""")
def tasks_in_graph(spark, d):
    return graph.tasks_in_graph(_tasks(spark, d), _edges(spark, d))


@query("WITH" + EDGES_SQL + """,
kept AS (SELECT c_custkey AS old_id, row_number() OVER (ORDER BY c_custkey) - 1 AS new_id FROM customer WHERE c_acctbal > 0)
SELECT a.new_id AS task1, b.new_id AS task2, score FROM edges JOIN kept a ON a.old_id = task1 JOIN kept b ON b.old_id = task2""")
def edges_renumber(spark, d):
    return graph.renumber_edges(_edges(spark, d), graph.renumber_tasks(_tasks(spark, d)))


@query("""
WITH pairs AS (SELECT o_custkey AS m1, l_suppkey AS m2, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT c_nationkey AS task1, s_nationkey AS task2, max(score) AS score
FROM pairs JOIN customer ON c_custkey = m1 JOIN supplier ON s_suppkey = m2 WHERE score > 0 GROUP BY ALL""")
def pair_max_score(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey")).alias("member2"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("score"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey")).alias("member1"))
    members = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("task"), F.concat(F.lit("c"), F.col("c_custkey")).alias("member")).unionByName(
        table(spark, d, "supplier").select(
            F.col("s_nationkey").alias("task"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("member")))
    scored = lines.join(orders, "l_orderkey")
    return graph.task_pair_scores(members, scored.select("member1", "member2", "score"))
