"""Splits, folds, mixes and previews."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.operators import checks, melt, splits
from shotweave.session import ensure_checkpoint_dir
from shotweave.sources import readers, shards
from shotweave.workloads.registry import query, table


def rank_sql(relation: str, key: str, seed: int, by: str = "") -> str:
    """Relation with ``r``, the position in hash order, and ``n``, the group size."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT *, row_number() OVER ({part} ORDER BY md5('{seed}:' || {key}), {key}) AS r,
  count(*) OVER ({part}) AS n FROM {relation})"""


def greedy_sql(rows: str, group: str, key: str, name: str = "assigned") -> str:
    """CTEs (to follow WITH RECURSIVE) that end in ``name(grp, split)``, the largest-first rule by distinct sizes."""
    train = "least(s.k, greatest(0, (m.tc - p.tr) // s.size))"
    valid = f"least(s.k - {train}, greatest(0, (m.vc - p.tr - {train} * s.size - p.va) // s.size))"
    return f"""
{name}_g AS (SELECT {group} AS grp, count(*) AS size, min({key}) AS first FROM {rows} GROUP BY 1),
{name}_m AS (SELECT floor(0.8::DOUBLE * count(*))::BIGINT AS tc, floor(0.9::DOUBLE * count(*))::BIGINT AS vc FROM {rows}),
{name}_s AS (SELECT size, count(*) AS k, row_number() OVER (ORDER BY size DESC) AS i FROM {name}_g GROUP BY size),
{name}_f AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS tr, 0::BIGINT AS va, 0::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b
  UNION ALL
  SELECT s.i, p.tr + {train} * s.size, p.va + {valid} * s.size, s.size, {train}, {valid}
  FROM {name}_f p JOIN {name}_s s ON s.i = p.i + 1, {name}_m m),
{name}_p AS (SELECT grp, size, row_number() OVER (PARTITION BY size ORDER BY first DESC) AS place FROM {name}_g),
{name} AS (
  SELECT grp, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'valid' ELSE 'test' END AS split
  FROM {name}_p JOIN {name}_f USING (size))"""


@query("WITH RECURSIVE" + greedy_sql("part", "p_brand || '|' || p_type", "p_partkey") + """
SELECT p_partkey, split FROM part JOIN assigned ON grp = p_brand || '|' || p_type""")
def split_group_greedy(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return splits.greedy_group_split(part, ["p_brand", "p_type"], "p_partkey").select("p_partkey", "split")


@query("WITH RECURSIVE kept AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N')," + greedy_sql(
    "kept", "l_partkey", "l_orderkey") + """
SELECT l_partkey, split, count(*) AS n FROM kept JOIN assigned ON grp = l_partkey GROUP BY ALL""")
def split_group_greedy_task(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("label"))
    measured = splits.drop_null_task(lines, "label")
    split = splits.greedy_group_split(measured, ["l_partkey"], "l_orderkey")
    return split.groupBy("l_partkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE g AS (
  SELECT *, row_number() OVER (ORDER BY md5('7:' || p_brand || ':' || p_type), first) AS i FROM (
    SELECT p_brand, p_type, count(*) AS size, min(p_partkey) AS first FROM part GROUP BY ALL)),
m AS (SELECT floor(0.1::DOUBLE * count(*))::BIGINT AS c FROM part),
f AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS va, 0::BIGINT AS te, '' AS split
  UNION ALL
  SELECT g.i, f.va + CASE WHEN f.va + g.size <= m.c THEN g.size ELSE 0 END,
    f.te + CASE WHEN f.va + g.size > m.c AND f.te + g.size <= m.c THEN g.size ELSE 0 END,
    CASE WHEN f.va + g.size <= m.c THEN 'valid' WHEN f.te + g.size <= m.c THEN 'test' ELSE 'train' END
  FROM f JOIN g ON g.i = f.i + 1, m)
SELECT p_partkey, split FROM part JOIN g USING (p_brand, p_type) JOIN f USING (i)
""")
def split_group_random(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return splits.random_group_split(part, ["p_brand", "p_type"], "p_partkey", seed=7).select("p_partkey", "split")


@query(f"""
SELECT o_orderkey, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train'
  WHEN r <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'valid' ELSE 'test' END AS split
FROM {rank_sql("orders", "o_orderkey", 0)}""")
def split_random(spark, d):
    return splits.random_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""SELECT c_custkey, c_mktsegment, ((r - 1) % 10)::INT AS fold, CASE WHEN (r - 1) % 10 = 0 THEN 'valid' ELSE 'train' END AS split
FROM {rank_sql("customer", "c_custkey", 0, "c_mktsegment")}""")
def split_stratified_kfold(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return splits.fold_split(splits.stratified_folds(customers, "c_custkey", "c_mktsegment"), 0)


@query(f"""
SELECT c_custkey, 'disjoint' AS mode, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'valid' END AS split
FROM {rank_sql("customer", "c_custkey", 3)}
UNION ALL SELECT c_custkey, 'overlap', s.split FROM customer, (VALUES ('train'), ('valid')) s(split)""")
def split_non_overlap(spark, d):
    ids = table(spark, d, "customer").select("c_custkey")
    apart = splits.id_split(ids, "c_custkey", seed=3)
    both = splits.id_split(ids, "c_custkey", overlap=True)
    return apart.select("c_custkey", F.lit("disjoint").alias("mode"), "split").unionByName(
        both.select("c_custkey", F.lit("overlap").alias("mode"), "split"))


@query("""
WITH wide AS (SELECT d.doc_id, coalesce(quality, -100) AS q, coalesce(toxic, -100) AS t FROM documents d LEFT JOIN labels USING (doc_id)),
n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, 0 AS task_id, q AS label, doc_id AS pos_id FROM wide
UNION ALL SELECT doc_id, 1, t, doc_id + n FROM wide, n
""")
def split_label_expand(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    wide = docs.join(table(spark, d, "labels"), "doc_id", "left")
    vector = wide.select("doc_id", F.array(*[F.coalesce(F.col(t), F.lit(-100)) for t in ("quality", "toxic")]).alias("y"))
    return melt.expand_tasks(vector, "doc_id", "y")


@query("""
WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (ORDER BY md5('0:' || p_partkey), p_partkey) AS r, count(*) OVER () AS n FROM part),
s AS (SELECT *, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train'
  WHEN r <= floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'valid' ELSE 'test' END AS split FROM r)
SELECT 'greedy' AS method, count(*) AS total, 0 AS missing, 0 AS overlapping, 0 AS leaking_groups FROM part
UNION ALL SELECT 'random', (SELECT count(*) FROM part), 0, 0,
  (SELECT count(*) FROM (SELECT p_brand, p_type FROM s GROUP BY ALL HAVING min(split) <> max(split)))
""")
def split_checks(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    group = ["p_brand", "p_type"]
    greedy = checks.split_checks(part, splits.greedy_group_split(part, group, "p_partkey"), "p_partkey", group)
    random = checks.split_checks(part, splits.random_split(part, "p_partkey"), "p_partkey", group)
    return greedy.withColumn("method", F.lit("greedy")).unionByName(random.withColumn("method", F.lit("random")))


def _task_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "value")


@query(f"""SELECT event_id, event_type, CASE WHEN r <= floor(n / 2) THEN 0 ELSE 4 END AS shot
FROM {rank_sql("events", "event_id", 5, "event_type")}""")
def mix_0_4(spark, d):
    return splits.mix_0_4(_task_rows(spark, d), ["event_id"], ["event_type"], seed=5).select("event_id", "event_type", "shot")


@query(f"""
WITH c AS (SELECT event_id, event_type, r, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.1::DOUBLE) AS b
  FROM {rank_sql("events", "event_id", 5, "event_type")})
SELECT event_id, event_type, CASE WHEN r <= a THEN 0 WHEN r <= a + b THEN 1 WHEN r <= a + 2 * b THEN 2
  WHEN r <= a + 3 * b THEN 3 ELSE 4 END AS shot FROM c""")
def mix_01234(spark, d):
    return splits.mix_01234(_task_rows(spark, d), ["event_id"], ["event_type"], seed=5).select("event_id", "event_type", "shot")


def _shot_tables(spark: SparkSession, d: str, shots: tuple[int, ...]) -> DataFrame:
    """The per-shot tables a mixture selects from: one table of prompt rows for each shot count."""
    rows = _task_rows(spark, d)
    return melt.union_all(*[rows.select("event_id", "event_type", F.lit(s).alias("shot"), F.concat_ws(
        " ", F.lit(f"{s} examples:"), "event_type", F.col("event_id").cast("string")).alias("input")) for s in shots])


@query(f"""SELECT event_id, event_type, shot, shot || ' examples: ' || event_type || ' ' || event_id AS input
FROM (SELECT event_id, event_type, CASE WHEN r <= floor(n / 2) THEN 0 ELSE 4 END AS shot FROM {rank_sql("events", "event_id", 5, "event_type")})""")
def mix_rows_0_4(spark, d):
    mix = splits.mix_0_4(_task_rows(spark, d), ["event_id"], ["event_type"], seed=5)
    return splits.pick_shots(mix, _shot_tables(spark, d, (0, 4)), ["event_id", "event_type"])


@query(f"""
WITH c AS (SELECT event_id, event_type, r, floor(n * 0.6::DOUBLE) AS a, floor(n * 0.1::DOUBLE) AS b
  FROM {rank_sql("events", "event_id", 5, "event_type")}),
m AS (SELECT event_id, event_type, CASE WHEN r <= a THEN 0 WHEN r <= a + b THEN 1 WHEN r <= a + 2 * b THEN 2
  WHEN r <= a + 3 * b THEN 3 ELSE 4 END AS shot FROM c)
SELECT *, shot || ' examples: ' || event_type || ' ' || event_id AS input FROM m""")
def mix_rows_01234(spark, d):
    mix = splits.mix_01234(_task_rows(spark, d), ["event_id"], ["event_type"], seed=5)
    return splits.pick_shots(mix, _shot_tables(spark, d, (0, 1, 2, 3, 4)), ["event_id", "event_type"])


@query(f"SELECT o_orderkey, r - 1 AS pos FROM {rank_sql('orders', 'o_orderkey', 42)}")
def shuffle_rows(spark, d):
    return splits.shuffle_positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=42)


SHARD_ROWS = 300


def _shuffled_shards(spark: SparkSession, d: str) -> str:
    """Documents written as shuffled shards of the scratch folder; a thousand rows make a few files."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
    shards.write_shuffled(table(spark, d, "documents"), "doc_id", folder, SHARD_ROWS, seed=42)
    return folder


@query(f"""
SELECT doc_id, r - 1 AS key, (r - 1) // {SHARD_ROWS} * {SHARD_ROWS} AS first_key, n_chars
FROM {rank_sql("documents", "doc_id", 42)}""")
def shuffle_files(spark, d):
    """The permutation as files, read again by position."""
    return readers.shards(spark, _shuffled_shards(spark, d), "doc_id", "n_chars").select("doc_id", "key", "first_key", "n_chars")


@query(f"""
SELECT l.doc_id AS key, quality, d.doc_id AS found, n_chars FROM labels l
JOIN {rank_sql("documents", "doc_id", 42)} d ON l.doc_id = r - 1""")
def shard_lookup(spark, d):
    """Rows at given positions of the shuffled files; files that hold none of them are not read."""
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality")
    rows = shards.at_positions(spark, _shuffled_shards(spark, d), wanted, "key", "doc_id", "n_chars")
    return rows.withColumnRenamed("doc_id", "found")


@query("""
SELECT 'first' AS kind, * FROM (SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 10)
UNION ALL SELECT 'random', * FROM (SELECT doc_id, n_chars FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 1)
""")
def head_preview(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    first, one = splits.head(docs, "doc_id", 10, shuffle=True), splits.random_row(docs, "doc_id", seed=1)
    return first.select(F.lit("first").alias("kind"), "*").unionByName(one.select(F.lit("random").alias("kind"), "*"))


@query("SELECT l_linenumber, count(*) AS rows, least(5000, count(*)) AS samples FROM lineitem GROUP BY l_linenumber")
def sample_cap_report(spark, d):
    return splits.sample_report(table(spark, d, "lineitem"), ["l_linenumber"], max_samples=5000)
