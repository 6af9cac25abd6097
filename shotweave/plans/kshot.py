"""End-to-end k-shot jobs: entity and label tables in, instruction rows out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from shotweave.functions import fingerprints as fpx
from shotweave.functions.labels import NO, YES, class_text
from shotweave.operators import prompts, similarity
from shotweave.plans.skew import KEY_ROWS, lookup_join
from shotweave.session import cut_lineage, task_slots

NEAR, FAR, BALANCED = "near", "far", "balanced"
SHARED_ROWS, SHARED_HITS = 0.75, 2
PART_ROWS, PART_BYTES = 2048, 32 << 20


def task_rows(fingerprints: DataFrame, labels: DataFrame) -> DataFrame:
    """Fingerprint rows repeated per measured task: ``(key, task, words, label)``."""
    return labels.join(fingerprints.select("key", "words"), "key")


def _share_a_search(rows: DataFrame) -> bool:
    """Whether tasks are several and measure nearly the same entities: on average ``SHARED_ROWS`` of all, each once and with one fingerprint."""
    entities = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"),
                                       F.min(F.xxhash64("words")).alias("lo"), F.max(F.xxhash64("words")).alias("hi"))
    plain = F.col("key").isNotNull() & (F.col("n") == F.col("tasks")) & (F.col("lo") == F.col("hi"))
    seen = entities.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows"), F.bool_and(plain).alias("plain")).head()
    tasks = rows.select("task").distinct().count()
    return tasks > 1 and bool(seen["plain"]) and seen["rows"] >= SHARED_ROWS * tasks * seen["n"]


def _nearest_of_task(rows: DataFrame, k: int, search: Callable[..., DataFrame]) -> DataFrame:
    """``search`` of ``rows(key, task, words)`` among themselves, task by task: ``(query_id, task, rank, key, distance)``.

    Tasks that measure nearly the same entities share one search over all of them for ``SHARED_HITS * k`` neighbours: the first ``k`` of
    these that a task measures are its nearest. An entity of which a task finds fewer is searched in that task alone.
    """
    columns = ["key", "task", "words"]
    if not _share_a_search(rows):
        return search(rows.select(columns), None, k, by=["task"])
    tasks = rows.groupBy("key").agg(F.collect_list("task").alias("tasks"), F.first("words").alias("words"))
    near = search(tasks.select("key", "words"), None, SHARED_HITS * k).drop("rank")
    both = near.join(tasks.select("key", F.col("tasks").alias("_there")), "key").join(
        tasks.select(F.col("key").alias("query_id"), F.col("tasks").alias("_here")), "query_id")
    own = both.select("query_id", F.explode(F.array_intersect("_here", "_there")).alias("task"), "key", "distance")
    order = Window.partitionBy("query_id", "task").orderBy("distance", "key")
    first = own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = cut_lineage(first.select("query_id", "task", "rank", "key", "distance"))
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("key"), "task")
    left = cut_lineage(rows.select(columns).filter(F.col("words").isNotNull()).join(full, ["key", "task"], "left_anti"))
    if left.isEmpty():
        return first
    alone = search(left, rows.select(columns), k + 1, by=["task"]).filter(F.col("key") != F.col("query_id")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = left.select(F.col("key").alias("query_id"), "task")
    return first.join(asked, ["query_id", "task"], "left_anti").unionByName(alone)


def train_prompts(entities: DataFrame, rows: DataFrame, instructions: DataFrame,
                  shots: Sequence[int] = prompts.TRAIN_SHOTS, search=similarity.nearest_lsh) -> DataFrame:
    """Training rows: every labelled entity with its nearest other entities of the same task.

    ``entities(key, smiles)``, ``rows(key, task, words, label)``, ``instructions(task, instruction)``. ``search`` is called like
    :func:`shotweave.operators.similarity.nearest`; the default is exact in tasks of moderate size and finds every neighbour with
    a stated probability in larger ones. ``rows`` are read several times.
    """
    found = cut_lineage(_nearest_of_task(rows, max(shots), search))
    return _assemble(entities, rows, rows, instructions, found, shots, prompts.train_subject(F.col("task")), {})


def test_prompts(entities: DataFrame, test: DataFrame, train: DataFrame, instructions: DataFrame, style: str = NEAR,
                 yes_no: bool = True, shots: Sequence[int] | None = None, search=similarity.nearest_lsh) -> DataFrame:
    """Test rows: every test entity with its nearest *training* entities of the same task.

    ``style`` orders the examples near-first, far-first, or balances the classes. Balanced examples are searched class by
    class, half the largest shot count each, so a class of any rarity gives its nearest.
    Regression labels are shown as they are with ``yes_no=False``.
    """
    shots = shots or {NEAR: prompts.NEAR_SHOTS, FAR: prompts.FAR_SHOTS, BALANCED: prompts.BALANCED_SHOTS}[style]
    columns = ["key", "task", "words"]
    if style == BALANCED:
        classed = train.withColumn("klass", class_text(F.col("label").try_cast("double"))).filter(F.col("klass").isNotNull())
        asking = test.select(*columns, F.explode(F.array(F.lit(YES), F.lit(NO))).alias("klass"))
        found = search(asking, classed.select(*columns, "klass"), max(shots) // 2, by=["task", "klass"])
        found = cut_lineage(found.drop("klass"))
    else:
        found = cut_lineage(search(test.select(columns), train.select(columns), max(shots), by=["task"]))
    how = {"style": style, "yes_no": yes_no}
    return _assemble(entities, test, train, instructions, found, shots, prompts.test_subject(), how)


def _assemble(entities: DataFrame, queries: DataFrame, pool: DataFrame, instructions: DataFrame, found: DataFrame,
              shots: Sequence[int], subject: Column, how: dict) -> DataFrame:
    keys = ["query_id", "task"]
    yes_no = how.get("yes_no", False)
    payload = similarity.with_payload(found, pool.select("key", "task", F.col("label").alias("n_label")),
                                      ["n_label"], by=["task"])
    label = class_text(F.col("label")) if yes_no else F.col("label")
    if how.get("style") == BALANCED:
        payload = similarity.with_payload(payload, entities.select("key", F.col("smiles").alias("n_smiles")), ["n_smiles"])
        texts = queries.select("key", "task", label.alias("label")).join(entities.select("key", "smiles"), "key")
        asked = lookup_join(texts, instructions, ["task"], ["key"], hot_from=queries).withColumnRenamed("key", "query_id")
        return prompts.balanced_rows(asked, payload, keys, subject, shots)
    near = payload.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("rank", "key", prompts.shown_label(payload, yes_no).alias("label")))).alias("_near"))
    asked = queries.select(F.col("key").alias("query_id"), "task", label.alias("label")).filter("query_id IS NOT NULL").join(near, keys, "left")
    asked = asked.withColumn("_near", F.coalesce("_near", F.array().cast(dict(near.dtypes)["_near"])))
    full = _with_texts(asked, queries.count(), entities)

    def texts_of(key: Column) -> Column:
        return F.filter("_texts", lambda t: t["key"] == key)

    lines = F.flatten(F.transform("_near", lambda n: F.transform(
        texts_of(n["key"]), lambda t: F.named_struct(F.lit("rank"), n["rank"], F.lit("line"), prompts.shown(t["smiles"], n["label"])))))
    shown = full.select(*keys, "label", F.array_sort(lines).alias("_lines"), F.explode(texts_of(F.col("query_id"))["smiles"]).alias("smiles"))
    return prompts.line_rows(lookup_join(shown, instructions, ["task"], ["query_id"]), keys, shots, subject, how.get("style") == FAR)


def _with_texts(asked: DataFrame, rows: int, entities: DataFrame) -> DataFrame:
    """``asked(query_id, …, _near)`` with ``_texts``, the rows ``(key, smiles)`` of ``entities`` for the query and its neighbours.

    Queries are sorted by their nearest neighbour and cut into parts of about ``PART_ROWS`` rows. A text is sent once to each part that
    shows it, not to each of its rows, and only texts that some part shows are sent at all.
    """
    spark = asked.sparkSession
    asked = asked.withColumn("_needs", F.array_distinct(F.concat(F.array(F.col("query_id").cast("bigint")), F.transform("_near", lambda n: n["key"]))))
    parts = max(task_slots(spark), -(-rows // PART_ROWS))
    nearest = F.element_at("_needs", F.least(F.size("_needs"), F.lit(2)))
    dealt = cut_lineage(asked.repartitionByRange(parts, nearest, "query_id").withColumn("_part", F.spark_partition_id()))
    wanted = cut_lineage(dealt.select("_part", F.explode("_needs").alias("key")).distinct())
    texts = lookup_join(entities.select(F.col("key").cast("bigint").alias("key"), "smiles"), wanted.select("key").distinct(), ["key"], [],
                        "left_semi", max_rows=KEY_ROWS).join(wanted, "key")
    schema = StructType([f for f in dealt.schema if f.name not in ("_part", "_needs")]).add(
        "_texts", ArrayType(StructType().add("key", "long").add("smiles", "string")))

    def attach(asking: pa.Table, shown: pa.Table) -> pa.Table:
        keys, smiles = shown["key"].to_numpy(), shown["smiles"].combine_chunks()
        order = np.argsort(keys, kind="stable")
        needs = asking["_needs"].combine_chunks()
        ends, flat = needs.offsets.to_numpy(), needs.flatten().to_numpy()
        low, high = (np.searchsorted(keys[order], flat, side) for side in ("left", "right"))
        times = high - low
        take = order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        ends = np.r_[0, np.cumsum(times)][ends - ends[0]]
        size = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(smiles), 0).to_numpy(zero_copy_only=False).astype(np.int64)[take])][ends[1:]]
        cuts = np.r_[0, np.flatnonzero(np.diff(size // PART_BYTES)) + 1, asking.num_rows]
        plain = asking.select([f.name for f in schema][:-1]).combine_chunks()
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = pa.array(take[ends[lo]:ends[hi]])
            items = pa.StructArray.from_arrays([pa.array(keys[take[ends[lo]:ends[hi]]]), smiles.take(some)], names=["key", "smiles"])
            lists = pa.ListArray.from_arrays(pa.array(ends[lo:hi + 1] - ends[lo], pa.int32()), items)
            out.append(plain.slice(lo, hi - lo).append_column("_texts", lists))
        return pa.concat_tables(out)

    tasks = max(task_slots(spark), parts)
    return (dealt.repartition(tasks, "_part").groupBy("_part")
            .cogroup(texts.repartition(tasks, "_part").groupBy("_part")).applyInArrow(attach, schema))


def fingerprints_of(entities: DataFrame, n_bits: int = fpx.KEYS_BITS, n_words: int = fpx.KEYS_WORDS) -> DataFrame:
    """Encode once and write, so that search and assembly read the table instead of hashing again."""
    return cut_lineage(similarity.fingerprint_table(entities, "key", "smiles", n_bits=n_bits, n_words=n_words))
