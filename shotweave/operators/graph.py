"""Bipartite entity-task graph: degrees, pruning to a dense core, task edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotweave.plans.ranking import dense_renumber
from shotweave.plans.skew import lookup_join, skew_join
from shotweave.session import cut_lineage


def degrees(cells: DataFrame, node: str) -> DataFrame:
    """Measured, positive and negative cells per node."""
    return cells.groupBy(node).agg(
        F.count(F.lit(1)).alias("degree"),
        F.count_if(F.col("label") > 0).alias("positive"),
        F.count_if(F.col("label") < 0).alias("negative"),
    )


def dense_core(cells: DataFrame, entity: str = "mol_id", task: str = "task_id", threshold: int = 10,
               threshold_pos_neg: int = 10, trace: list[tuple[str, int]] | None = None) -> DataFrame:
    """Repeat until nothing changes: drop thin entities, then thin or one-sided tasks.

    Both rules are monotone, so the result is the one largest core whatever the order. Degrees are counted once; afterwards a round
    only looks at the cells of the nodes it has just dropped and lowers the degrees of their neighbours, so what is joined and
    shuffled shrinks with the number of dropped nodes. The cells themselves are written again when a third of them is gone, so all
    rewriting together costs less than three times the first table. Only node counts reach the driver. ``trace`` receives
    (side, cells of the dropped nodes) of every step.
    """
    cells = cut_lineage(cells.select(entity, task, "label").filter(F.col("label") != 0))
    total = gone = 0
    nodes, dropped = {}, {entity: [], task: []}
    for node in (entity, task):
        nodes[node] = cut_lineage(degrees(cells, node))
    total = nodes[entity].agg(F.sum("degree")).head()[0] or 0
    thin = F.col("degree") < threshold
    failing = {entity: thin, task: thin | (F.col("positive") < threshold_pos_neg) | (F.col("negative") < threshold_pos_neg)}

    def without(rows: DataFrame) -> DataFrame:
        for node, other in ((entity, task), (task, entity)):
            for some in dropped[node]:
                rows = lookup_join(rows, some, [node], [other], "left_anti")
        return rows

    side, other, quiet = entity, task, 0
    while quiet < 2:
        drop = cut_lineage(nodes[side].filter(failing[side]).select(side))
        if drop.isEmpty():
            quiet, side, other = quiet + 1, other, side
            continue
        quiet = 0
        lost = cut_lineage(degrees(without(lookup_join(cells, drop, [side], [other], "left_semi")), other))
        nodes[side] = nodes[side].filter(~failing[side])
        less = lost.select(other, *[F.col(c).alias(f"_{c}") for c in ("degree", "positive", "negative")])
        lowered = [(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("degree", "positive", "negative")]
        nodes[other] = cut_lineage(nodes[other].join(less, other, "left").select(other, *lowered))
        dropped[side].append(drop)
        step = lost.agg(F.sum("degree")).head()[0] or 0
        gone += step
        if trace is not None:
            trace.append((side, step))
        if 3 * gone > total:
            cells, total, gone = cut_lineage(without(cells)), total - gone, 0
            dropped = {entity: [], task: []}
        side, other = other, side
    return without(cells)


def scored_tasks(edges: DataFrame) -> DataFrame:
    """Tasks at either end of an edge."""
    ends = edges.select(F.explode(F.array("task1", "task2")).alias("task_id"))
    return ends.distinct()


def tasks_in_graph(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks that occur in the edge list."""
    return tasks.join(scored_tasks(edges), "task_id", "left_semi")


def renumber_tasks(tasks: DataFrame) -> DataFrame:
    """``(old_id, new_id)`` with dense new ids in the order of the old ones."""
    return dense_renumber(tasks, "task_id", "new_id").withColumnRenamed("task_id", "old_id")


def renumber_edges(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges whose two ends survive, with both ends renumbered."""
    numbers = cut_lineage(numbers)
    first = numbers.select(F.col("old_id").alias("task1"), F.col("new_id").alias("_n1"))
    second = numbers.select(F.col("old_id").alias("task2"), F.col("new_id").alias("_n2"))
    one = lookup_join(edges, first, ["task1"], ["task2", "score"])
    both = lookup_join(one, second, ["task2"], ["task1", "score"], hot_from=edges)
    return both.select(F.col("_n1").alias("task1"), F.col("_n2").alias("task2"), "score")


def task_pair_scores(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """Score of a task pair: the best score between any two of their members; zero scores dropped.

    ``members(task, member)``, ``pair_scores(member1, member2, score)``. Pair scores are
    reduced before each join, so a member of many pairs is not carried twice, and
    written once, since hot members are counted in them.
    """
    best = cut_lineage(pair_scores.filter(F.col("score") > 0)
                       .groupBy("member1", "member2").agg(F.max("score").alias("score")))
    first = members.select(F.col("member").alias("member1"), F.col("task").alias("task1"))
    second = members.select(F.col("member").alias("member2"), F.col("task").alias("task2"))
    left = (skew_join(best, first, ["member1"], ["member2"])
            .groupBy("task1", "member2").agg(F.max("score").alias("score")))
    both = skew_join(left, second, ["member2"], ["task1"], hot_from=best)
    return both.groupBy("task1", "task2").agg(F.max("score").alias("score"))
