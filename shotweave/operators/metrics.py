"""Scores of a predictions table, per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def margin_score(yes_logit: Column, no_logit: Column) -> Column:
    """Score of the Yes class."""
    return yes_logit - no_logit


def target_class(label_id: Column, yes_id: object, no_id: object) -> Column:
    """1 and 0 for the two answer ids, the missing sentinel for anything else."""
    return F.when(label_id == yes_id, 1).when(label_id == no_id, 0).otherwise(-100)


def accuracy(df: DataFrame, by: Sequence[str], prediction: str, reference: str, weight: str | None = None) -> DataFrame:
    """Weighted share and weighted number of equal pairs."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    hit = F.when(F.col(prediction) == F.col(reference), w).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg(F.try_divide(F.sum(hit), F.sum(w)).alias("accuracy"), F.sum(hit).alias("correct"))


def text_accuracy(df: DataFrame, by: Sequence[str], prediction: str, label: str) -> DataFrame:
    """Share of rows whose predicted text equals the label text."""
    same = F.coalesce(F.col(prediction) == F.col(label), F.lit(False))
    return df.groupBy(*by).agg(F.avg(same.cast("double")).alias("accuracy"))


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """``(by, rows, positives, auc, scorable)``; AUC 0 and not scorable where a class is missing.

    Rows count if ``y >= 0``. They are first reduced to positives and negatives
    per (group, score) before any shuffle; positives below a score then come from
    distributed running sums, so a group may hold any share of the rows. With
    ties counted half this is the average-rank form of the statistic.
    """
    by = list(by)
    per_score = df.filter(F.col(y) >= 0).groupBy(*by, score).agg(
        F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_q")
    )
    ordered = per_score.repartitionByRange(*by, score).sortWithinPartitions(*by, score).select(*by, "_p", "_q")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", _p bigint, _q bigint, _pairs double, _piece int"
    pieces = ordered.mapInArrow(_piece_sums(by), schema)
    # One row per group and partition; what lies in earlier partitions counts as lower scores for all of a piece.
    before = F.coalesce(F.sum("_q").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    sums = pieces.withColumn("_before", before).groupBy(*by).agg(
        F.sum("_p").alias("positives"), F.sum("_q").alias("_negatives"),
        F.sum(F.col("_pairs") + F.col("_p").cast("double") * F.col("_before")).alias("_pairs")
    )
    scorable = (F.col("positives") > 0) & (F.col("_negatives") > 0)
    auc = F.when(scorable, F.col("_pairs") / F.col("positives") / F.col("_negatives")).otherwise(F.lit(0.0))
    scored = sums.select(
        *by, (F.col("positives") + F.col("_negatives")).alias("rows"), "positives",
        auc.alias("auc"), scorable.alias("scorable"),
    )
    return scored


def _piece_sums(by: list[str]):
    """Per group of a sorted partition: positives, negatives, and pairs of a positive over a lower negative (ties half)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        open_key, open_sums = None, None

        def emit(keys: list, sums: list, types: list) -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*keys), types)]
            p, q, pairs = zip(*sums)
            return pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(pairs, pa.float64()),
                                               pa.array([piece] * len(sums), pa.int32())], names=[*by, "_p", "_q", "_pairs", "_piece"])

        types = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))))) or [()] * batch.num_rows
            p, q = (batch.column(len(by) + k).to_numpy() for k in range(2))
            new = [0, *(i for i in range(1, len(keys)) if not _same(keys[i], keys[i - 1]))]
            size = np.diff([*new, len(keys)])
            total = np.cumsum(q)
            before = np.repeat(total[new] - q[new], size)
            pairs = np.add.reduceat(p * (total - before - q / 2.0), new)
            rows = list(zip(np.add.reduceat(p, new).tolist(), np.add.reduceat(q, new).tolist(), pairs.tolist()))
            heads = [keys[i] for i in new]
            if open_sums is not None:
                if _same(open_key, heads[0]):
                    (p0, q0, r0), (p1, q1, r1) = open_sums, rows[0]
                    rows[0] = p0 + p1, q0 + q1, r0 + r1 + p1 * q0
                else:
                    heads.insert(0, open_key)
                    rows.insert(0, open_sums)
            if len(rows) > 1:
                yield emit(heads[:-1], rows[:-1], types)
            open_key, open_sums = heads[-1], rows[-1]
        if open_sums is not None:
            yield emit([open_key], [open_sums], types)

    return run


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def missing_ratio(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of tasks without a score, and the mean score of the others."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.avg((~F.col("scorable")).cast("double")).alias("missing_ratio"),
        F.avg(F.when(F.col("scorable"), F.col("auc"))).alias("mean_auc"),
    )


def regression(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Scores of numeric answers; rows without a parsed number count only in ``parse_ratio``.

    ``residual_std`` is the published "RMSE": the sample deviation of the residuals, free of bias; ``rmse`` is
    the usual one. R² and the correlation are NULL for a constant truth. One pass with map-side combine.
    """
    by = list(by)
    known = F.col(p).isNotNull()
    yv, pv = F.when(known, F.col(y)), F.when(known & F.col(y).isNotNull(), F.col(p))
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(known.cast("double")).alias("parse_ratio"),
        F.stddev_samp(yv - pv).alias("residual_std"),
        F.sqrt(F.avg((yv - pv) * (yv - pv))).alias("rmse"),
        F.try_divide(F.covar_pop(yv, pv), F.stddev_pop(yv) * F.stddev_pop(pv)).alias("correlation"),
        F.stddev_samp(yv).alias("baseline_std"),
        F.sum((yv - pv) * (yv - pv)).alias("_res"),
        (F.var_pop(yv) * F.count(yv)).alias("_tot"),
    )
    return stats.withColumn("r2", F.when(F.col("_tot") > 0, F.lit(1.0) - F.col("_res") / F.col("_tot"))).drop("_res", "_tot")


def shifted_accuracy(df: DataFrame, by: Sequence[str], predictions: str, labels: str) -> DataFrame:
    """Prediction at t against label at t+1 over all positions; the missing sentinel is compared like any label.

    Counted inside each row, so tokens are never exploded.
    """
    n = F.greatest(F.size(labels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(F.col(predictions), F.lit(1), n), F.slice(F.col(labels), F.lit(2), n),
                       lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    hits = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return df.select(*by, hits.alias("_hits"), n.alias("_n")).groupBy(*by).agg(
        F.sum("_n").alias("tokens"), F.try_divide(F.sum("_hits").cast("double"), F.sum("_n")).alias("accuracy")
    )


def perplexity(df: DataFrame, by: Sequence[str], loss: str) -> DataFrame:
    """``exp`` of the mean loss; infinite where that overflows."""
    return df.groupBy(*by).agg(F.exp(F.avg(loss)).alias("perplexity"))
