"""Train/valid/test splits, folds and shot mixes.

All random choices order rows by md5 of ``seed:id``, so a split can be recreated anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.plans.ranking import hash_order, hash_rank, running_totals
from shotweave.plans.skew import lookup_join
from shotweave.session import cut_lineage

TRAIN, VALID, TEST = "train", "valid", "test"
FRACTIONS = (0.8, 0.1, 0.1)
FILL_WINDOW = 100_000


def check_fractions(*fractions: float) -> None:
    if abs(sum(fractions) - 1.0) > 1e-7:
        raise ValueError("split fractions must add up to 1")


def drop_null_task(df: DataFrame, label: str, null_value: float = 0) -> DataFrame:
    """Rows whose label for the chosen task is measured."""
    return df.filter(F.col(label) != null_value)


def _by_cuts(rank: Column, cuts: Sequence[tuple[Column, str]]) -> Column:
    part = F.when(rank <= cuts[0][0], cuts[0][1])
    for cut, name in cuts[1:]:
        part = part.when(rank <= cut, name)
    return part


def _share(fraction: float, n: Column) -> Column:
    return F.floor(F.lit(float(fraction)) * n)


def random_split(df: DataFrame, key: str, seed: int = 0, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Shuffle rows and cut them at the floors of the train and valid shares; the rest is test."""
    check_fractions(*fractions)
    train, valid = (_share(f, F.col("_n")) for f in fractions[:2])
    part = _by_cuts(F.col("_r"), [(train, TRAIN), (train + valid, VALID)]).otherwise(TEST)
    return hash_rank(df, [key], seed, rank="_r", total="_n").withColumn("split", part).drop("_r", "_n")


def id_split(df: DataFrame, key: str, seed: int = 0, fraction: float = 0.8, overlap: bool = False) -> DataFrame:
    """Ids for training and validation: a random share and its complement, or all ids on both sides."""
    if overlap:
        return df.select("*", F.explode(F.array(F.lit(TRAIN), F.lit(VALID))).alias("split"))
    ranked = hash_rank(df, [key], seed, rank="_r", total="_n")
    part = F.when(F.col("_r") <= _share(fraction, F.col("_n")), TRAIN).otherwise(VALID)
    return ranked.withColumn("split", part).drop("_r", "_n")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 10, seed: int = 0) -> DataFrame:
    """Fold number per row; every label is dealt out evenly over the folds."""
    ranked = hash_rank(df, [key], seed, by=[label], rank="_r", total="_n")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_r", "_n")


def fold_split(folded: DataFrame, fold: int = 0) -> DataFrame:
    return folded.withColumn("split", F.when(F.col("fold") == fold, VALID).otherwise(TRAIN))


def group_sizes(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Size and smallest id per group; the members are never gathered."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))


def _greedy_quotas(train_share: float, valid_share: float):
    """Per distinct group size, how many groups go to train and valid.

    Groups of one size meet the same test, so the largest-first rule needs one
    step per *distinct size*: at most sqrt(2n) rows for n entities.
    """
    def quotas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = pd.concat(list(batches)).sort_values("size", ascending=False)
        n = int((sizes["size"] * sizes["groups"]).sum())
        train_room, room = int(train_share * n), int((train_share + valid_share) * n)
        to_train, to_valid = [], []
        train = valid = 0
        for size, groups in zip(sizes["size"].tolist(), sizes["groups"].tolist()):
            a = min(groups, max(0, (train_room - train) // size))
            train += a * size
            b = min(groups - a, max(0, (room - train - valid) // size))
            valid += b * size
            to_train.append(a)
            to_valid.append(b)
        yield pd.DataFrame({"size": sizes["size"], "groups": sizes["groups"], "to_train": to_train, "to_valid": to_valid})

    return quotas


def greedy_group_split(df: DataFrame, group: Sequence[str], key: str,
                       fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Whole groups, largest first (then larger first id): train while it fits, else valid while both fit, else test."""
    check_fractions(*fractions)
    groups = group_sizes(_keyed(df, group), ["_group"], key).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(groups, ["size"], ["first"], {"_one": "_up"})
    sizes = groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
    quotas = sizes.repartition(1).mapInPandas(
        _greedy_quotas(fractions[0], fractions[1]), "size bigint, groups bigint, to_train bigint, to_valid bigint"
    )
    place = F.col("groups") - F.col("_up") + 1
    part = (F.when(place <= F.col("to_train"), TRAIN)
            .when(place <= F.col("to_train") + F.col("to_valid"), VALID).otherwise(TEST))
    assigned = lookup_join(ranked, cut_lineage(quotas), ["size"], ["first"]).withColumn("split", part).select("_group", "split")
    return _assign(df, assigned, group, key)


def _keyed(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The group as one struct, so that groups with a null part are groups like any other."""
    return df.withColumn("_group", F.struct(*group))


def _assign(df: DataFrame, assigned: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    return lookup_join(_keyed(df, group), cut_lineage(assigned), ["_group"], [key]).select(*df.columns, "split")


def _first_fit(sizes: Sequence[int], room: int) -> tuple[list[int], int]:
    """Places of the sizes that are taken in turn while they fit, and the room left."""
    taken = []
    for i, size in enumerate(sizes):
        if size <= room:
            taken.append(i)
            room -= size
            if not room:
                break
    return taken, room


def _fill(groups: DataFrame, room: int, window: int = FILL_WINDOW) -> DataFrame:
    """Groups accepted by first-fit in ``(h, first)`` order into ``room`` places.

    A step sums the sizes of each hash bucket over the groups that still fit. Buckets are taken whole while their sums fit, and those
    with nothing that fits are not there. From the first bucket that overflows on, ``window`` groups at most come to the driver and
    are decided one by one, with all their skips. The number of jobs is two for every ``window`` groups that still fit, whatever
    their sizes.
    """
    spans, taken, after = [], [], ""
    while room > 0:
        fitting = groups.filter((F.col("_b") > after) & (F.col("size") <= room))
        buckets = fitting.groupBy("_b").agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups")).orderBy("_b").collect()
        limit, whole = room, 0
        while whole < len(buckets) and buckets[whole]["rows"] <= room:
            room -= buckets[whole]["rows"]
            whole += 1
        if whole:
            spans.append((after, buckets[whole - 1]["_b"], limit))
        if whole == len(buckets):
            break
        last, count = whole, buckets[whole]["groups"]
        while last + 1 < len(buckets) and count + buckets[last + 1]["groups"] <= window:
            last += 1
            count += buckets[last]["groups"]
        inside = F.col("_b").between(buckets[whole]["_b"], buckets[last]["_b"]) & (F.col("size") <= room)
        rows = fitting.filter(inside).select("_pos", "size").orderBy("_pos").collect()
        places, room = _first_fit([r["size"] for r in rows], room)
        taken += [(rows[i]["_pos"],) for i in places]
        after = buckets[last]["_b"]
    inside = F.lit(False)
    for start, stop, fits in spans:
        inside = inside | ((F.col("_b") > start) & (F.col("_b") <= stop) & (F.col("size") <= fits))
    single = groups.sparkSession.createDataFrame(taken, "_pos string")
    return groups.filter(inside).unionByName(lookup_join(groups, single, ["_pos"], [], "left_semi").select(*groups.columns))


def random_group_split(df: DataFrame, group: Sequence[str], key: str, seed: int = 0,
                       fractions: Sequence[float] = FRACTIONS, n_rows: int | None = None) -> DataFrame:
    """Whole groups in random order: valid while it fits its floor, else test while it fits, else train.

    ``n_rows`` is the size the floors are taken from (the unfiltered table), by default that of ``df``.
    """
    check_fractions(*fractions)
    place = hash_order(seed, *[F.col("_group")[g] for g in group])
    ordered = cut_lineage(group_sizes(_keyed(df, group), ["_group"], key).withColumn(
        "_pos", F.concat_ws(":", place, F.lpad(F.col("first").cast("string"), 20, "0"))))
    counted = ordered.agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups")).head()
    n = n_rows if n_rows is not None else counted["rows"] or 0
    # Even buckets of at most a quarter of a window.
    digits = max(1, math.ceil(math.log(max(1, 4 * counted["groups"] / FILL_WINDOW), 16)))
    ordered = ordered.withColumn("_b", F.substring("_pos", 1, digits))
    valid = cut_lineage(_fill(ordered, int(fractions[1] * n)).select("_group", "_pos"))
    rest = cut_lineage(ordered.join(valid, "_pos", "left_anti").select(*ordered.columns))
    test = cut_lineage(_fill(rest, int(fractions[2] * n)).select("_group", "_pos"))
    train = rest.join(test, "_pos", "left_anti")
    assigned = (
        valid.select("_group", F.lit(VALID).alias("split"))
        .unionByName(test.select("_group", F.lit(TEST).alias("split")))
        .unionByName(train.select("_group", F.lit(TRAIN).alias("split")))
    )
    return _assign(df, assigned, group, key)


def shot_mix(df: DataFrame, ids: Sequence[str], by: Sequence[str], shares: Sequence[tuple[int, float]],
             seed: int = 0, drop_rest: bool = False) -> DataFrame:
    """Choose one shot count per row: disjoint random shares of each task, every size truncated.

    ``shares`` lists ``(shot, fraction)``. Rows beyond the truncated sizes go to the last share; with ``drop_rest`` they are
    dropped, as in the published mixture.
    """
    ranked = hash_rank(df, ids, seed, by=by, rank="_r", total="_n")
    end, cuts = F.lit(0), []
    for shot, fraction in shares:
        end = end + F.floor(F.col("_n") * F.lit(float(fraction)))
        cuts.append((end, shot))
    part = _by_cuts(F.col("_r"), cuts)
    if not drop_rest:
        part = F.coalesce(part, F.lit(shares[-1][0]))
    return ranked.withColumn("shot", part).filter(F.col("shot").isNotNull()).drop("_r", "_n")


# Shares of the published mixture.
SHARES_01234 = ((0, 0.6), (1, 0.1), (2, 0.1), (3, 0.1), (4, 0.1))


def mix_01234(df: DataFrame, ids: Sequence[str], by: Sequence[str], seed: int = 0, drop_rest: bool = False) -> DataFrame:
    return shot_mix(df, ids, by, SHARES_01234, seed, drop_rest)


def mix_0_4(df: DataFrame, ids: Sequence[str], by: Sequence[str], seed: int = 0) -> DataFrame:
    """Half of each task's rows (rounded down) zero-shot, the others four-shot."""
    ranked = hash_rank(df, ids, seed, by=by, rank="_r", total="_n")
    part = F.when(F.col("_r") <= F.floor(F.col("_n") / 2), 0).otherwise(4)
    return ranked.withColumn("shot", part).drop("_r", "_n")


def pick_shots(mix: DataFrame, shots: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the per-shot tables chosen by a mix: ``shots`` has the ids, ``shot`` and the row."""
    return shots.join(mix.select(*ids, "shot"), [*ids, "shot"], "left_semi")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Whole-table permutation by a range-partitioned sort."""
    return df.orderBy(hash_order(seed, key), key)


def shuffle_positions(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The same permutation as an explicit zero-based position."""
    return hash_rank(df, [key], seed, rank="_r", total="_n").withColumn("pos", F.col("_r") - 1).drop("_r", "_n")


def head(df: DataFrame, key: str, rows: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """First rows in key order, or a shuffled preview of them."""
    first = df.orderBy(key).limit(rows)
    return shuffled(first, key, seed) if shuffle else first


def random_row(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(1)


def sample_report(df: DataFrame, by: Sequence[str], max_samples: int | None = None) -> DataFrame:
    """Reported sample count per group, ``min(max_samples, n)``; rows are not cut."""
    n = F.count(F.lit(1))
    reported = n if max_samples is None else F.least(F.lit(max_samples).cast("bigint"), n)
    return df.groupBy(*by).agg(n.alias("rows"), reported.alias("samples"))
