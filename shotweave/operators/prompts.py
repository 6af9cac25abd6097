"""k-shot prompts from neighbour lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotweave.functions import text as txt
from shotweave.functions.labels import NO, YES, class_text, plain_text

# Shot counts of the published files.
TRAIN_SHOTS = (1, 2, 3, 4)
NEAR_SHOTS = (1, 2, 3, 4, 6, 8)
FAR_SHOTS = (2, 3, 4, 6, 8)
BALANCED_SHOTS = (2, 4, 6, 8)


def example(smiles: Column, label: Column) -> Column:
    """One example; NULL where the label has no text."""
    return F.concat(F.lit("SMILES: "), smiles, F.lit("\nlabel: "), label, F.lit("\n"))


def envelope(instruction: Column, block: Column, subject: Column) -> Column:
    """Put the examples before the last sentence of the instruction.

    A one-sentence instruction gets a lead that names ``subject``.
    """
    front, last = txt.front_sentences(instruction), txt.last_sentence(instruction)
    lead = F.when(front == "", F.concat(F.lit("Here are some examples about "), subject, F.lit(".\n"))).otherwise(
        F.concat(front, F.lit(". Here are some examples.\n"))
    )
    return F.concat(lead, block, last)


def train_subject(assay: Column) -> Column:
    return F.concat(F.lit("molecule "), assay)


def test_subject() -> Column:
    return F.lit("molecular property")


def _examples(neighbours: DataFrame, keys: Sequence[str], text: Column, columns: Sequence[Column]) -> DataFrame:
    """Examples of each query as one array in rank order; bounded by the search width."""
    lines = neighbours.select(*keys, "rank", text.alias("line"), *columns)
    extra = [c for c in lines.columns if c not in (*keys, "rank", "line")]
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line", *extra)))
    return lines.groupBy(*keys).agg(ordered.alias("_lines"))


def _beside(queries: DataFrame, examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return queries.join(examples, list(keys), "left").withColumn(
        "_lines", F.coalesce("_lines", F.array().cast(dict(examples.dtypes)["_lines"]))
    )


def _fan_out(joined: DataFrame, keys: Sequence[str], shots: Sequence[int], block, subject: Column) -> DataFrame:
    """One row per query and shot count, all from one search; ``joined`` has the queries with their examples as ``_lines``."""
    shot = joined.withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots])))
    text = F.array_join(F.transform(block(F.col("_lines"), F.col("shot")), lambda x: x["line"]), "")
    return shot.select(
        *keys, "shot", envelope(F.col("instruction"), text, subject).alias("instruction"),
        F.col("smiles").alias("input"), plain_text(joined, "label").alias("output"),
    )


def _near(lines: Column, shot: Column) -> Column:
    return F.filter(lines, lambda x: x["rank"] <= shot)


def kshot_rows(queries: DataFrame, neighbours: DataFrame, keys: Sequence[str], shots: Sequence[int],
               subject: Column, yes_no: bool = False, far_first: bool = False) -> DataFrame:
    """k-shot rows ``(keys, shot, instruction, input, output)``, nearest example first (or last).

    ``queries(keys, instruction, smiles, label)``; ``neighbours(keys, rank, n_smiles, n_label)``.
    With ``yes_no`` labels 1 and 0 become Yes and No; a neighbour with another
    label adds nothing but still uses up its shot.
    """
    line = shown(F.col("n_smiles"), shown_label(neighbours, yes_no))
    return line_rows(_beside(queries, _examples(neighbours, keys, line, []), keys), keys, shots, subject, far_first)


def shown_label(neighbours: DataFrame, yes_no: bool) -> Column:
    """Text of ``n_label`` in an example."""
    return class_text(F.col("n_label").try_cast("double")) if yes_no else plain_text(neighbours, "n_label")


def shown(smiles: Column, label: Column) -> Column:
    """:func:`example`, empty where string or label is missing."""
    return F.coalesce(example(smiles, label), F.lit(""))


def line_rows(queries: DataFrame, keys: Sequence[str], shots: Sequence[int], subject: Column, far_first: bool = False) -> DataFrame:
    """As :func:`kshot_rows` of ``queries(keys, instruction, smiles, label, _lines)`` whose examples ``(rank, line)`` are already there."""
    def block(lines: Column, shot: Column) -> Column:
        return F.reverse(_near(lines, shot)) if far_first else _near(lines, shot)

    return _fan_out(queries, keys, shots, block, subject)


def balance(neighbours: DataFrame, keys: Sequence[str], label: Column, most: int) -> DataFrame:
    """First ``most`` neighbours of each class, by rank, before any string is attached."""
    order = Window.partitionBy(*keys, "_class").orderBy("rank")
    classed = neighbours.withColumn("_class", class_text(label.try_cast("double"))).filter(F.col("_class").isNotNull())
    return classed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n", "_class")


def balanced_rows(queries: DataFrame, neighbours: DataFrame, keys: Sequence[str], subject: Column,
                  shots: Sequence[int] = BALANCED_SHOTS) -> DataFrame:
    """k-shot rows with k/2 Yes examples, then k/2 No examples, each nearest first.

    The neighbour list should hold the nearest of each class (:func:`shotweave.plans.kshot.test_prompts` searches them class by
    class, so no class is too rare to be found); a class with fewer members gives fewer.
    """
    shown = balance(neighbours, keys, F.col("n_label"), max(shots) // 2).withColumn(
        "klass", class_text(F.col("n_label").try_cast("double"))
    )
    examples = _examples(shown, keys, example(F.col("n_smiles"), F.col("klass")), [F.col("klass")])

    def block(lines: Column, shot: Column) -> Column:
        def first(klass: str) -> Column:
            return F.slice(F.filter(lines, lambda x: x["klass"] == klass), F.lit(1), (shot / 2).cast("int"))

        return F.concat(first(YES), first(NO))

    return _fan_out(_beside(queries, examples, keys), keys, shots, block, subject)
