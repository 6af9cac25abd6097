"""Instruction rows from labels, properties and prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.functions import labels as lab
from shotweave.functions import text as txt
from shotweave.operators.melt import column_kinds, melt_properties
from shotweave.plans.ranking import hash_pick, hash_uniform
from shotweave.plans.skew import lookup_join

NEGATIVE = "_negative"
NEGATION_SHARE = 0.5


def prompt_lists(prompts: DataFrame, corpus: str, aug: str | None = None) -> DataFrame:
    """``(task, variants)`` of one corpus (and rewriting style, of an augmented catalogue), variants in order.

    The catalogue is written by hand, a few texts per task; collecting a task's variants is bounded by it.
    """
    mine = prompts.filter(F.col("corpus") == corpus)
    if aug is not None:
        mine = mine.filter(F.col("aug") == aug)
    ordered = F.array_sort(F.collect_list(F.struct("variant_no", "text")))
    return mine.groupBy("task").agg(F.transform(ordered, lambda v: v["text"]).alias("variants"))


def _pick(variants: Column, seed: int, *ids: str) -> Column:
    return F.element_at(variants, hash_pick(F.size(variants), seed, *ids) + 1)


def assay_rows(signed: DataFrame, chosen: DataFrame, valid: DataFrame, entities: DataFrame, prompts: DataFrame,
               seed: int = 0) -> DataFrame:
    """``(smiles, text, label, chemid, assayid, split)`` for measured cells of chosen and valid entities.

    ``signed(mol_id, task, label)`` is the long label matrix; ``chosen(mol_id, split)`` says which part an entity is in,
    ``valid`` holds ``mol_id``; ``entities(mol_id, ext_id, smiles)``. The prompt is drawn once per task.
    """
    cells = signed.filter(F.col("label") != 0).join(chosen.select("mol_id", "split"), "mol_id")
    cells = cells.join(valid.select("mol_id"), "mol_id", "left_semi").join(entities, "mol_id")
    drawn = prompts.select("task", _pick(F.col("variants"), seed, "task").alias("text"))
    return lookup_join(cells, drawn, ["task"], ["mol_id"]).select(
        "smiles", "text", lab.sign_text(F.col("label")).alias("label"),
        F.col("ext_id").alias("chemid"), F.col("task").alias("assayid"), "split",
    )


def property_rows(table: DataFrame, key: str, smiles: str, properties: Sequence[str], prompts: DataFrame,
                  negation: float = 0.0, seed: int = 0, kinds: DataFrame | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """``(smiles, text, label, chemid, assayid)`` for every present property of every entity.

    With ``negation`` > 0 that share of the rows whose property also has a
    ``…_negative`` prompt gets that prompt, the negated label and the suffix on ``assayid``.
    Properties without a prompt are left out. The prompt is drawn per row.
    """
    kinds = column_kinds(table, properties) if kinds is None else kinds
    long = lookup_join(melt_properties(table, [key, smiles, *keep], properties), kinds, ["key"], [key])
    negative = prompts.filter(F.col("task").endswith(NEGATIVE)).select(
        F.regexp_replace("task", NEGATIVE + "$", "").alias("key"), F.lit(True).alias("_has_negative")
    )
    flip = F.coalesce(F.col("_has_negative"), F.lit(False)) & (
        hash_uniform(f"{seed}-negate", key, "key") < F.lit(float(negation))
    )
    marked = lookup_join(long, negative, ["key"], [key], "left").withColumn("_flip", flip).withColumn(
        "task", F.when(F.col("_flip"), F.concat("key", F.lit(NEGATIVE))).otherwise(F.col("key"))
    )
    plain = lab.label_text(F.col("value"), F.col("kind"))
    label = F.when(F.col("_flip"), lab.negate_text(plain)).otherwise(plain)
    return lookup_join(marked, prompts, ["task"], [key], hot_from=marked).select(
        F.col(smiles).alias("smiles"),
        _pick(F.col("variants"), seed, key, "task").alias("text"),
        label.alias("label"),
        F.col(key).cast("string").alias("chemid"),
        F.col("task").alias("assayid"),
        *keep,
    )


def property_rows_by_split(table: DataFrame, key: str, smiles: str, split: str,
                           keys_by_split: Mapping[str, Sequence[str]], prompts: DataFrame, seed: int = 0) -> DataFrame:
    """Property rows in which each split sees its own list of properties.

    Kinds come from the whole table, and the table is melted once: a row
    keeps a property only if its split lists it.
    """
    properties = sorted({p for keys in keys_by_split.values() for p in keys})
    kinds = column_kinds(table, properties)
    wanted = [F.when(F.col(split).isin([s for s, keys in keys_by_split.items() if p in keys]), F.col(p)).alias(p)
              for p in properties]
    rows = table.select(key, smiles, split, *wanted)
    return property_rows(rows, key, smiles, properties, prompts, seed=seed, kinds=kinds, keep=[split])


def with_prompt(rows: DataFrame, prompts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach prompts by data set and task (and augmentation); rows without one are dropped."""
    return lookup_join(rows, prompts, on, ["row_id"])


def zero_shot_rows(test: DataFrame, prompts: DataFrame, kind: str = "cla") -> DataFrame:
    """Published zero-shot rows ``(dataset, task, row_id, instruction, input, output)``.

    ``test(dataset, task, row_id, smiles, label)`` may hold the missing-label
    sentinel; ``prompts(dataset, task, instruction)`` has the first variant per task.
    """
    known = test.filter(F.col("label").isNotNull() & (F.col("label") != lab.MISSING))
    output = lab.output_text(F.col("label").cast("double"), F.lit(kind))
    return with_prompt(known, prompts, ["dataset", "task"]).select(
        "dataset", "task", "row_id", "instruction", F.col("smiles").alias("input"), output.alias("output")
    )


def first_prompts(prompts: DataFrame, style: str | None = None) -> DataFrame:
    """``(dataset, task, instruction)``: the first variant per task of a prompt table; with a ``style``, the first that was rewritten in it
    (``prompts`` has ``aug`` then), and tasks without one have no row."""
    chosen = prompts if style is None else prompts.filter(F.col("aug") == style)
    return chosen.filter(F.col("variant_no") == 0).select(
        F.col("corpus").alias("dataset"), "task", F.col("text").alias("instruction")
    )


def augment_prompts(rows: DataFrame, augmented: DataFrame, styles: Sequence[str] = catalog.AUGMENTATIONS) -> DataFrame:
    """One copy of each row per rewriting style that has a prompt, its parts joined.

    ``augmented(dataset, task, aug, variant_no, text)``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("variant_no", "text")))
    joined = augmented.filter(F.col("aug").isin(*styles)).groupBy("dataset", "task", "aug").agg(
        F.array_join(F.transform(ordered, lambda v: v["text"]), "").alias("instruction")
    )
    return with_prompt(rows.drop("instruction"), joined, ["dataset", "task"])


def tokenized_rows(rows: DataFrame, max_tokens: int | None = None, end: str = "</s>",
                   tokenize=txt.words, train_on_inputs: bool = False, end_after_prompt: bool = False,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Full prompt as tokens, and labels in which everything before the answer is masked.

    ``tokenize`` maps a text Column to an array<string> Column: an expression, or a pandas UDF for an outside
    tokenizer. Without ``max_tokens`` nothing is cut. ``end_after_prompt`` closes the prompt
    with an end token too, which does not count as a masked position.
    """
    limit = max_tokens if max_tokens is not None else 2**31 - 1
    full = txt.close_tokens(
        tokenize(catalog.render(F.col("instruction"), F.col("input"), F.col("output"))), limit, end
    )
    user = F.slice(tokenize(catalog.render(F.col("instruction"), F.col("input"))), 1, limit)
    length = F.size(txt.close_tokens(user, limit, end)) - 1 if end_after_prompt else F.size(user)
    tokens = rows.select(*keep, full.alias("tokens"), length.alias("prompt_length"))
    labels = F.col("tokens") if train_on_inputs else txt.response_mask(F.col("tokens"), F.col("prompt_length"))
    return tokens.withColumn("labels", labels)
