"""Data-set catalogue, prompt catalogue and prompt templates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The downstream data sets.
# name: (kind, number of tasks, position of the entity string, label columns as a slice)
DATASETS = {
    "esol": ("reg", 1, -1, -2, -1),
    "freesolv": ("reg", 1, 1, 2, 3),
    "lipo": ("reg", 1, 2, 1, 2),
    "pcba": ("cla", 128, -1, 0, 128),
    "muv": ("cla", 17, -1, 0, 17),
    "hiv": ("cla", 1, 0, -1, None),
    "bace": ("cla", 1, 0, 2, 3),
    "bbbp": ("cla", 1, -1, -2, -1),
    "tox21": ("cla", 12, -1, 0, 12),
    "toxcast": ("cla", 617, 0, 1, 618),
    "sider": ("cla", 27, 0, 1, 28),
    "clintox": ("cla", 2, 0, 1, 3),
    "cyp450": ("cla", 5, -1, 2, 7),
}

# Prompt rewriting styles, and the two instruction templates.
AUGMENTATIONS = ("rewrite", "expand", "detail", "shorten")
WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n"
)
WITHOUT_INPUT = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Response:\n"
)
RESPONSE_MARKER = "### Response:"


class Template(NamedTuple):
    """A prompt with an input, one without, and the words that begin the answer."""

    with_input: str
    without_input: str
    response: str


TEMPLATES = {"alpaca": Template(WITH_INPUT, WITHOUT_INPUT, RESPONSE_MARKER)}

CATALOG_SCHEMA = "map<string,map<string,array<string>>>"
AUGMENTED_SCHEMA = "map<string,map<string,map<string,array<string>>>>"


def datasets(spark: SparkSession) -> DataFrame:
    """The catalogue as a 13-row table."""
    rows = [(name, *entry) for name, entry in DATASETS.items()]
    return spark.createDataFrame(rows, "name string, kind string, n_tasks int, smiles_idx int, y_from int, y_to int")


def dataset_entry(name: str) -> tuple:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}")
    return DATASETS[name]


def prompt_table(spark: SparkSession, prompts: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Nested prompts as rows ``(corpus, task, variant_no, text)``."""
    rows = [(c, t, i, text) for c, tasks in prompts.items() for t, texts in tasks.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "corpus string, task string, variant_no int, text string")


def explode_catalog(df: DataFrame, nested: str, *keep: str) -> DataFrame:
    """Catalogue column (corpus to task to variants) as one row per variant."""
    return (
        df.select(*keep, F.explode(nested).alias("corpus", "_tasks"))
        .select(*keep, "corpus", F.explode("_tasks").alias("task", "_variants"))
        .select(*keep, "corpus", "task", F.posexplode("_variants").alias("variant_no", "text"))
    )


def explode_augmented(df: DataFrame, nested: str, *keep: str) -> DataFrame:
    """Augmented catalogue column: one more level, the rewriting style."""
    return (
        df.select(*keep, F.explode(nested).alias("corpus", "_tasks"))
        .select(*keep, "corpus", F.explode("_tasks").alias("task", "_augs"))
        .select(*keep, "corpus", "task", F.explode("_augs").alias("aug", "_variants"))
        .select(*keep, "corpus", "task", "aug", F.posexplode("_variants").alias("variant_no", "text"))
    )


def fill(template: str, **slots: Column) -> Column:
    """Template with ``{slot}`` places as a concat of its literal parts and the slot columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), slots[name]]
    return F.concat(*parts, F.lit(rest))


def load_template(spark: SparkSession, name: str = "alpaca", folder: str | None = None) -> Template:
    """Template by its name: a built-in one, or ``<folder>/<name>.json`` with ``prompt_input``, ``prompt_no_input``, ``response_split``."""
    name = name or "alpaca"
    if folder is None:
        if name not in TEMPLATES:
            raise ValueError(f"unknown template {name}")
        return TEMPLATES[name]
    schema = "prompt_input string, prompt_no_input string, response_split string"
    row = spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=True).first()
    if row is None or row["prompt_input"] is None or row["prompt_no_input"] is None:
        raise ValueError(f"{folder}/{name}.json is no template")
    return Template(row["prompt_input"], row["prompt_no_input"], row["response_split"] or RESPONSE_MARKER)


def render(instruction: Column, input: Column, label: Column | None = None, template: Template = TEMPLATES["alpaca"]) -> Column:
    """Full prompt; the text without input serves rows whose input is null or empty."""
    text = F.when(
        input.isNull() | (input == ""), fill(template.without_input, instruction=instruction)
    ).otherwise(fill(template.with_input, instruction=instruction, input=input))
    if label is None:
        return text
    return F.concat(text, F.coalesce(label, F.lit("")))
