"""Instruction rows, prompts and k-shot prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.functions import labels as lab
from shotweave.functions import text as txt
from shotweave.operators import melt, rows, similarity, splits
from shotweave.plans import kshot
from shotweave.plans.skew import KEY_ROWS, lookup_join
from shotweave.session import cut_lineage, spread
from shotweave.workloads.labelling import signed_labels
from shotweave.workloads.registry import query, table
from shotweave.workloads.search import fp_sql
from shotweave.workloads.splitting import greedy_sql, rank_sql

PROMPTS = {
    "assay": {
        "quality": ["Judge the text. Is it of high quality?", "Read the text. Would you keep it? ", "Is the text good?"],
        "toxic": ["Is the text toxic?", "Look for harmful words. Does the text have any?"],
    },
    "property": {
        "p_size": ["What is the size of the part?", "Give the size. Use a whole number."],
        "p_size_negative": ["What is the size below zero?"],
        "p_retailprice": ["What does the part cost?", "Give the price. Use two decimals.", "Price?"],
        "p_retailprice_negative": ["What is the price taken away?", "Give the negative price."],
        "large": ["Is the part large?"],
        "large_negative": ["Is the part small?", "Is the part anything but large?"],
    },
}
ZERO_SHOT = {"quality": "Judge the text. Use any language. Is it of high quality?\n", "toxic": "Is the text toxic?\n"}
ZERO_SHOT_NUMBERS = {"mass": "Weigh the text. Give the number.\n", "share": "What share of the space does the text take?\n"}
AUGMENTED = [
    ("documents", "quality", "rewrite", 0, "Rate this text. "), ("documents", "quality", "rewrite", 1, "Is it good?"),
    ("documents", "quality", "expand", 0, "Read the whole text with care. Is it of high quality?"),
    ("documents", "quality", "shorten", 0, "Good?"), ("documents", "toxic", "detail", 0, "Toxic text harms. "),
    ("documents", "toxic", "detail", 1, "Is this text toxic?"), ("documents", "toxic", "shorten", 0, "Toxic?"),
    ("documents", "toxic", "name", 0, "toxicity"),
]


def _values(tuples) -> str:
    def text(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return ", ".join("(" + ", ".join(text(v) for v in t) + ")" for t in tuples)


def _prompt_lists(spark: SparkSession, corpus: str) -> DataFrame:
    return rows.prompt_lists(catalog.prompt_table(spark, PROMPTS), corpus)


def _prompts_sql(corpus: str) -> str:
    flat = [(t, i, text) for t, texts in PROMPTS[corpus].items() for i, text in enumerate(texts)]
    return f"prompts AS (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM (VALUES {_values(flat)}) p(task, i, text))"


def _pick_sql(seed: int, ids: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {ids}), 1, 8))::BIGINT % n = i"


@query("WITH " + _prompts_sql("assay") + f""",
chosen AS (SELECT doc_id, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'valid' END AS split FROM {rank_sql("documents", "doc_id", 0)}),
signed AS (SELECT doc_id, 'quality' AS task, 2 * quality - 1 AS label FROM labels UNION ALL SELECT doc_id, 'toxic', 2 * toxic - 1 FROM labels)
SELECT d.text AS smiles, p.text AS text, CASE WHEN s.label > 0 THEN 'Yes' ELSE 'No' END AS label,
       source || '-' || d.doc_id AS chemid, s.task AS assayid, split
FROM signed s JOIN chosen USING (doc_id) JOIN documents d USING (doc_id) JOIN prompts p ON p.task = s.task AND {_pick_sql(0, "s.task")}
WHERE len(list_filter(string_split_regex(d.text, '[ \\t\\n\\r]+'), lambda t: t <> '')) >= 1
  AND length(d.text) - length(replace(d.text, '(', '')) = length(d.text) - length(replace(d.text, ')', ''))""")
def assay_instructions(spark, d):
    docs = table(spark, d, "documents")
    ids = splits.id_split(docs.select(F.col("doc_id").alias("mol_id")), "mol_id")
    valid, _ = melt.split_valid(docs.select(F.col("doc_id").alias("mol_id"), "text"), "text")
    entities = docs.select(F.col("doc_id").alias("mol_id"), F.concat_ws("-", "source", "doc_id").alias("ext_id"),
                           F.col("text").alias("smiles"))
    signed = signed_labels(spark, d).withColumnRenamed("doc_id", "mol_id")
    return rows.assay_rows(signed, ids, valid, entities, _prompt_lists(spark, "assay"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", "p_name", "p_brand", "p_retailprice", F.when(F.col("p_size") > 3, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_size") > 25, "Y").otherwise("N").alias("large"))


MELT_SQL = """
long AS (
  SELECT p_partkey, p_name, 'p_size' AS key, p_size::VARCHAR AS label, (-p_size)::VARCHAR AS negated FROM part WHERE p_size > 3
  UNION ALL SELECT p_partkey, p_name, 'p_retailprice', regexp_replace(p_retailprice::DECIMAL(18,2)::VARCHAR, '0$', ''),
    CASE WHEN p_retailprice % 1 = 0 THEN (-(p_retailprice::BIGINT))::VARCHAR
         ELSE regexp_replace((-p_retailprice)::DECIMAL(18,2)::VARCHAR, '0$', '') END FROM part
  UNION ALL SELECT p_partkey, p_name, 'large', CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END,
    CASE WHEN p_size > 25 THEN 'No' ELSE 'Yes' END FROM part)"""


@query("WITH " + _prompts_sql("property") + "," + MELT_SQL + f"""
SELECT p_name AS smiles, text, label, p_partkey::VARCHAR AS chemid, key AS assayid
FROM long JOIN prompts ON task = key AND {_pick_sql(0, "p_partkey || ':' || key")}""")
def property_instructions(spark, d):
    columns = ["p_size", "p_retailprice", "large", "p_brand"]
    return rows.property_rows(_parts(spark, d), "p_partkey", "p_name", columns, _prompt_lists(spark, "property"))


@query("WITH " + _prompts_sql("property") + "," + MELT_SQL + f""",
split AS (SELECT p_partkey, CASE WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'valid' END AS split FROM {rank_sql("part", "p_partkey", 0)})
SELECT p_name AS smiles, text, label, p_partkey::VARCHAR AS chemid, key AS assayid, split
FROM long JOIN split USING (p_partkey) JOIN prompts ON task = key AND {_pick_sql(0, "p_partkey || ':' || key")}
WHERE (split = 'train') = (key <> 'p_retailprice')""")
def property_by_split(spark, d):
    split = splits.id_split(_parts(spark, d), "p_partkey")
    keys = {"train": ["p_size", "large"], "valid": ["p_retailprice"]}
    return rows.property_rows_by_split(split, "p_partkey", "p_name", "split", keys, _prompt_lists(spark, "property"))


@query("WITH " + _prompts_sql("property") + "," + MELT_SQL + f""",
flipped AS (SELECT *, ('0x' || substr(md5('0-negate:' || p_partkey || ':' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 AS flip FROM long),
named AS (SELECT *, key || CASE WHEN flip THEN '_negative' ELSE '' END AS name FROM flipped)
SELECT p_name AS smiles, text, CASE WHEN flip THEN negated ELSE label END AS label, p_partkey::VARCHAR AS chemid, name AS assayid
FROM named JOIN prompts ON task = name AND {_pick_sql(0, "p_partkey || ':' || name")}""")
def negation_augment(spark, d):
    columns = ["p_size", "p_retailprice", "large"]
    prompts = _prompt_lists(spark, "property")
    return rows.property_rows(_parts(spark, d), "p_partkey", "p_name", columns, prompts, negation=0.5)


def _doc_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return splits.greedy_group_split(docs, ["source"], "doc_id").select("doc_id", "split")


def _zero_shot(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    long = melt.masked_labels(docs, table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return _zero_shot_rows(spark, d, long, ZERO_SHOT, "cla")


def _zero_shot_test(spark: SparkSession, d: str, long: DataFrame) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = _doc_split(spark, d).filter(F.col("split") == "test").select("doc_id")
    return long.join(held_out, "doc_id").join(docs.select("doc_id", "text"), "doc_id").select(
        F.lit("documents").alias("dataset"), "task", F.col("doc_id").alias("row_id"), F.col("text").alias("smiles"), "label")


def _zero_shot_rows(spark: SparkSession, d: str, long: DataFrame, texts: dict, kind: str) -> DataFrame:
    test = _zero_shot_test(spark, d, long)
    prompts = spark.createDataFrame([("documents", t, i) for t, i in texts.items()], "dataset string, task string, instruction string")
    return rows.zero_shot_rows(test, prompts, kind)


def numeric_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two regression tasks on the labelled documents: numbers of many digits, from 1e7 up and from 1e-3 down."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    wide = docs.select("doc_id", (F.col("n_chars") * 100000.125).alias("mass"), (F.col("n_chars") / 2.0**25).alias("share"))
    return wide.unpivot(["doc_id"], ["mass", "share"], "task", "label")


NUMERIC_SQL = """(SELECT doc_id, 'mass' AS task, n_chars * 100000.125::DOUBLE AS y FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'share', n_chars / 33554432.0::DOUBLE FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""
NUMBER_TEXT_SQL = r"(CASE WHEN y < 1 THEN regexp_replace(y::VARCHAR::DECIMAL(38,37)::VARCHAR, '(\.\d+?)0+$', '\1') ELSE y::VARCHAR END)"


ZERO_SQL = "WITH RECURSIVE" + greedy_sql("documents", "source", "doc_id") + f""",
zero_prompts AS (SELECT * FROM (VALUES {_values(ZERO_SHOT.items())}) p(task, instruction)),
zero AS (SELECT 'documents' AS dataset, l.task, d.doc_id AS row_id, instruction, text AS input, CASE WHEN y = 1 THEN 'Yes' ELSE 'No' END AS output
  FROM (SELECT doc_id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
  JOIN documents d USING (doc_id) JOIN assigned ON grp = source JOIN zero_prompts USING (task) WHERE split = 'test')
"""


@query(ZERO_SQL + "SELECT * FROM zero")
def zero_shot_rows(spark, d):
    return _zero_shot(spark, d)


STYLE = "shorten"


@query(ZERO_SQL + f"""SELECT dataset, task, row_id, styled AS instruction, input, output FROM zero
JOIN (VALUES {_values([(t, text) for _, t, aug, i, text in AUGMENTED if aug == STYLE and i == 0])}) p(task, styled) USING (task)""")
def zero_shot_styled(spark, d):
    """Zero-shot rows whose prompts were rewritten in one style."""
    augmented = spark.createDataFrame(AUGMENTED, "corpus string, task string, aug string, variant_no int, text string")
    prompts = rows.first_prompts(augmented, STYLE)
    long = melt.masked_labels(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return rows.zero_shot_rows(_zero_shot_test(spark, d, long), prompts, "cla")


@query("WITH RECURSIVE" + greedy_sql("documents", "source", "doc_id") + f"""
SELECT 'documents' AS dataset, task, doc_id AS row_id, instruction, text AS input, {NUMBER_TEXT_SQL} AS output
FROM {NUMERIC_SQL} l JOIN documents d USING (doc_id) JOIN assigned ON grp = source
JOIN (VALUES {_values(ZERO_SHOT_NUMBERS.items())}) p(task, instruction) USING (task) WHERE split = 'test'""")
def zero_shot_rows_reg(spark, d):
    return _zero_shot_rows(spark, d, numeric_labels(spark, d), ZERO_SHOT_NUMBERS, "reg")


@query(ZERO_SQL + f""",
parts AS (SELECT * FROM (VALUES {_values(AUGMENTED)}) p(dataset, task, aug, i, text) WHERE aug <> 'name'),
aug AS (SELECT dataset, task, aug, string_agg(text, '' ORDER BY i) AS instruction FROM parts GROUP BY ALL)
SELECT dataset, task, aug, row_id, aug.instruction, input, output FROM zero JOIN aug USING (dataset, task)""")
def prompt_augment(spark, d):
    augmented = spark.createDataFrame(AUGMENTED, "dataset string, task string, aug string, variant_no int, text string")
    return rows.augment_prompts(_zero_shot(spark, d), augmented)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn, the answer that follows it (empty if none does), and the conversation's system texts in turn order."""
    talk = table(spark, d, "conversations")
    asked = talk.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    answers = talk.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    system = talk.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("input"))
    return asked.join(answers, ["conv_id", "turn"], "left").join(system, "conv_id", "left").fillna("", ["output"])


# The published template.
HEAD_PLAIN = """Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
"""
HEAD_INPUT = """Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.

### Instruction:
"""
INPUT = """

### Input:
"""
ANSWER = """

### Response:
"""

TURNS_SQL = """
WITH turns AS (
  SELECT a.conv_id, a.turn, a.text AS instruction, s.text AS input, coalesce(b.text, '') AS output
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
  LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = a.conv_id
  WHERE a.role = 'user'),
rendered AS (
  SELECT *, CASE WHEN coalesce(input, '') = ''
    THEN '""" + HEAD_PLAIN + """' || instruction || '""" + ANSWER + """'
    ELSE '""" + HEAD_INPUT + """' || instruction || '""" + INPUT + """' || input || '""" + ANSWER + """' END AS prompt FROM turns)
"""


@query(TURNS_SQL + "SELECT conv_id, turn, prompt, prompt || output AS full_prompt FROM rendered")
def render_template(spark, d):
    return _turns(spark, d).select(
        "conv_id", "turn", catalog.render(F.col("instruction"), F.col("input")).alias("prompt"),
        catalog.render(F.col("instruction"), F.col("input"), F.col("output")).alias("full_prompt"))


@query(TURNS_SQL + """,
tok AS (SELECT conv_id, turn,
  list_append(list_filter(string_split_regex(prompt || output, '[ \\t\\n\\r]+'), lambda x: x <> ''), '</s>') AS f,
  len(list_filter(string_split_regex(prompt, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS u FROM rendered)
SELECT conv_id, turn, array_to_string(f[u + 1:], ' ') AS answer FROM tok""")
def answer_tokens(spark, d):
    made = rows.tokenized_rows(_turns(spark, d), keep=["conv_id", "turn"])
    return made.select("conv_id", "turn", F.array_join(
        txt.answer_tokens(F.col("tokens"), F.col("prompt_length")), " ").alias("answer"))


@query(TURNS_SQL + """,
tok AS (SELECT conv_id, turn, string_split(prompt || output, '.') AS f, string_split(prompt, '.') AS u FROM rendered)
SELECT conv_id, turn, len(f) + CASE WHEN f[len(f)] = '' THEN 0 ELSE 1 END AS n_tokens, len(u) AS prompt_length FROM tok""")
def custom_tokenizer(spark, d):
    """Rows cut by a caller's tokenizer, here at full stops; its own empty last piece closes a text."""
    made = rows.tokenized_rows(_turns(spark, d), keep=["conv_id", "turn"], end="", tokenize=lambda t: F.split(t, r"\.", -1))
    return made.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.col("prompt_length").cast("bigint").alias("prompt_length"))


@query(TURNS_SQL + """,
tok AS (SELECT conv_id, turn,
  list_filter(string_split_regex(prompt || output, '[ \\t\\n\\r]+'), lambda x: x <> '')AS f,
  list_filter(string_split_regex(prompt, '[ \\t\\n\\r]+'), lambda x: x <> '')AS u FROM rendered),
closed AS (SELECT *, list_append(f, '</s>') AS full_tokens FROM tok)
SELECT conv_id, turn, len(full_tokens) AS n_tokens, len(u) AS prompt_length,
  array_to_string(list_concat(list_transform(range(len(u)), lambda x: '-100'), full_tokens[len(u) + 1:]), ' ') AS labels FROM closed""")
def response_mask(spark, d):
    made = rows.tokenized_rows(_turns(spark, d), keep=["conv_id", "turn"])
    return made.select("conv_id", "turn", F.size("tokens").cast("bigint").alias("n_tokens"),
                       F.col("prompt_length").cast("bigint").alias("prompt_length"), F.array_join("labels", " ").alias("labels"))


# --- k-shot -----------------------------------------------------------------------------------------------------


def _kshot_inputs(spark: SparkSession, d: str):
    entities = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("smiles"))
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("key"))
    prints = kshot.fingerprints_of(spread(lookup_join(entities, labelled, ["key"], ["key"], max_rows=KEY_ROWS), scan=entities))
    instructions = spark.createDataFrame(list(ZERO_SHOT.items()), "task string, instruction string")
    return entities, prints, instructions


def _kshot_test(spark: SparkSession, d: str, style: str, search=similarity.nearest) -> DataFrame:
    entities, prints, instructions = _kshot_inputs(spark, d)
    signed = signed_labels(spark, d).withColumnRenamed("doc_id", "key")
    zero_one = signed.withColumn("label", (F.col("label") + 1) / 2)
    both = cut_lineage(kshot.task_rows(prints, zero_one).join(_doc_split(spark, d).withColumnRenamed("doc_id", "key"), "key"))
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    return kshot.test_prompts(entities, test, train, instructions, style, search=search)


def _kshot_regression(spark: SparkSession, d: str, style: str) -> DataFrame:
    entities, prints, _ = _kshot_inputs(spark, d)
    instructions = spark.createDataFrame(list(ZERO_SHOT_NUMBERS.items()), "task string, instruction string")
    labels = numeric_labels(spark, d).withColumnRenamed("doc_id", "key")
    both = cut_lineage(kshot.task_rows(prints, labels).join(_doc_split(spark, d).withColumnRenamed("doc_id", "key"), "key"))
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    return kshot.test_prompts(entities, test, train, instructions, style, yes_no=False)


CLASSES_SQL = "(SELECT doc_id, 'quality' AS task, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"
CLASS_TEXT_SQL = "CASE WHEN y = 1 THEN 'Yes' ELSE 'No' END"


def _kshot_sql(pool: str, width: int, shots: tuple[int, ...], block: str, subject: str, labels: str = CLASSES_SQL,
               label: str = CLASS_TEXT_SQL, texts: dict = ZERO_SHOT) -> str:
    values = ", ".join(f"({s})" for s in shots)
    return "WITH RECURSIVE" + fp_sql("documents", "doc_id", "text", "docs") + "," + greedy_sql("documents", "source", "doc_id") + f""",
inst AS (SELECT * FROM (VALUES {_values(texts.items())}) p(task, instruction)),
all_rows AS (SELECT l.doc_id AS key, l.task, {label} AS label, text, split, fp
  FROM {labels} l
  JOIN documents d USING (doc_id) JOIN assigned ON grp = source LEFT JOIN docs ON docs.key = l.doc_id),
{pool},
near AS (SELECT * FROM (
  SELECT q.key AS qk, q.task AS qt, c.text, c.label, row_number() OVER (PARTITION BY q.key, q.task
    ORDER BY 1 - bit_count(q.fp & c.fp)::DOUBLE / bit_count(q.fp | c.fp), c.key) AS rn
  FROM asking q JOIN pool c ON c.task = q.task AND c.key <> q.key WHERE q.fp IS NOT NULL AND c.fp IS NOT NULL) WHERE rn <= {width}),
classed AS (SELECT *, row_number() OVER (PARTITION BY qk, qt, label ORDER BY rn) AS cn FROM near),
shots AS (SELECT * FROM (VALUES {values}) s(shot)),
blocks AS (SELECT qk, qt, shot, string_agg('SMILES: ' || text || chr(10) || 'label: ' || label || chr(10), '' ORDER BY {block}
  GROUP BY qk, qt, shot)
SELECT q.key AS query_id, q.task, s.shot, (CASE WHEN instruction NOT LIKE '%. %' THEN 'Here are some examples about ' || {subject} || '.' || chr(10)
    ELSE array_to_string(string_split(instruction, '. ')[1:-2], '. ') || '. Here are some examples.' || chr(10) END)
  || coalesce(block, '') || string_split(instruction, '. ')[-1] AS instruction, q.text AS input, q.label AS output
FROM asking q JOIN inst USING (task) CROSS JOIN shots s LEFT JOIN blocks b ON b.qk = q.key AND b.qt = q.task AND b.shot = s.shot"""


TEST_POOL = "asking AS (SELECT * FROM all_rows WHERE split = 'test'), pool AS (SELECT * FROM all_rows WHERE split = 'train')"
TRAIN_POOL = "asking AS (SELECT * FROM all_rows), pool AS (SELECT * FROM all_rows)"
NEAR_BLOCK = "rn) AS block FROM classed JOIN shots ON rn <= shot"
FAR_BLOCK = "rn DESC) AS block FROM classed JOIN shots ON rn <= shot"
BALANCED_BLOCK = "label DESC, rn) AS block FROM classed JOIN shots ON cn <= shot / 2"


@query(_kshot_sql(TRAIN_POOL, 4, (1, 2, 3, 4), NEAR_BLOCK, "'molecule ' || q.task"))
def kshot_train(spark, d):
    entities, prints, instructions = _kshot_inputs(spark, d)
    labels = signed_labels(spark, d).select(F.col("doc_id").alias("key"), "task", lab.sign_text(F.col("label")).alias("label"))
    return kshot.train_prompts(entities, cut_lineage(kshot.task_rows(prints, labels)), instructions, search=similarity.nearest)


@query(_kshot_sql(TEST_POOL, 8, (1, 2, 3, 4, 6, 8), NEAR_BLOCK, "'molecular property'"))
def kshot_test_near(spark, d):
    return _kshot_test(spark, d, kshot.NEAR)


@query(_kshot_sql(TEST_POOL, 8, (2, 3, 4, 6, 8), FAR_BLOCK, "'molecular property'"))
def kshot_test_far(spark, d):
    return _kshot_test(spark, d, kshot.FAR)


@query(_kshot_sql(TEST_POOL, 1_000_000, (2, 4, 6, 8), BALANCED_BLOCK, "'molecular property'"))
def kshot_test_balanced(spark, d):
    return _kshot_test(spark, d, kshot.BALANCED)


@query(_kshot_sql(TEST_POOL, 8, (1, 2, 3, 4, 6, 8), NEAR_BLOCK, "'molecular property'", NUMERIC_SQL, NUMBER_TEXT_SQL,
                  ZERO_SHOT_NUMBERS))
def kshot_test_near_reg(spark, d):
    return _kshot_regression(spark, d, kshot.NEAR)


@query(_kshot_sql(TEST_POOL, 8, (2, 3, 4, 6, 8), FAR_BLOCK, "'molecular property'", NUMERIC_SQL, NUMBER_TEXT_SQL,
                  ZERO_SHOT_NUMBERS))
def kshot_test_far_reg(spark, d):
    return _kshot_regression(spark, d, kshot.FAR)


# --- augmented styles ---------------------------------------------------------------------------------------------

STYLED = [
    ("property", "p_size", "rewrite", 0, "How large is the part?"), ("property", "p_size", "rewrite", 1, "State the size of the part."),
    ("property", "p_retailprice", "rewrite", 0, "State the price."), ("property", "p_size", "shorten", 0, "Size?"),
    ("property", "large", "rewrite", 0, "Would you call the part large?"),
]


@query("WITH" + MELT_SQL + f""",
prompts AS (SELECT *, count(*) OVER (PARTITION BY task) AS n FROM (VALUES {_values([t[1:] for t in STYLED])}) p(task, aug, i, text)
  WHERE aug = 'rewrite')
SELECT p_name AS smiles, text, label, p_partkey::VARCHAR AS chemid, key AS assayid
FROM long JOIN prompts ON task = key AND {_pick_sql(0, "p_partkey || ':' || key")}""")
def property_instructions_styled(spark, d):
    prompts = spark.createDataFrame(STYLED, "corpus string, task string, aug string, variant_no int, text string")
    columns = ["p_size", "p_retailprice", "large"]
    return rows.property_rows(_parts(spark, d), "p_partkey", "p_name", columns, rows.prompt_lists(prompts, "property", "rewrite"))
