"""Label melting, cleaning, and label and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave import catalog
from shotweave.functions import cleaning, labels as lab, text as txt
from shotweave.operators import melt, metrics
from shotweave.session import spread
from shotweave.workloads.registry import query, table

MAX_CHARS = 3000


def signed_labels(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "labels").select("doc_id", *[(2 * F.col(t) - 1).alias(t) for t in ("quality", "toxic")])
    return melt.melt_labels(wide, ["doc_id"], ["quality", "toxic"])


@query("""
SELECT doc_id, 'quality' AS task, 2 * quality - 1 AS label FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 'toxic', 2 * toxic - 1 FROM labels WHERE toxic IS NOT NULL
""")
def labels_unpivot(spark, d):
    return signed_labels(spark, d)


@query("""
WITH lines AS (
  SELECT doc_id, lang AS corpus, source AS task, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS variant_no FROM documents)
SELECT doc_id, corpus, task, variant_no, text FROM lines
""")
def prompt_catalog_explode(spark, d):
    docs = table(spark, d, "documents")
    nested = F.to_json(F.create_map("lang", F.create_map("source", F.split("text", "\n"))))
    parsed = docs.select("doc_id", F.from_json(nested, catalog.CATALOG_SCHEMA).alias("nested"))
    return catalog.explode_catalog(parsed, "nested", "doc_id").withColumn("variant_no", F.col("variant_no").cast("bigint"))


def _properties(spark, d):
    """Property table with some missing cells in both of their forms."""
    return table(spark, d, "part").select(
        "p_partkey", "p_name",
        F.when(F.col("p_size") >= 5, F.col("p_size").cast("string")).otherwise("[]").alias("p_size"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("p_type"),
        "p_brand",
    )


@query("""
SELECT p_partkey, 'p_size' AS key, p_size::VARCHAR AS value FROM part WHERE p_size >= 5
UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE p_type <> 'ECONOMY'
UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
""")
def property_melt_filter(spark, d):
    return melt.melt_properties(_properties(spark, d), ["p_partkey"], ["p_size", "p_type", "p_brand"])


def _kind_sql(relation: str, *columns: str) -> str:
    one = """SELECT '{c}' AS key, CASE
      WHEN coalesce(bool_and(coalesce(TRY_CAST({c} AS DOUBLE) % 1 = 0, false)) FILTER ({c} IS NOT NULL), true) THEN 'int'
      WHEN bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL) FILTER ({c} IS NOT NULL) THEN 'float'
      ELSE 'str' END AS kind FROM {r}"""
    return "\nUNION ALL ".join(one.format(c=c, r=relation) for c in columns)


@query(_kind_sql("lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber"))
def property_kind(spark, d):
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber"]
    return melt.column_kinds(table(spark, d, "lineitem"), columns)


@query("""
SELECT d.doc_id, t.task, coalesce(CASE t.task WHEN 'quality' THEN quality ELSE toxic END, -100) AS label
FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES ('quality'), ('toxic')) t(task)
""")
def masked_labels(spark, d):
    return melt.masked_labels(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("""
SELECT 'page' AS kind, page_id AS id, html IS NOT NULL
  AND len(list_filter(string_split_regex(html, '[ \\t\\n\\r]+'), lambda t: t <> '')) >= 1
  AND length(html) - length(replace(html, '<', '')) = length(html) - length(replace(html, '>', '')) AS valid FROM pages
UNION ALL
SELECT 'document', doc_id, text IS NOT NULL
  AND len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) >= 3
  AND length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', '')) FROM documents
""")
def valid_entities(spark, d):
    pages = table(spark, d, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), cleaning.is_valid(F.col("html"), "<>").alias("valid"))
    docs = table(spark, d, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        cleaning.is_valid(F.col("text"), "()", min_tokens=3).alias("valid"))
    return pages.unionByName(docs)


COMPONENT_SQL = """
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, '.')) AS raw, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents),
parts AS (
  SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS component FROM cut),
sized AS (
  SELECT doc_id, i, component,
         len(list_filter(string_split_regex(component, '[ \\t\\n\\r]+'), lambda t: t <> '')) AS size
  FROM parts WHERE component <> ''),
best AS (
  SELECT doc_id, component, size FROM sized
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, i) = 1)
"""
REASON_SQL = COMPONENT_SQL + f""", reasons AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN -1 WHEN coalesce(size, 0) <= 2 THEN -2
    WHEN n_chars < 50 THEN -3 WHEN n_chars > {MAX_CHARS} THEN -4 ELSE 0 END AS reason
  FROM documents LEFT JOIN best USING (doc_id))
"""


@query(COMPONENT_SQL + "SELECT doc_id, component, coalesce(size, 0) AS size FROM documents LEFT JOIN best USING (doc_id)")
def largest_component(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars"))
    return melt.clean(docs, "text", "n_chars").select("doc_id", "component", "size")


def _cleaned(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "n_chars"))
    return melt.clean(docs, "text", "n_chars", max_weight=MAX_CHARS)


@query(REASON_SQL + "SELECT doc_id, reason FROM reasons")
def clean_reason_codes(spark, d):
    return _cleaned(spark, d).select("doc_id", "reason")


@query(REASON_SQL + "SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def reject_histogram(spark, d):
    return melt.reject_histogram(_cleaned(spark, d))


def _text_labels(spark, d):
    """Raw values of three kinds per line item."""
    lines = spread(table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    )).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.explode(F.array(
            F.struct(F.lit("int").alias("kind"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("value")),
            F.struct(F.lit("float").alias("kind"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value")),
            F.struct(F.lit("float").alias("kind"), F.col("l_discount").cast("decimal(18,2)").cast("string").alias("value")),
            F.struct(F.lit("str").alias("kind"), F.col("l_returnflag").alias("value")),
        )).alias("v"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "v.*")


TEXT_LABEL_SQL = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber, l_partkey, 'int' AS kind, l_quantity::DECIMAL(18,2)::VARCHAR AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'float', l_extendedprice::DECIMAL(18,2)::VARCHAR FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'float', l_discount::DECIMAL(18,2)::VARCHAR FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'str', l_returnflag FROM lineitem),
texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, kind, value, CASE kind
    WHEN 'int' THEN TRY_CAST(value AS DOUBLE)::BIGINT::VARCHAR
    WHEN 'float' THEN regexp_replace(TRY_CAST(value AS DOUBLE)::DECIMAL(38,2)::VARCHAR, '0$', '')
    WHEN 'str' THEN CASE value WHEN 'N' THEN 'No' WHEN 'Y' THEN 'Yes' ELSE value END END AS label FROM raw)
"""


@query(TEXT_LABEL_SQL + "SELECT l_orderkey, l_linenumber, l_partkey, kind, label FROM texts")
def label_to_text(spark, d):
    return _text_labels(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "kind", lab.label_text(F.col("value"), F.col("kind")).alias("label"))


@query(TEXT_LABEL_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, label, CASE
    WHEN TRY_CAST(label AS DOUBLE) % 1 = 0 THEN (-(TRY_CAST(label AS DOUBLE)::BIGINT))::VARCHAR
    WHEN TRY_CAST(label AS DOUBLE) IS NOT NULL
      THEN regexp_replace((-TRY_CAST(label AS DOUBLE))::DECIMAL(38,2)::VARCHAR, '0$', '')
    WHEN label = 'Yes' THEN 'No' WHEN label = 'No' THEN 'Yes' END AS negated FROM texts
""")
def label_negate(spark, d):
    labels = _text_labels(spark, d).withColumn("label", lab.label_text(F.col("value"), F.col("kind")))
    return labels.select("l_orderkey", "l_linenumber", "l_partkey", "label", lab.negate_text(F.col("label")).alias("negated"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'Y' WHEN 2 THEN p_retailprice::VARCHAR ELSE p_brand END AS value FROM part)
SELECT p_partkey, CASE value WHEN 'N' THEN 0 WHEN 'Y' THEN 1 ELSE TRY_CAST(value AS DOUBLE) END AS code FROM t
""")
def label_code(spark, d):
    kind = F.col("p_size") % 4
    value = (F.when(kind == 0, "N").when(kind == 1, "Y").when(kind == 2, F.col("p_retailprice").cast("string"))
             .otherwise(F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", lab.label_code(value).alias("code"))


@query("""
SELECT o_orderkey, kind, CASE kind WHEN 'cla' THEN o_totalprice > c_acctbal * 30 ELSE o_totalprice < c_acctbal * 30 END AS better
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (VALUES ('F', 'cla'), ('O', 'reg'), ('P', 'cla')) k(status, kind) ON status = o_orderstatus
""")
def better_result(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("F", "hiv", "O", "esol", "P", "tox21")])
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders = orders.join(customers, "o_custkey")
    kinds = catalog.datasets(spark).select("name", "kind")
    return orders.withColumn("name", names[F.col("o_orderstatus")]).join(F.broadcast(kinds), "name").select(
        "o_orderkey", "kind", lab.better(F.col("o_totalprice"), F.col("c_acctbal") * 30, F.col("kind")).alias("better"))


@query("""
WITH s AS (SELECT conv_id, turn, string_split(text, '. ') AS p FROM conversations)
SELECT conv_id, turn, array_to_string(p[1:len(p) - 1], '. ') AS front, p[len(p)] AS last FROM s
""")
def sentence_split(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", txt.front_sentences(F.col("text")).alias("front"), txt.last_sentence(F.col("text")).alias("last"))


@query("""
WITH t AS (
  SELECT 'page' AS kind, page_id AS id, url AS text FROM pages
  UNION ALL SELECT 'event', event_id, props FROM events
  UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, TRY_CAST(nullif(regexp_extract(text, '-?[0-9]+\\.?[0-9]*'), '') AS DOUBLE) AS number,
       TRY_CAST(nullif(regexp_extract(replace(text, ' ', ''), '-?[0-9]+\\.?[0-9]*'), '') AS DOUBLE) AS compact FROM t
""")
def parse_number(spark, d):
    texts = melt.union_all(
        table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("text")),
        table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("text")),
        table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"),
    )
    return texts.select("kind", "id", txt.first_number(F.col("text")).alias("number"),
                        txt.compact_number(F.col("text")).alias("compact"))


@query("""
SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS response FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE role <> 'assistant'
""")
def extract_response(spark, d):
    answered = F.when(F.col("role") == "assistant",
                      catalog.render(F.lit("Answer."), F.lit(None).cast("string"), F.concat(F.lit("\n "), F.col("text"))))
    decoded = F.coalesce(answered, F.col("text"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", txt.response(decoded, catalog.RESPONSE_MARKER).alias("response"))


@query("""
SELECT event_id, value - (props->>'k')::DOUBLE AS score,
       CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 ELSE -100 END AS y FROM events
""")
def margin_score(spark, d):
    no = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select(
        "event_id", metrics.margin_score(F.col("value"), no).alias("score"),
        metrics.target_class(F.col("event_type"), "purchase", "view").alias("y"))
